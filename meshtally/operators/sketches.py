"""Quantile sketches that are stored once and merged across runs without the log.

A KLL sketch of a metric has a bounded size whatever the run's; sketches of runs merge into that of all. Ranks of its
quantiles are off by at most ``rank_error``. The exact way (``ranks.percentiles``) stays the default elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.sources.store import Store

K = 800  # size parameter: about 0.6 % of rank error


def rank_error(k: int = K) -> float:
    """Twice the bound that the sketch's authors state for 99 of 100 ranks, as a share of the rows."""
    return 2 * 2.296 / k**0.9021


def sketch(df: DataFrame, value: str, keys: Sequence[str], k: int = K) -> DataFrame:
    """(keys, sketch, n): one sketch per key; NULL and NaN are left out, a key without values has none.

    Partial sketches are merged before and after the shuffle, so a key of any size takes one small row per task.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(x, k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """(keys, sketch, n): the sketches of each key as one."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def sketched_quantiles(sketches: DataFrame, probs: Mapping[str, float], keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """(keys, name, p, value, n, error): a value whose rank is ``p`` give or take ``error``, for each of ``probs``."""
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double(
        "sketch", F.lit(float(p))).alias("value")) for name, p in probs.items()])
    return sketches.where(F.col("n") > 0).select(*keys, "n", F.inline(wanted)).select(
        *keys, "name", "p", "value", "n", F.lit(rank_error(k)).alias("error"))


def sketched_shares(sketches: DataFrame, points: Sequence[float], keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """(keys, x, y, n, error): the share of the rows at or below each of ``points``."""
    wanted = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.kll_sketch_get_rank_double("sketch", F.lit(float(x))).alias("y"))
                       for x in points])
    return sketches.where(F.col("n") > 0).select(*keys, "n", F.inline(wanted)).select(
        *keys, "x", "y", "n", F.lit(rank_error(k)).alias("error"))


def _store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, ["run", "metric"])


def save_sketches(sketches: DataFrame, path: str) -> None:
    """Store (run, metric, sketch, n); a run's metric saved again replaces the one before."""
    _store(sketches.sparkSession, path).put(sketches.select("run", "metric", "sketch", "n"))


def load_sketches(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    found = _store(spark, path).read(runs)
    return spark.createDataFrame([], "run string, metric string, sketch binary, n bigint") if found is None else found
