"""Exact order statistics and running sums for groups of any size.

Spark's range partitioner lays the rows out by (group, order): it draws its bounds
from a bounded sample, takes any type that can be ordered, and cuts inside a
group. The layout is written once with its partition numbers; then every
partition is summed by itself and the sums of the partitions before it are added. So
no task sees more of a group than one partition, and there is one way for all sizes.

Percentiles work on counts of distinct values, which are combined before any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.session import settle


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on same-named keys where NULL meets NULL; keys come from the left.

    With no keys ``right`` has exactly one row, put in as scalar subqueries.
    """
    if not keys:
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _present(df: DataFrame, value: str) -> DataFrame:
    keep = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        keep = keep & ~F.isnan(value)
    return df.where(keep)


def running_sum(df: DataFrame, groups: Sequence[str], order: str, weight: Column, tie: str | None = None,
                out: str = "running", total: str | None = None) -> DataFrame:
    """Add the running sum of ``weight`` in the order of (``order``, ``tie``), own row included.

    Without ``tie`` the values of ``order`` must be distinct within a group. ``df`` is
    read twice, once for the partitioner's sample.
    """
    keys, by = list(groups), [order] + ([tie] if tie else [])
    # both uses below must see the same cut: it is written out with its numbers
    laid = settle(df.withColumn("_weight", weight).repartitionByRange(*keys, *by)
                  .withColumn("_part", F.spark_partition_id()))
    one = W.partitionBy(*(keys or [F.lit(0)]))  # a row per partition that holds a part of the group
    starts = laid.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_w")).select(
        *keys, "_part", (F.sum("_w").over(one.orderBy("_part")) - F.col("_w")).alias("_start"),
        F.sum("_w").over(one).alias("_total"))
    inside = W.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    summed = laid.withColumn("_inside", F.sum("_weight").over(inside))
    res = join_on(summed, starts, [*keys, "_part"]).withColumn(out, F.col("_inside") + F.col("_start"))
    if total:
        res = res.withColumn(total, F.col("_total"))
    return res.drop("_inside", "_start", "_total", "_part", "_weight")


def numbered(df: DataFrame, groups: Sequence[str], order: str, tie: str, out: str = "pos") -> DataFrame:
    """Number the rows of each group from 0 in the order of (``order``, ``tie``).

    Each part is stored in that order with its rows' places, so a number is a place less that of the group's
    first row in the part, plus the rows in the parts before: no window runs over the rows. ``df`` is read twice,
    once for the partitioner's sample.
    """
    keys = list(groups)
    by = [*keys, order, tie]
    laid = settle(df.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    one = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")  # a row per partition that holds a part of the group
    starts = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        *keys, "_part", (F.sum("_n").over(one) - F.col("_n") - F.col("_first")).alias("_shift"))
    return join_on(laid, starts, [*keys, "_part"]).withColumn(out, F.col("_at") + F.col("_shift")).drop(
        "_part", "_at", "_shift")


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, value, n) per distinct value, written out; NULL and NaN are left out."""
    keys = list(groups)
    return settle(_present(df.select(*keys, value), value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))


def shares(counts: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts with ``upto``, the rows at or below a value, and ``total``."""
    return running_sum(counts, groups, value, F.col("n"), None, "upto", "total")


def value_shares(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, value, n, upto, total) per distinct value: rows at or below it."""
    return shares(value_counts(df, value, groups), value, groups)


def percentiles_of_counts(counts: DataFrame, value: str, probs: Mapping[str, float],
                          groups: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles of counted values (``value``, ``n``) with linear interpolation, one row per group."""
    keys = list(groups)
    first = F.col("upto") - F.col("n")

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("total") - 1).cast("double")

    def value_at(r: Column) -> Column:
        return F.max(F.when((first <= r) & (r < F.col("upto")), F.col(value).cast("double")))

    picked = shares(counts, value, keys).groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[c for i, p in enumerate(probs.values())
          for c in (value_at(F.floor(rank(p))).alias(f"_lo{i}"), value_at(F.ceil(rank(p))).alias(f"_hi{i}"))])
    return picked.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (rank(p) - F.floor(rank(p)))).alias(n)
        for i, (n, p) in enumerate(probs.items())])


def percentiles(df: DataFrame, value: str, probs: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    ``probs`` maps output names to shares in 0..1. NULL and NaN are left out.
    """
    return percentiles_of_counts(value_counts(df, value, groups), value, probs, groups)


def modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent value per key and column; the smallest on ties, NULLs left out.

    Counts per (key, value) are combined before the shuffle and spread one key
    over many tasks; the second step keeps one candidate per key.
    """
    types = dict(df.dtypes)
    slots = F.array(*[
        F.struct(F.lit(i).alias("slot"), *[
            (F.col(c) if i == j else F.lit(None).cast(types[c])).alias(f"v{j}")
            for j, c in enumerate(columns)])
        for i, c in enumerate(columns)])
    values = [f"v{j}" for j in range(len(columns))]
    counts = (
        df.select(*keys, F.inline(slots)).groupBy(*keys, "slot", *values)
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def best(j: int, c: str) -> Column:
        v = F.col(f"v{j}")
        candidate = (F.col("slot") == j) & v.isNotNull()
        return F.min_by(v, F.when(candidate, F.struct(-F.col("n"), v))).alias(c)

    return counts.groupBy(*keys).agg(*[best(j, c) for j, c in enumerate(columns)])


def last_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Last non-null value per key by ``order``."""
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out or value))
