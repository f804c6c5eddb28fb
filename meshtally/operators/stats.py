"""Robust statistics and the numbers behind distribution plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.functions.maths import normal_cdf
from meshtally.operators.ranks import join_on, percentiles_of_counts, running_sum, value_counts, value_shares
from meshtally.session import settle


def reject_outliers(df: DataFrame, value: str, m: float = 2.0, groups: Sequence[str] = ()) -> DataFrame:
    """Keep rows with |value - median| / MAD below ``m``; all of them where the MAD is 0.

    Median and MAD both come from one count of the distinct values; ``df`` is read once more for the filter.
    """
    keys = list(groups)
    counts = value_counts(df, value, keys)
    center = percentiles_of_counts(counts, value, {"_median": 0.5}, keys)

    def distance(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_dev", F.abs(F.col(value) - F.col("_median")))

    # the median is one per group, so it may be a key of the second step and need not be joined again
    away = distance(join_on(counts, center, keys)).groupBy(*keys, "_median", "_dev").agg(F.sum("n").alias("n"))
    limits = settle(percentiles_of_counts(settle(away), "_dev", {"_mad": 0.5}, [*keys, "_median"]))
    scored = distance(join_on(df, limits, keys))
    keep = (F.col("_mad") == 0) | (F.col("_dev") < F.lit(float(m)) * F.col("_mad"))
    return scored.where(keep).drop("_median", "_dev", "_mad")


def trim_extremes(df: DataFrame, id: str, k: int = 5) -> DataFrame:
    """Rows with an id strictly between the (k+1)-th smallest and the k-th largest distinct id.

    Both bounds are top-k reads; with fewer distinct ids than that no row is between.
    """
    ids = df.select(F.col(id).alias("_id")).where(F.col("_id").isNotNull()).distinct()

    def bound(order, n: int, pick) -> DataFrame:
        return ids.orderBy(order).limit(n).agg(F.when(F.count("_id") == n, pick("_id")))

    low = bound(F.asc("_id"), k + 1, F.max)
    high = bound(F.desc("_id"), k, F.min)
    return df.where((F.col(id) > low.scalar()) & (F.col(id) < high.scalar()))


def ecdf(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, x, y): share of the rows at or below each distinct value."""
    shares = value_shares(df, value, groups)
    return shares.select(*groups, F.col(value).alias("x"),
                         (F.col("upto").cast("double") / F.col("total")).alias("y"))


def cumulative_histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, bin, edge, n, y): equal-width bins between lowest and highest value.

    ``edge`` is the right end of a bin, ``y`` the share of rows up to it. Rows
    are reduced to bin counts before anything is ordered.
    """
    keys = list(groups)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    lo, hi = F.min(value).cast("double"), F.max(value).cast("double")
    # a single value gets a bin range of width 1 around it
    span = rows.groupBy(*keys).agg(
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("_lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("_hi"))
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(bins)).cast("int")
    counts = (
        join_on(rows.select(*keys, value), span, keys)
        .groupBy(*keys, F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = join_on(every, counts, [*keys, "bin"], "left").fillna(0, subset=["n"])
    part = W.partitionBy(*(keys or [F.lit(0)]))  # ``bins`` rows per group
    upto = F.sum("n").over(part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return filled.select(
        *keys, "bin",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / F.lit(float(bins))).alias("edge"),
        "n", (upto.cast("double") / F.sum("n").over(part)).alias("y"))


def fitted_cdf(df: DataFrame, value: str, groups: Sequence[str] = (), step: float = 0.1) -> DataFrame:
    """(groups, i, x, y): normal curve fitted to the values, on the grid 0, step, ... below the maximum.

    ``y`` is the running sum of the curve over its total. The grid is laid out in blocks
    that are dealt to all tasks, so a long one is never made in one place.
    """
    keys, block = list(groups), 10_000
    fit = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys)
        .agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sigma"),
             F.ceil(F.max(value).cast("double") / F.lit(step)).cast("bigint").alias("_points"))
        .where(F.col("_points") > 0)
    )
    last = F.col("_points") - 1
    blocks = fit.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block).cast("bigint"))))
    grid = blocks.repartition(*keys, "_b").withColumn("i", F.explode(F.sequence(
        F.col("_b") * block, F.least(last, F.col("_b") * block + (block - 1)))))
    x = F.col("i").cast("double") * F.lit(step)
    points = grid.select(*keys, "i", x.alias("x"),
                         normal_cdf(F.try_divide(x - F.col("_mu"), F.col("_sigma"))).alias("_p"))
    summed = running_sum(points, keys, "i", F.col("_p"), None, "_upto", "_all")
    return summed.select(*keys, "i", "x", F.try_divide("_upto", "_all").alias("y"))


def error_bars(series: DataFrame, keys: Sequence[str] = ("run", "metric"), y: str = "y", out: str = "err") -> DataFrame:
    """err = mean(y) / sqrt(y) within each series, NULL where y is not positive."""
    means = series.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    err = F.when(F.col(y) > 0, F.col("_mean") / F.sqrt(F.when(F.col(y) > 0, F.col(y))))
    return join_on(series.drop(out), means, list(keys)).withColumn(out, err).drop("_mean")


def box_stats(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, q1, med, q3, whislo, whishi): quartiles and the last values within 1.5 IQR of them.

    All from one count of the distinct values.
    """
    keys = list(groups)
    rows = value_counts(df.select(*keys, F.col(value).cast("double").alias("_x")), "_x", keys)
    quartiles = percentiles_of_counts(rows, "_x", {"q1": 0.25, "med": 0.5, "q3": 0.75}, keys)
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    placed = join_on(rows, quartiles, keys)
    inner = placed.groupBy(*keys, "q1", "med", "q3").agg(
        F.min(F.when(F.col("_x") >= F.col("q1") - reach, F.col("_x"))).alias("_lo"),
        F.max(F.when(F.col("_x") <= F.col("q3") + reach, F.col("_x"))).alias("_hi"))
    return inner.select(
        *keys, "q1", "med", "q3",
        F.least(F.coalesce("_lo", "q1"), "q1").alias("whislo"),
        F.greatest(F.coalesce("_hi", "q3"), "q3").alias("whishi"))


TERMS, WIDTH = 14, 0.5  # of the expansion of a kernel about the middle of its box; of a box, in bandwidths


def density(df: DataFrame, value: str, group: str, members: Sequence, points: int = 100) -> DataFrame:
    """(group, i, x, y): Gaussian kernel density of the listed groups, Scott's bandwidth.

    Linear in the values: a box half as wide as the bandwidth keeps a few moments of the values in it, from which their kernels
    follow at any distance. Cutting the expansion after ``TERMS`` terms changes a kernel by less than 1e-14 of its peak. A box only
    reaches the grid points where kernels are not zero in double precision, so nothing is left out.
    """
    rows = value_counts(df.where(F.col(group).isin(list(members))).select(
        group, F.col(value).cast("double").alias("_v")), "_v", [group]).withColumnRenamed("n", "_n")
    # two passes for the deviation, as the square of the mean may be far larger than it
    mean = rows.groupBy(group).agg(F.sum("_n").alias("_total"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_mean"),
                                   F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    off = (F.col("_v") - F.col("_mean")) * (F.col("_v") - F.col("_mean")) * F.col("_n")
    shape = settle(join_on(rows, mean, [group]).groupBy(group, "_total", "_min", "_max").agg(
        (F.sqrt(F.sum(off) / F.when(F.col("_total") > 1, F.col("_total") - 1))
         * F.pow(F.col("_total").cast("double"), F.lit(-0.2))).alias("_h")).where(F.col("_h") > 0))
    shape = shape.withColumn("_step", (F.col("_max") - F.col("_min")) / F.lit(points - 1))
    place = (F.col("_v") - F.col("_min")) / (F.col("_h") * F.lit(WIDTH))
    boxed = join_on(rows, shape.select(group, "_min", "_h"), [group]).select(
        group, F.floor(place).alias("_box"), ((place - F.floor(place) - F.lit(0.5)) * F.lit(WIDTH)).alias("_b"), "_n")
    # exp(-(a - b)^2 / 2) = exp(-a^2 / 2) * sum over k of a^k * exp(-b^2 / 2) * b^k / k!, from the middle of the box
    weight = F.col("_n") * F.exp(F.col("_b") * F.col("_b") * F.lit(-0.5))
    powers = [weight]
    for _ in range(TERMS - 1):
        powers.append(powers[-1] * F.col("_b"))
    moments = boxed.groupBy(group, "_box").agg(*[
        (F.sum(p) / F.lit(float(math.factorial(k)))).alias(f"_m{k}") for k, p in enumerate(powers)])
    middle = F.col("_min") + (F.col("_box") + F.lit(0.5)) * F.col("_h") * F.lit(WIDTH)
    reach = F.lit(40.0) * F.col("_h")
    first = F.greatest(F.lit(0), F.ceil((middle - reach - F.col("_min")) / F.col("_step")).cast("int"))
    final = F.least(F.lit(points - 1), F.floor((middle + reach - F.col("_min")) / F.col("_step")).cast("int"))
    x = F.col("_min") + F.col("i") * F.col("_step")
    a = (x - middle) / F.col("_h")
    series = F.col(f"_m{TERMS - 1}")
    for k in range(TERMS - 2, -1, -1):
        series = series * F.col("_a") + F.col(f"_m{k}")
    near = join_on(moments, shape, [group]).withColumn("i", F.explode(F.sequence(first, final))).withColumn("_a", a)
    sums = near.groupBy(group, "i").agg(F.sum(F.exp(F.col("_a") * F.col("_a") * F.lit(-0.5)) * series).alias("_s"))
    every = shape.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    norm = F.col("_total") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    return join_on(every, sums, [group, "i"], "left").select(
        group, "i", x.alias("x"), (F.coalesce("_s", F.lit(0.0)) / norm).alias("y"))
