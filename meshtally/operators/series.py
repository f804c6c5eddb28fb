"""Result series and their comparison between runs.

A series is what a plot would show: one row per point, in the long form of
``sources.tables.SERIES_SCHEMA``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.functions.maths import first_integer
from meshtally.operators.ranks import join_on, modes, numbered, percentiles

COLUMNS = ["run", "metric", "kind", "pos", "x", "x_num", "y", "err", "xlabel", "ylabel"]


def to_series(df: DataFrame, run: str | Column, metric: str | Column, kind: str, x: str, y: str,
              xlabel: str = "", ylabel: str = "", err: str | None = None, pos: str | None = None,
              number: bool = True) -> DataFrame:
    """Points from a metric table. Numeric x values are labelled as whole numbers.

    Points are numbered by x unless ``pos`` names their order. Numbering reads
    ``df`` twice, so a costly one should be settled first; without ``number`` pos
    stays NULL, for several series that ``number_points`` numbers at once.
    """
    numeric = dict(df.dtypes)[x] != "string"
    label = F.col(x).cast("bigint").cast("string") if numeric and kind == "bar" else F.col(x).cast("string")
    out = df.select(
        (F.lit(run) if isinstance(run, str) else run).alias("run"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        F.lit(kind).alias("kind"), label.alias("x"),
        (F.col(x).cast("double") if numeric else F.lit(None).cast("double")).alias("x_num"),
        F.col(y).cast("double").alias("y"),
        (F.col(err) if err else F.lit(None)).cast("double").alias("err"),
        F.lit(xlabel).alias("xlabel"), F.lit(ylabel).alias("ylabel"),
        (F.col(pos) if pos else F.lit(None)).cast("bigint").alias("pos"))
    return (out if pos or not number else number_points(out)).select(*COLUMNS)


def number_points(series: DataFrame) -> DataFrame:
    """Number the points of each series by x, numbers before texts, except where pos is given."""
    return numbered(series, ["run", "metric"], "x_num", "x", "_n").withColumn(
        "pos", F.coalesce("pos", "_n")).select(*COLUMNS)


def lookup(series: DataFrame, runs: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The series of the wanted runs and metrics; raises if a pair is missing.

    Filters on run and metric are partition filters on a stored series table.
    """
    found = series.where(F.col("run").isin(list(runs)) & F.col("metric").isin(list(metrics)))
    absent = missing(found, runs, metrics).collect()  # of the caller's own lists
    if absent:
        pairs = ", ".join(f"{r['metric']} of {r['run']}" for r in absent)
        raise LookupError(f"no stored series for: {pairs}")
    return found


def missing(found: DataFrame, runs: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(run, metric) pairs that were asked for and are not there."""
    wanted = found.sparkSession.createDataFrame(
        [(r, m) for m in metrics for r in runs], "run string, metric string")
    return wanted.join(found.select("run", "metric").distinct(), ["run", "metric"], "left_anti")


def align(series: DataFrame, runs: Sequence[str]) -> DataFrame:
    """(metric, x, x_num, run, y): every x value with a row per listed run, 0 where a run has none.

    The runs come from the caller's short list, so the grid is as long as the result.
    """
    points = series.where(F.col("run").isin(list(runs)))
    grid = (
        points.groupBy("metric", "x").agg(F.max("x_num").alias("x_num"))
        .withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))
    )
    return (
        join_on(grid, points.select("metric", "x", "run", "y"), ["metric", "x", "run"], "left")
        .select("metric", "x", "x_num", "run", F.coalesce("y", F.lit(0.0)).alias("y"))
    )


def run_id(run: str | Column = "run") -> Column:
    """First whole number in a run's name as text, else the name."""
    name = F.col(run) if isinstance(run, str) else run
    return F.coalesce(first_integer(name).cast("string"), name)


def concatenate(series: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Join the series of all runs with one id end to end, runs in order of their names.

    Only the lengths of the runs are summed in order; points then shift by a join.
    """
    keys = list(keys)
    points = series.withColumn("id", run_id())
    lengths = points.groupBy(*keys, "id", "run").agg(F.count(F.lit(1)).alias("_len"))
    w = W.partitionBy(*keys, "id").orderBy("run").rowsBetween(W.unboundedPreceding, 0)
    starts = lengths.withColumn("_start", F.sum("_len").over(w) - F.col("_len")).drop("_len")
    return (
        join_on(points, starts, [*keys, "id", "run"])
        .select(*keys, "id", "run", (F.col("_start") + F.col("pos")).alias("pos"), "x", "x_num", "y", "err")
    )


def compare(series: DataFrame, runs: Sequence[str], metrics: Sequence[str], check: bool = True) -> DataFrame:
    """(metric, kind, id, label, pos, x, y, err): the wanted runs side by side.

    Bars are aligned on x, lines of one id are joined, histograms, boxes and
    any other kind stay as they are.
    """
    found = lookup(series, runs, metrics) if check else series.where(
        F.col("run").isin(list(runs)) & F.col("metric").isin(list(metrics)))
    bars = found.where(F.col("kind") == "bar")
    aligned = align(bars, runs)
    order = bars.groupBy("metric", "x").agg(F.min("pos").alias("pos"))
    shown = ["metric", "kind", "id", "label", "pos", "x", "y", "err"]
    nothing = F.lit(None).cast("double")
    bar = join_on(aligned, order, ["metric", "x"]).select(
        "metric", F.lit("bar").alias("kind"), run_id().alias("id"), F.col("run").alias("label"),
        "pos", "x", "y", nothing.alias("err"))
    line = concatenate(found.where(F.col("kind") == "line")).select(
        "metric", F.lit("line").alias("kind"), "id", F.col("run").alias("label"),
        "pos", "x", "y", "err")
    rest = found.where(~F.col("kind").isin("bar", "line")).select(
        "metric", "kind", run_id().alias("id"), F.col("run").alias("label"),
        "pos", "x", "y", "err")
    return bar.select(*shown).unionByName(line.select(*shown)).unionByName(rest.select(*shown))


def clip_labels(series: DataFrame, ylim: float, y: str = "y", out: str = "label") -> DataFrame:
    """The rounded-up height where it exceeds the axis limit, else NULL."""
    top = F.ceil(F.col(y))
    return series.withColumn(out, F.when(top > ylim, top.cast("bigint")))


def summarise(series: DataFrame, keys: Sequence[str] = ("run", "metric")) -> DataFrame:
    """(keys, mean, median, mode) of y; the smallest value on mode ties."""
    keys = list(keys)
    means = series.groupBy(*keys).agg(F.avg("y").alias("mean"))
    middle = percentiles(series, "y", {"median": 0.5}, keys)
    often = modes(series.where(F.col("y").isNotNull()), keys, ["y"]).withColumnRenamed("y", "mode")
    return join_on(join_on(means, middle, keys, "left"), often, keys, "left").select(*keys, "mean", "median", "mode")


def sweep(metrics: DataFrame, runs: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(run, one column per metric name) for the listed runs."""
    return (
        metrics.where(F.col("run").isin(list(runs)) & F.col("name").isin(list(names)))
        .groupBy("run").pivot("name", list(names)).agg(F.max("value"))
    )
