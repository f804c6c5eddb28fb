"""Stored tables: parsed logs, scalar metrics, result series, scenario documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.sources.store import Store

SERIES_SCHEMA = (
    "run string, metric string, kind string, pos bigint, x string, x_num double, "
    "y double, err double, xlabel string, ylabel string"
)
METRICS_SCHEMA = "run string, name string, value double"


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all (one aggregate over the table)."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c] > 0])


def write_csv(df: DataFrame, path: str) -> None:
    """Intermediate table as quoted CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def save_tables(tables: Mapping[str, DataFrame], path: str, run: str) -> None:
    """Store the tables of one run; saving it again replaces only that run, as a whole.

    A run's name is data, not a folder: any text is one.
    """
    for name, df in tables.items():
        key = df.sparkSession.createDataFrame([(run,)], "run string")
        Store(df.sparkSession, f"{path}/{name}", ["run"]).put(df.drop("run").withColumn("run", F.lit(run)), key)


def load_table(spark: SparkSession, path: str, name: str, runs: Sequence[str] | None = None) -> DataFrame:
    """One table over all saved runs, or over ``runs`` (only the saves that hold them are read)."""
    found = Store(spark, f"{path}/{name}", ["run"]).read(runs)
    if found is None:
        raise FileNotFoundError(f"no table {name} under {path}")
    return found


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Store scalar results (run, name, value); a run's metric saved again replaces the one before."""
    Store(metrics.sparkSession, path, ["run", "name"]).put(metrics.select("run", "name", "value"))


def load_metrics(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    found = Store(spark, path, ["run", "name"]).read(runs)
    return spark.createDataFrame([], METRICS_SCHEMA) if found is None else found.select("run", "name", "value")


def _series_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, ["metric", "run"], ["metric", "run"])


def save_series(series: DataFrame, path: str) -> None:
    """Store series by metric and run; only the runs written are replaced, all in one commit.

    Range partitioning keeps few files per folder and still splits a run that
    holds a large share of the points.
    """
    _series_store(series.sparkSession, path).put(series.repartitionByRange("metric", "run", "pos"))


def load_series(spark: SparkSession, path: str) -> DataFrame:
    empty = spark.createDataFrame([], SERIES_SCHEMA)
    found = _series_store(spark, path).read()
    return empty if found is None else found.select(*empty.columns)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario file: ``file``, ``xml``."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml"))
    )


def element_count(docs: DataFrame, xml: str = "xml", xpath: str = "/simconf/simulation/mote",
                  out: str = "n") -> DataFrame:
    """Number of elements at ``xpath`` in every document."""
    return docs.withColumn(out, F.xpath_int(F.col(xml), F.lit(f"count({xpath})")))
