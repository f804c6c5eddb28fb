"""Stored tables laid out by key: joined, grouped and reconciled without moving a row.

A table is written in buckets of its key, sorted within, with one file per bucket. Two tables with the same key and number
of buckets then meet bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to ``path`` as table ``name``, in as many buckets as a shuffle has partitions unless told otherwise.

    A key that holds a large share of the rows makes one large bucket: combine such rows first
    (``reconcile.combinations``).
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the same hash as the buckets': every task writes one bucket, or none
    (df.repartition(n, *keys).write.mode("overwrite").option("path", path)
     .bucketBy(n, *keys).sortBy(*keys).saveAsTable(name))
    return spark.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table that ``save_bucketed`` wrote in another session, under the same or another name."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)
