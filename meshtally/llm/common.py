"""What several operators share: session set-up, Arrow map stages, bounded samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])
# Rows per Arrow batch: texts may be long, so batches stay small.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and keep Arrow batches small, in the caller's session."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """Map each Arrow batch to columns; ``schema`` names and types what comes out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch))

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows whose value in ``column`` is kept; every column passes unchanged, whatever its name."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of a key's decimal text, modulo ``n``; NULL keys count as the text 'null'."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % n


def bounded(df: DataFrame, by: str, limit: int, *salt: Column) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``by``: the same rows on every run."""
    return df.orderBy(F.xxhash64(by, *salt), by).limit(limit)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` with as many leading underscores as make it new to ``df``."""
    name, taken = f"_{wanted}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sample(df: DataFrame, n: int, by: str) -> DataFrame:
    """About ``n`` rows of ``df``, at most 2 * ``n``, chosen by a hash of ``by``: the same on every run."""
    count = df.select(by).count()
    share = F.shiftrightunsigned(F.xxhash64(by, F.lit(7)), 11) / float(1 << 53)
    return bounded(df.where(share < n / max(1, count)), by, 2 * n)
