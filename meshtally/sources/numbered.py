"""Logs with true line numbers, whatever the splits.

A task that reads part of a file cannot know how many lines stand before it. So the lines are laid out once, in
columns, with the offset of their split; lines are counted per split, counts of the splits before are added
up, and each line gets its split's start plus its place there. The numbers depend on the files
alone, and the text is read once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.operators.ranks import running_sum
from meshtally.session import settle


@contextmanager
def _split_size(spark: SparkSession, split_bytes: int | None) -> Iterator[None]:
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if split_bytes is not None:
        spark.conf.set(name, str(split_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_numbered(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
                  split_bytes: int | None = None) -> DataFrame:
    """Lines of one or more logs: ``value``, ``file`` and ``line``, which counts from 1 in every file.

    Empty lines count. ``split_bytes`` sets the size of splits for this read only; the result does not depend on it.
    Compressed files are one split each. Files that change while they are read have no defined numbers.
    """
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    with _split_size(spark, split_bytes):
        # ids rise by one from line to line of a split
        laid = settle(text.withColumn("_id", F.monotonically_increasing_id()))
    splits = settle(laid.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")))
    # one row per split: small against the lines, so the planner decides how to join from what was written
    starts = settle(running_sum(splits, ["file"], "_block", F.col("_n"), None, "_upto").select(
        "file", "_block", (F.col("_upto") - F.col("_n") - F.col("_first") + 1).alias("_shift")))
    return laid.join(starts, ["file", "_block"]).select("value", "file", (F.col("_id") + F.col("_shift")).alias("line"))
