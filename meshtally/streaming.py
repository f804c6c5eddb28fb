"""Packets from logs that are still being written, with Structured Streaming.

Lines are parsed as they come; events are kept per packet until the watermark, which follows the clock in the log, has passed
the packet's last event by ``wait``. Then the packet is complete and is given out once, with the status and
latency that the batch way gives. Spark counts events that come later than that (``late_events``) and leaves them out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.functions.packets import status_by_receipt
from meshtally.operators.formats import keyed_sdn
from meshtally.operators.reconcile import STATES
from meshtally.sources.logs import parse


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New text files of a folder as a stream of lines."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def stream_events(lines: DataFrame, pattern: str = "sdn", wait: str = "1 minute") -> DataFrame:
    """Keyed packet events with a watermark on the log's own clock."""
    events = keyed_sdn(parse(lines, pattern))
    return events.where(F.col("time").isNotNull()).withColumn("at", F.timestamp_micros("time")).withWatermark("at", wait)


def _counts() -> list[Column]:
    return [F.count_if(F.col("state") == s).alias(c) for c, s in STATES.items()]


def stream_packets(events: DataFrame, wait: str = "1 minute", by: Sequence[str] = ()) -> DataFrame:
    """One row per packet as soon as nothing more can come for it: counts, status, hops, latency in ms.

    A packet's events form a session: those less than ``wait`` apart. State is the counts and two times per open packet, in
    Spark's state store; it goes when the watermark passes. A key used again after that is a packet of its own.
    """
    sessions = events.groupBy(*by, "packet", F.session_window("at", wait).alias("session")).agg(
        *_counts(), F.max("hops").alias("hops"), F.min("time").alias("_first"), F.max("time").alias("_last"))
    spent = (F.col("_last") - F.col("_first")).cast("double") / F.lit(1e3)
    rows = sessions.withColumn("received", status_by_receipt())
    return rows.select(*by, "packet", *STATES, "received", "hops",
                       F.when(F.col("received") == "correct", spent).otherwise(F.lit(0.0)).alias("lat"),
                       F.timestamp_micros("_first").alias("mintime"), F.timestamp_micros("_last").alias("maxtime"))


def late_events(query) -> int:
    """Rows that came after the watermark so far, summed over a query's progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
