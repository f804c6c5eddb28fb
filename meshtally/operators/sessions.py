"""Keys that are used again: each key's rows are parted where a long time lies between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.operators.ranks import join_on
from meshtally.session import settle


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: int, tie: Sequence[str] = (),
             out: str = "session") -> DataFrame:
    """Add the number of each row's session within its key, from 0; a new one begins more than ``gap`` after the row before.

    Rows are laid out in ranges of (keys, time, ``tie``) and numbered inside each; what stands before a range is
    carried over for the few keys that cross its edge, so a key of any size is shared by many tasks. NULL keys are a key; a
    row without a time opens its key's order and starts no session, nor does the one after it.
    """
    by = [*keys, time, *tie]
    laid = settle(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_part").orderBy(time, *tie)
    late = F.col(time) - F.lag(time).over(inside) > gap
    marked = laid.withColumn("_new", F.coalesce(late, F.lit(False)).cast("int"))
    numbered = marked.withColumn("_inside", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # a key that crosses an edge is the last of some part: at most one per part
    last = laid.groupBy("_part").agg(F.max(F.struct(*keys)).alias("_k")).select("_k.*").distinct()
    edges = join_on(laid.select(*keys, "_part", time, *tie), last, keys, "left_semi")
    own = W.partitionBy(*keys, "_part").orderBy(time, *tie)
    spans = edges.withColumn("_new", F.coalesce(F.col(time) - F.lag(time).over(own) > gap, F.lit(False)).cast("int")).groupBy(
        *keys, "_part").agg(F.min(time).alias("_from"), F.max(time).alias("_to"), F.sum("_new").alias("_n"))
    parts = W.partitionBy(*keys).orderBy("_part")  # one row per part that holds the key
    before = parts.rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce(F.col("_from") - F.max("_to").over(before) > gap, F.lit(False)).cast("int")
    starts = spans.withColumn("_open", opens).select(*keys, "_part", (
        F.coalesce(F.sum(F.col("_n") + F.col("_open")).over(before), F.lit(0)) + F.col("_open")).alias("_start"))
    res = join_on(numbered, settle(starts), [*keys, "_part"], "left")
    return res.withColumn(out, (F.col("_inside") + F.coalesce("_start", F.lit(0))).cast("bigint")).drop(
        "_part", "_new", "_inside", "_start")


def part_reused(events: DataFrame, gap_us: int, key: str = "id", names: Sequence[str] = ("packet", "id"), time: str = "time",
                by: Sequence[str] = ()) -> DataFrame:
    """Events whose keys are unique again: ``#n`` is put after ``names`` from a key's second session on.

    Sequence numbers start over when a node reboots or its counter wraps; without this such packets would
    be one. ``key`` is the exchange, so that a request and its answer stay together.
    """
    numbered = sessions(events, [*by, key], time, gap_us)
    mark = F.when(F.col("session") > 0, F.concat(F.lit("#"), F.col("session").cast("string"))).otherwise("")
    return numbered.withColumns({c: F.concat(c, mark) for c in names}).drop("session")
