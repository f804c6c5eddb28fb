"""Even shards by sampled splitters, in DataFrame functions only.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts lie
side by side and a group of any size can still be cut. A bounded sample, drawn
with chances in proportion to the rows' sizes, gives the quantiles of that
order as splitters; every row goes to the range between two of them, and ranges
that turn out overfull are subdivided by a sample of their own. With the exact
sums of all ranges and running sums inside each range, every row knows how many
bytes lie before it, and from that its shard.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.session import settle

KEY = ("hash", "doc_id", "row")
PER_RANGE = 16  # sampled keys for each range


def _sampled(rows: DataFrame, wanted: int) -> list[tuple]:
    """At most ``wanted`` keys in order, drawn without replacement, chances in proportion to ``weight``.

    A row's draw is a hash of its number, so a repeated task draws the same.
    """
    share = (F.shiftrightunsigned(F.xxhash64("row"), 11) + 0.5) / float(1 << 53)
    drawn = rows.select(*KEY, (-F.log(share) / F.col("weight")).alias("draw")).orderBy("draw", "row").limit(wanted)
    keys = [tuple(r[c] for c in KEY) for r in drawn.collect()]
    return sorted(keys, key=_order)


def _order(key: tuple) -> tuple:
    return tuple((v is not None, v) for v in key)


def _range_of(rows: DataFrame, splitters: list[tuple]) -> Column:
    """How many splitters lie below a row's key: first among every n-th, then among the n after it."""
    kinds = [dict(rows.dtypes)[c] for c in KEY]
    kind = "array<struct<" + ",".join(f"{c}:{k}" for c, k in zip(KEY, kinds)) + ">>"
    step = max(1, math.isqrt(len(splitters)))

    def constant(keys: list[tuple]) -> Column:
        return F.from_json(F.lit(json.dumps([dict(zip(KEY, k)) for k in keys])), kind)

    coarse, fine = constant(splitters[step - 1::step]), constant(splitters)
    key = F.struct(*KEY)
    first = F.size(F.filter(coarse, lambda s: s < key)) * step
    return first + F.size(F.filter(F.slice(fine, first + 1, step), lambda s: s < key))


def shards(df: DataFrame, count: int = 8, law: str = "bytes", rows_per_range: int = 500_000,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *keep) for every row of ``df``.

    ``df`` has doc_id and text; of its other columns only those in ``keep`` are read and
    returned. law ``bytes``: shard sizes differ by no more than about one row's size; ``rows``: row counts differ
    by at most one. size is the text's UTF-8 bytes plus 1, NULL text counting as empty (also
    for the checksum). NULL ids come first among equal texts; repeated rows are separate rows. slot numbers a
    shard's rows from 0 without gaps. grown_shard is NULL: these laws move rows when a shard
    is added. No rows give none. Ranges hold about ``rows_per_range`` rows however many there are.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law {law!r} is neither bytes nor rows")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(1).cast("bigint")).alias("size")
    light = settle(df.select(
        "doc_id", F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), size,
        F.crc32(text.cast("binary")).alias("text_crc32"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept")))
    light = light.withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("bigint"))
    rows, total = light.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wanted = max(8 * count, math.ceil(rows / rows_per_range))
    splitters = _sampled(light, PER_RANGE * wanted)[PER_RANGE - 1::PER_RANGE] if rows else []
    sums: dict[int, tuple[int, int]] = {}
    while True:
        ranged = light.withColumn("range", _range_of(light, splitters))
        sums = {r[0]: (r[1], r[2]) for r in
                ranged.groupBy("range").agg(F.count(F.lit(1)), F.sum("weight")).collect()}  # bounded by the splitters
        over = [k for k, (n, w) in sums.items()
                if n > 1 and max(n / max(rows, 1), w / max(total, 1)) > 4 / wanted and n > 1000]
        if not over:
            break
        more = _sampled(ranged.where(F.col("range").isin(over)), PER_RANGE * 4 * len(over))
        new = [k for k in more[PER_RANGE - 1::PER_RANGE] if k not in splitters]
        if not new:
            break
        splitters = sorted([*splitters, *new], key=_order)

    before, n, w = [], 0, 0
    for k in range(len(splitters) + 1):
        before.append((k, n, w))
        n, w = n + sums.get(k, (0, 0))[0], w + sums.get(k, (0, 0))[1]
    starts = df.sparkSession.createDataFrame(before, "range int, rows_before bigint, weight_before bigint")
    inside = W.partitionBy("range").orderBy(*KEY)
    placed = (
        ranged.withColumn("_n", F.row_number().over(inside) - 1)
        .withColumn("_w", F.sum("weight").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight"))
        .join(F.broadcast(starts), "range")  # one row for each range
        .withColumn("_n", F.col("_n") + F.col("rows_before"))
        .withColumn("_w", F.col("_w") + F.col("weight_before")))
    # a row lies where its middle lies; in whole numbers, so that every task agrees
    middle = F.expr(f"div(cast(2 * _w + weight as decimal(38, 0)) * {count}, {max(1, 2 * total)})")
    if law == "rows":
        middle = F.expr(f"div(cast(_n as decimal(38, 0)) * {count}, {max(1, rows)})")
    placed = settle(placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"),
                                  middle.cast("int").alias("shard"), "_n", "kept"))
    first = placed.groupBy("shard").agg(F.min("_n").alias("_first"))  # one row for each shard
    out = placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_n") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col("kept")[c].alias(c) for c in keep])
    return out


def write_shards(df: DataFrame, path: str, count: int = 8, law: str = "bytes") -> None:
    """Write the texts of ``df`` as Parquet below ``path``, one folder for each shard."""
    shards(df, count, law, keep=("text",)).write.partitionBy("shard").parquet(path)
