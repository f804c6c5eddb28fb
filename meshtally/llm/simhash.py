"""SimHash near-duplicates: fingerprints linked through a sharded vantage-point tree.

A tree of vantage points (fingerprints of a bounded sample) cuts Hamming space
into shards: at each node the near half holds what lies within the node's
radius, the far half the rest. A fingerprint has one home shard, and by the triangle
inequality it is also a query in each shard whose boundary lies within ``bits``
of it. Inside a shard the members lie in cells of equal distances to two more
vantage points, and a query compares only with the cells it can reach. Shards
are large, as the tree's upper levels send each query to many of them.

The sample only shapes the tree: every fingerprint is placed and every pair
within ``bits`` is found, whatever the sample was. Shards that hold more than
``block`` members or queries are split into blocks, so no task grows with the
data. Equal fingerprints are one member, so large groups of copies cost nothing.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshtally.llm.common import arrow_map, bounded, free_name
from meshtally.llm.components import Links, components
from meshtally.session import settle

SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text; NULL or no words: 0.

    ASCII letters are lower-cased, words are separated by ASCII white space, shingles
    of ``words`` words count as often as they occur. A bit is set if it is set in
    over half of the shingles' XXH64 values.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        to = min(n, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(
            starts[at:to].tolist(), ends[at + words - 1:to + words - 1].tolist())], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * votes > n)))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """All columns but ``text``, and ``fp`` BIGINT: the fingerprint's 64 bits as a signed number."""
    rest = [c for c in docs.columns if c != "text"]

    def of(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(t, words, seed) for t in batch.column(len(rest)).to_pylist()], "<u8")
        return {**{c: batch.column(i) for i, c in enumerate(rest)}, "fp": pa.array(prints.view("<i8"), pa.int64())}

    schema = StructType([*[docs.schema[c] for c in rest], StructField("fp", LongType())])
    return arrow_map(docs.select(*rest, F.col("text").cast("binary")), of, schema)


class VantageTree:
    """Vantage points and radii in heap order; leaves are the shards."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.points = np.zeros(max(1, (1 << depth) - 1), np.uint64)
        self.radii = np.full(len(self.points), 32, np.int64)
        members = {0: sample}
        for node in range((1 << depth) - 1):
            own = members.pop(node, sample[:0])
            if len(own):
                # of a few members, the one that spreads the others most makes the sharpest cut
                few = own[:: max(1, len(own) // 8)][:8]
                spread = [np.bitwise_count(own ^ p).astype(np.int64) for p in few]
                best = int(np.argmax([d.std() for d in spread]))
                self.points[node], d = few[best], spread[best]
                self.radii[node] = int(np.median(d))
                near = d <= self.radii[node]
                members[2 * node + 1], members[2 * node + 2] = own[near], own[~near]

    def shards(self, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): each fingerprint's home shard, and the later shards within its reach.

        A pair across two shards is found in the later one, where the other is a query.
        """
        row, node = np.arange(len(prints)), np.zeros(len(prints), np.int64)
        home = np.ones(len(prints), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(prints[row] ^ self.points[node]).astype(np.int64)
            near = d <= self.radii[node]
            # |d(x, v) - d(y, v)| <= d(x, y): the other side can hold partners only near the radius
            other = np.where(near, d + bits > self.radii[node], d - bits <= self.radii[node])
            row, node, home = (
                np.concatenate((row, row[other])),
                np.concatenate((2 * node + 2 - near, 2 * node[other] + 1 + near[other])),
                np.concatenate((home, np.zeros(int(other.sum()), bool))))
        own = np.zeros(len(prints), np.int64)
        own[row[home]] = node[home]
        later = home | (node > own[row])
        return row[later], node[later] - ((1 << self.depth) - 1), home[later]


def link_within(members: np.ndarray, queries: np.ndarray, bits: int, among: bool = True) -> np.ndarray:
    """Spanning links (n, 2) at most ``bits`` apart: of queries with members, and ``among`` members."""
    items = np.concatenate((members, queries))
    n = len(members)
    links = Links(len(items))
    if n:
        # cells of equal distances to two vantage points; partners lie at most ``bits`` cells away in each
        far = members[np.argmax(np.abs(np.bitwise_count(members ^ members[0]).astype(np.int64) - 32) < 2)]
        cell = np.bitwise_count(items ^ members[0]).astype(np.int64) * 65 + np.bitwise_count(items ^ far)
        order = np.argsort(cell[:n], kind="stable")
        starts = np.searchsorted(cell[:n][order], np.arange(65 * 65 + 1))
        probes = np.arange(0 if among else n, len(items))
        probes = probes[np.argsort(cell[probes], kind="stable")]
        kinds, first = np.unique(cell[probes], return_index=True)
        for c, own in zip(kinds.tolist(), np.split(probes, first[1:])):
            x, y = divmod(c, 65)
            ring = np.concatenate([
                order[starts[r * 65 + max(0, y - bits)]:starts[r * 65 + min(64, y + bits) + 1]]
                for r in range(max(0, x - bits), min(64, x + bits) + 1)])
            step = max(1, (1 << 19) // max(1, len(ring)))
            held = items[ring]
            for i in range(0, len(own), step):
                q, t = np.nonzero(np.bitwise_count(items[own[i:i + step], None] ^ held) <= bits)
                links.add(own[i + q], ring[t])
    return items[links.pairs()]


def near_links(prints: DataFrame, bits: int = 4, block: int = 32_768, sample: int = 20_000,
               most_shards: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at most ``bits`` apart.

    They connect the same fingerprints as all such pairs would; within a task, pairs that
    add no connection are left out. ``sample`` bounds the fingerprints that shape the tree,
    ``most_shards`` its leaves. Shards are cut into tasks of about ``block`` members and
    8 * ``block`` queries, whatever they hold.
    """
    count = prints.count()
    depth = min(int(math.log2(most_shards)), max(0, math.ceil(math.log2(max(1, count / block)))))
    shape = np.array([r[0] for r in bounded(prints.select("fp"), "fp", sample).collect()], np.int64).view(np.uint64)
    tree = VantageTree(shape, depth)

    def place(batch: pa.RecordBatch) -> dict:
        own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        row, shard, home = tree.shards(own, bits)
        return {"shard": pa.array(shard), "home": pa.array(home), "fp": pa.array(own[row].view(np.int64))}

    placed = settle(arrow_map(prints.select("fp"), place, "shard bigint, home boolean, fp bigint"))
    sizes = {(r[0], r[1]): r[2] for r in placed.groupBy("shard", "home").count().collect()}  # bounded by the leaves
    rows = []
    for s in {s for s, _ in sizes}:
        m = math.ceil(sizes.get((s, True), 0) / block)
        asks = sizes.get((s, False), 0) + (sizes[s, True] if m > 1 else 0)
        rows.append((s, m, max(1, math.ceil(asks / (8 * block)))))
    plan = prints.sparkSession.createDataFrame(rows, "shard bigint, m int, q int")

    spread = F.shiftrightunsigned(F.xxhash64("fp"), 1)
    parts = placed.join(F.broadcast(plan), "shard").where("m > 0").withColumn(
        "i", (spread % F.col("m")).cast("int")).withColumn("j", (F.floor(spread / F.col("m")) % F.col("q")).cast("int"))
    members = parts.where("home").select(
        "shard", "i", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(True).alias("member"), "fp")
    # members are also queries of the shard's other blocks, each pair in one of them
    queries = parts.where("not home or m > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).where(
        "not home or i < k").select("shard", F.col("k").alias("i"), "j", F.lit(False).alias("member"), "fp")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        own = table.column("fp").to_numpy().view(np.uint64)
        links = link_within(own[member], own[~member], bits, among=key[2].as_py() == 0).view(np.int64)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    return members.unionByName(queries).groupBy("shard", "i", "j").applyInArrow(solve, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, bits: int = 4, block: int = 32_768,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, fp, component_id) per row of ``docs`` (doc_id, text; other columns are ignored).

    Rows with fingerprints at most ``bits`` apart are linked; component_id is the
    smallest doc_id reachable. Rows without words have fingerprint 0 and link like any
    other. A NULL doc_id keeps its row and is never the smallest, unless its component has
    no other id: then NULL. Repeated rows stay repeated. No rows give none.
    """
    prints = settle(fingerprints(docs.select("doc_id", *carry, "text"), words, seed))
    # copies meet in one row per fingerprint before anything is compared
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(settle(near_links(classes, bits, block)))
    members = classes.join(linked, classes.fp == linked.node, "left")
    least = settle(members.where("root is not null").groupBy("root").agg(F.min("first").alias("least")))
    of_print = settle(members.join(least, "root", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    return prints.join(of_print, "fp", "left").select("doc_id", *carry, "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component, its smallest doc_id.

    Of repeated rows with that id one stays. A row with a NULL doc_id stays only where its
    component has no other id.
    """
    key = free_name(docs, "text_hash")
    marked = docs.withColumn(key, F.xxhash64("text"))
    same = near_duplicates(marked, carry=(key,), **options)
    stay = settle(same.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id"), F.col(key).alias("_hash")).distinct())
    rank = free_name(docs, "rank")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_hash"))
    kept = marked.join(stay, on, "left_semi")
    order = W.partitionBy("doc_id", key).orderBy(key)
    return kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank, key)
