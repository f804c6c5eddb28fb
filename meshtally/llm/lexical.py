"""Exact ranked lexical search over bit-sliced Bloom signatures.

**Index.** Documents stand in blocks of some hundred, those with similar numbers of terms together. A block is a
bit matrix: a row per signature position, a column per document. A document sets, for each of its terms,
three positions, and three more for each level of repetition the term reaches (2, 3, 5, 9, ... occurrences). The width of a
block's signatures follows from its fullest document. Beside the blocks stand the documents per term.

**Search.** The three rows of a term and level, put together by AND, are a bitmap that holds every document with that
term so often, and few others. Levels bound the occurrences from above, so the weighted sum over an
item's bitmaps is an upper bound of every document's score. The documents with the highest bounds are
scored from their texts; the tenth of these scores is a floor. Every document whose bound is not below
the floor is then scored exactly: nothing else can be among the first ten.

Items go in batches of bounded size; documents are only ever read in place, never gathered.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.session import settle

LETTERS = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS else 32 for b in range(256))
LEVELS = [1] + [2**i + 1 for i in range(40)]  # occurrences a term must have to reach each level
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
BITS = 12  # signature positions per entry of the fullest document of a block, at least
BLOCK, ROWS, BYTES = 512, 4096, 16 << 20  # documents of a block; documents and bytes of text taken together
BATCH = 128 << 10  # bytes of items searched for together
KNOWN = 1 << 20  # hashes of terms that a task remembers


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and whatever is not ASCII; A-Z become a-z."""
    return text.translate(FOLD).split()


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[term] = h = xxhash.xxh3_64_intdigest(term)
        return h


def positions(hashes: np.ndarray, level: np.ndarray, width: int) -> np.ndarray:
    """(entries, 3): the signature rows of each term at each level; ``width`` is a power of two."""
    mixed = hashes ^ ((level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    mixed ^= mixed >> np.uint64(32)
    spread = mixed[:, None] * ODD[None, :]
    return ((spread >> np.uint64(24)) & np.uint64(width - 1)).astype(np.int64)


def _signature(docs: list[tuple[np.ndarray, np.ndarray]], entries: np.ndarray) -> tuple[int, bytes]:
    """(width, rows): the bit matrix of documents given by the hashes of their terms and how often each occurs."""
    width = 1 << max(6, int(BITS * int(entries.max()) - 1).bit_length())
    columns = -(-len(docs) // 8)
    bits = np.zeros((width, columns), np.uint8)
    for at, (hashes, tf) in enumerate(docs):
        for level, least in enumerate(LEVELS):
            reach = hashes[tf >= least]
            if not len(reach):
                break
            bits[positions(reach, np.full(len(reach), level), width).ravel(), at >> 3] |= 1 << (at & 7)
    return width, bits.tobytes()


@dataclass
class Index:
    """Folders of block signatures and of documents per term; n documents with ``length`` terms in all."""

    blocks: DataFrame
    words: DataFrame
    n: int
    length: int


def _keyed(df: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows with a text; equal rows have equal keys."""
    return df.where(F.col("text").isNotNull()).select(
        F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("text").cast("binary").alias("text"))


def build_index(df: DataFrame) -> Index:
    """One pass over the texts; the index goes to the shared folder."""
    schema = ("kind string, keys array<bigint>, n array<bigint>, most array<bigint>, width bigint, bits binary, "
              "terms array<binary>, df array<bigint>, docs bigint, length bigint")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.binary(), pa.list_(pa.binary()),
             pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def rows(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([values.get(name)], kind) for name, kind in zip(names, types)], names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        # of each document its entries, key, number of terms, most occurrences, hashes of its terms and how often each occurs
        held: list[tuple[int, int, int, int, np.ndarray, np.ndarray]] = []
        per_term: Counter = Counter()
        size = 0

        def take(key: int, found: list[bytes]) -> None:
            counts = Counter(found)
            per_term.update(counts.keys())
            tf = np.fromiter(counts.values(), np.int32, len(counts))
            hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
            most = int(tf.max())
            entries = len(tf) + sum(int((tf >= least).sum()) for least in LEVELS[1:1 + most.bit_length()])
            held.append((entries, key, len(found), most, hashes, tf))

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda d: (d[0], d[1]))
            at = 0
            while at < len(held):
                # fewer documents where signatures are long
                count = min(BLOCK, max(8, (1 << 27) // (2 * BITS * held[min(at + BLOCK, len(held)) - 1][0])))
                some = held[at:at + count]
                at += count
                width, bits = _signature([d[4:] for d in some], np.array([d[0] for d in some]))
                yield rows(kind="blocks", keys=[d[1] for d in some], n=[d[2] for d in some],
                           most=[d[3] for d in some], width=width, bits=bits)
            yield rows(kind="words", terms=list(per_term), df=list(per_term.values()),
                       docs=len(held), length=sum(d[2] for d in held))
            held.clear()
            per_term.clear()

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1)):
                text = text.as_py()
                if found := terms(text):
                    take(key, found)
                    size += len(text)
                if len(held) >= ROWS or size >= BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    made = settle(_keyed(df).select("key", "text").mapInArrow(of, schema))
    words = made.where("kind = 'words'").select("terms", "df", "docs", "length")
    n, length = words.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return Index(made.where("kind = 'blocks'").select("keys", "n", "most", "width", "bits"), words, n, length)


@dataclass
class Batch:
    """Items searched for together: their distinct terms with weights, and per item its terms and how often."""

    items: list[tuple[object, list[int], list[int]]] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, item_id: object, text: bytes) -> None:
        counts = Counter(terms(text))
        self.items.append((item_id, [self.terms.setdefault(t, len(self.terms)) for t in counts], list(counts.values())))


def batches(items: DataFrame) -> Iterator[Batch]:
    """The items (item_id, text) in batches of some hundred kilobytes, each read by itself."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = size // BATCH + 1
    for part in range(parts):
        batch = Batch()
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part
        for item_id, text in items.where(F.col("text").isNotNull() & mine).select(
                "item_id", F.col("text").cast("binary")).collect():
            batch.add(item_id, bytes(text))
        if batch.terms:
            yield batch


def weigh(batch: Batch, index: Index) -> None:
    """Weights of the batch's terms from the documents that hold them."""
    mine = index.words.sparkSession.createDataFrame([(bytearray(t),) for t in batch.terms], "term binary")
    # the terms of a batch come from ``BATCH`` bytes of items: small enough for every task
    found = index.words.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(
        F.col("x.terms").alias("term"), F.col("x.df").alias("df")).join(F.broadcast(mine), "term", "left_semi").groupBy(
        "term").agg(F.sum("df").alias("df"))
    df = {bytes(r["term"]): r["df"] for r in found.collect()}  # at most the terms of the batch
    batch.weight = np.array([
        math.floor(1000 * math.log((2 * index.n + 2) / (2 * df.get(t, 0) + 1))) for t in batch.terms], np.int64)


def damping(n, total: int, length: int):
    """The part of a document's length in the score; ``n`` may be an array."""
    return 100 - 75 + (75 * n * total) // length


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Block by block: a row may hold megabytes."""
    for part in parts:
        for i in range(part.num_rows):
            yield part.slice(i, 1).to_pylist()[0]


def bounds(block: dict, batch: Batch, hashes: np.ndarray, total: int, length: int) -> np.ndarray:
    """(items, documents of the block): no score is above its bound."""
    docs = len(block["keys"])
    rows = np.frombuffer(block["bits"], np.uint8).reshape(block["width"], -1)
    most = np.array(block["most"], np.int64)
    m = damping(np.array(block["n"], np.int64), total, length)
    share = np.empty((len(hashes), docs), np.int64)
    for start in range(0, len(hashes), 1024):
        own = hashes[start:start + 1024]
        often = np.zeros((len(own), docs), np.int64)  # upper bound of the occurrences
        alive, holds = np.arange(len(own)), None
        for level, least in enumerate(LEVELS):
            if least > most.max() or not len(alive):
                break
            at = positions(own[alive], np.full(len(alive), level), block["width"])
            bitmap = rows[at[:, 0]] & rows[at[:, 1]] & rows[at[:, 2]]
            holds = bitmap if holds is None else holds & bitmap
            some = holds.any(1)
            alive, holds = alive[some], holds[some]
            present = np.unpackbits(holds, axis=1, count=docs, bitorder="little").astype(bool)
            often[alive] = np.where(present, LEVELS[level + 1] - 1, often[alive])
        often = np.minimum(often, most[None, :])
        share[start:start + 1024] = batch.weight[start:start + 1024, None] * (
            (1_000_000_000 * often) // (1000 * often + 8 * m[None, :]))
    return np.stack([np.array(c, np.int64) @ share[t] if t else np.zeros(docs, np.int64) for _, t, c in batch.items])


class _Top:
    """The ``k`` best (score, id) of each item that a task has seen; ids ascend among equals, NULL last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]

    def add(self, item: int, score: int, doc_id: int | None, key: int) -> None:
        entry = (score, doc_id is None and -1 or 0, -(doc_id or 0), key)
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def floor(self, item: int) -> int:
        heap = self.heaps[item]
        return heap[0][0] if len(heap) == self.k else 1


def highest_bounds(index: Index, batch: Batch, k: int) -> DataFrame:
    """(key): rows that hold one of the ``k`` highest bounds of an item."""
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in batch.terms], np.uint64)
    total, length = index.n, index.length

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(len(batch.items), k)
        for block in _blocks(parts):
            bound = bounds(block, batch, hashes, total, length)
            for item in np.flatnonzero(bound.max(1) >= [top.floor(i) for i in range(len(bound))]).tolist():
                own = bound[item]
                for at in np.argsort(-own, kind="stable")[:k].tolist():
                    if own[at] >= top.floor(item):
                        top.add(item, int(own[at]), None, block["keys"][at])
        flat = [(i, e[0], e[3]) for i, heap in enumerate(top.heaps) for e in heap]
        yield pa.RecordBatch.from_pydict({
            name: pa.array([f[j] for f in flat], pa.int64()) for j, name in enumerate(("item", "bound", "key"))})

    found = index.blocks.mapInArrow(of, "item bigint, bound bigint, key bigint")
    at = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "key"))
    return settle(found.withColumn("at", at).where(F.col("at") <= k).select("key", "item").groupBy("key").agg(
        F.collect_set("item").alias("items")))


def candidates(index: Index, batch: Batch, floors: np.ndarray) -> DataFrame:
    """(key, items): rows and the items for which their bound is not below the floor."""
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in batch.terms], np.uint64)
    total, length = index.n, index.length

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(parts):
            item, doc = np.nonzero(bounds(block, batch, hashes, total, length) >= floors[:, None])
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.array(block["keys"], np.int64)[doc]), "item": pa.array(item.astype(np.int64))})

    # equal rows stand in several blocks, whose bounds may differ
    return settle(index.blocks.mapInArrow(of, "key bigint, item bigint").distinct().groupBy("key").agg(
        F.collect_set("item").alias("items")))


def rescore(df: DataFrame, wanted: DataFrame, batch: Batch, index: Index, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best of each item among the rows ``wanted`` (key, items), from their texts."""
    total, length = index.n, index.length
    kind = dict(df.dtypes)["doc_id"]
    place, weight = batch.terms, batch.weight.tolist()
    queries = [(t, c) for _, t, c in batch.items]

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(len(queries), k)
        for part in parts:
            for doc_id, text, items in zip(*(part.column(i).to_pylist() for i in range(3))):
                found = terms(text)
                tf = {place[t]: c for t, c in Counter(found).items() if t in place}
                m = damping(len(found), total, length)
                value = {t: weight[t] * ((1_000_000_000 * c) // (1000 * c + 8 * m)) for t, c in tf.items()}
                for item in items:
                    score = sum(c * value.get(t, 0) for t, c in zip(*queries[item]))
                    if score > 0:
                        top.add(item, score, doc_id, 0)
        flat = [(i, None if e[1] else -e[2], e[0]) for i, heap in enumerate(top.heaps) for e in heap]
        yield pa.RecordBatch.from_pydict({
            name: pa.array([f[j] for f in flat], pa.int64()) for j, name in enumerate(("item", "doc_id", "score"))})

    asked = _keyed(df).join(wanted, "key").select("doc_id", "text", "items")
    best = asked.mapInArrow(of, "item bigint, doc_id bigint, score bigint")
    at = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", at).where(F.col("rank") <= k).withColumn("doc_id", F.col("doc_id").cast(kind))


def search(df: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) the ``k`` best rows of ``df`` (doc_id, text).

    Only scores above 0 count; equal scores stand by ascending doc_id, NULL last. Texts that are NULL or without a
    term match nothing, and as items have no result. Equal rows of ``df`` each take a rank; equal items each
    have their ranks. Texts are read whole. Other columns are ignored. doc_id and item_id are whole numbers.
    No rows on either side give none.
    """
    index = build_index(df)
    kind = dict(items.dtypes)["item_id"]
    out = df.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(df.dtypes)['doc_id']}, score bigint")
    if not index.length:
        return out
    for batch in batches(items):
        weigh(batch, index)
        first = rescore(df, highest_bounds(index, batch, k), batch, index, k).groupBy("item").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floors = np.ones(len(batch.items), np.int64)
        for r in first.collect():  # one row per item of the batch
            if r["n"] == k:
                floors[r["item"]] = r["least"]
        best = settle(rescore(df, candidates(index, batch, floors), batch, index, k))
        names = df.sparkSession.createDataFrame(
            [(i, item_id) for i, (item_id, _, _) in enumerate(batch.items)], f"item bigint, item_id {kind}")
        out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
