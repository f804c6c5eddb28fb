"""Benchmark passages in texts, found by one Aho-Corasick automaton in one scan.

Texts are normalised byte by byte (A-Z to a-z, all other ASCII but digits and
letters to spaces), which keeps every byte where it was: a word's place in the
normalised text is its place in the original. Windows of consecutive item words
become the automaton's patterns, with a space on either side.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_filter, arrow_map

# Which bytes are parts of words, and in which case.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
WINDOW = 10
# Patterns in one automaton: some 100 bytes each, several hundred as nodes.
PATTERNS = 200_000

_built: dict[tuple[str, int], tuple[ahocorasick.Automaton, list[list[str]]]] = {}


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    """Every run of ``size`` words, space-joined; of fewer words, the one run there is."""
    words = (text or b"").translate(NORMAL).split()
    if not words:
        return []
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def patterns(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(pattern BINARY, items ARRAY<STRING>): distinct windows of all items, sorted item ids."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(w, i) for i, t in zip(ids, texts) for w in dict.fromkeys(windows(t, size))]
            yield pa.RecordBatch.from_pydict({"pattern": pa.array([w for w, _ in found], pa.binary()),
                                              "item": pa.array([i for _, i in found], pa.string())})

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    return items.mapInArrow(of, "pattern binary, item string").groupBy("pattern").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


def automaton(key: tuple[str, int], rows: list[tuple[bytes, list[str]]]) -> tuple[ahocorasick.Automaton, list[list[str]]]:
    """The automaton over ``rows``, kept by the worker under ``key``, a scanner's name and its block.

    Built once for each block; those of other scanners go. Bytes are read as Latin-1 characters.
    """
    if key not in _built:
        for other in [k for k in _built if k[0] != key[0]]:
            del _built[other]
        machine = ahocorasick.Automaton()
        for n, (pattern, _) in enumerate(rows):
            machine.add_word(f" {pattern.decode('latin-1')} ", (n, len(pattern)))
        machine.make_automaton()
        _built[key] = machine, [items for _, items in rows]
    return _built[key]


def scan(line: bytes, machine: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Byte spans [from, to) of ``line`` inside occurrences, merged, and the patterns that occur.

    ``line``: a normalised text. Runs of spaces count as one, so the words are joined
    anew; matches are then carried back to where the words lie.
    """
    buf = np.frombuffer(line, np.uint8) != 0x20
    edge = np.diff(np.concatenate(([False], buf, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [], set()
    joined = f" {b' '.join(line.split()).decode('latin-1')} "
    at = np.concatenate(([0], np.cumsum(ends - starts + 1)[:-1]))  # of each word, less its leading space
    spans: list[list[int]] = []
    found = set()
    for last, (n, length) in machine.iter(joined):
        found.add(n)
        first = int(np.searchsorted(at, last - length - 1))
        final = int(np.searchsorted(at, last - 1, side="right")) - 1
        spans.append([first, final])
    merged: list[list[int]] = []
    for first, final in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], final)
        else:
            merged.append([first, final])
    return [(int(starts[a]), int(ends[b])) for a, b in merged], found


def _blocks(benchmark: DataFrame, size: int) -> list:
    """Broadcasts of at most ``PATTERNS`` patterns each; one, unless the benchmark is very large."""
    spark = benchmark.sparkSession
    blocks, rows = [], []
    for r in patterns(benchmark, size).toLocalIterator():
        rows.append((bytes(r["pattern"]), r["items"]))
        if len(rows) == PATTERNS:
            blocks.append(spark.sparkContext.broadcast(rows))
            rows = []
    if rows or not blocks:
        blocks.append(spark.sparkContext.broadcast(rows))
    return blocks


class Scanner:
    """Scans texts with each block's automaton in turn; a worker builds each once."""

    def __init__(self, benchmark: DataFrame, size: int = WINDOW) -> None:
        self.name = uuid.uuid4().hex
        self.blocks = _blocks(benchmark, size)

    def results(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: its words, the merged hit spans (bytes), the ids of the items that occur, sorted."""
        lines = [(t or b"").translate(NORMAL) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in lines]
        items: list[set[str]] = [set() for _ in lines]
        for k, block in enumerate(self.blocks):
            machine, names = automaton((self.name, k), block.value)
            if not names:
                continue
            for i, line in enumerate(lines):
                where, found = scan(line, machine)
                spans[i].extend(where)
                for n in found:
                    items[i].update(names[n])
        out = []
        for line, where, ids in zip(lines, spans, items):
            merged: list[tuple[int, int]] = []
            for a, b in sorted(where):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            out.append((len(line.split()), merged, sorted(ids)))
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    With ``spans`` also ``spans`` ARRAY<STRUCT<start, end>>: the hit parts of the text in
    UTF-8 bytes. A word is hit inside any occurrence of a window of an item. NULL and empty
    texts have no words and no hits; items without words match nothing; a NULL item_id reads
    as an empty id. Items repeated or with equal windows all count, equal ids once. Columns other than
    doc_id and text (item_id and text) are ignored; repeated rows stay.
    """
    scanner = Scanner(benchmark, size)

    def of(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        found = scanner.results(texts)
        hits = [sum(len(t[a:b].translate(NORMAL).split()) for a, b in where) for t, (_, where, _) in zip(texts, found)]
        out = {
            "doc_id": batch.column(0),
            "n_words": pa.array([n for n, _, _ in found], pa.int64()),
            "n_hit": pa.array(hits, pa.int64()),
            "n_items": pa.array([len(ids) for _, _, ids in found], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(ids).encode()).hexdigest() for _, _, ids in found]),
            "contaminated": pa.array([h > 0 for h in hits]),
        }
        if spans:
            out["spans"] = pa.array([[{"start": a, "end": b} for a, b in where] for _, where, _ in found],
                                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return out

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(
        docs.select("doc_id", F.col("text").cast("binary")), of,
        f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
        + ", spans array<struct<start: bigint, end: bigint>>" * spans)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns.

    NULL and empty texts stay, as they hold none; texts are scanned whole. Repeated rows stay or go together; no rows give none.
    """
    scanner = Scanner(benchmark, size)

    def keep(texts: list[str | None]) -> list[bool]:
        return [not where for _, where, _ in scanner.results([t.encode() if t else None for t in texts])]

    return arrow_filter(docs, "text", keep)
