"""Vector codes: each of a vector's parts becomes the number of its nearest codebook entry.

The parts of all vectors are counted, so that equal ones are one, and written in lexicographic
order. In that order they are the leaves of a trie, one level per component. A depth-first
traversal carries for each node the distances of its prefix to all entries, added up; parts that
begin alike share them. A leaf takes the nearest entry and adds its weighted components to that
entry's sums. The traversal goes by runs of some hundred leaves, inside a run a level at a time
in whole arrays. Only codebooks and their sums, whose size depends on neither rows nor
values, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.vectors import matrix, padded, whole_numbers
from meshtally.operators.ranks import join_on
from meshtally.session import settle

LEAVES = 256  # in one run: its distances to 256 entries stay in a core's cache


def number_type(most: int, width: int) -> type:
    """The narrowest type that holds the sum of ``width`` squared differences of numbers up to ``most``."""
    top = (2 * most) ** 2 * max(1, width)
    if top >= 2**63:
        raise ValueError("squared distances exceed a long")
    return np.int32 if top < 2**31 else np.float64 if top < 2**53 else np.int64


def nearest(parts: np.ndarray, entries: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``parts``, which come in lexicographic order; ties to the lower entry."""
    n, width = parts.shape
    index, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    columns = np.ascontiguousarray(entries.T).astype(kind)
    for start in range(0, n, LEAVES):
        run = parts[start:start + LEAVES].astype(kind)
        # the level at which a leaf's path leaves that of the leaf before it
        differs = run[1:] != run[:-1]
        leaves_at = np.where(differs.any(1), differs.argmax(1), width) if width else np.zeros(len(run) - 1, np.int64)
        sums = np.zeros((1, len(entries)), kind)  # one row per node of the level, from the root on
        node = np.zeros(len(run), np.int64)
        for level in range(width):
            first = np.concatenate(([0], np.flatnonzero(leaves_at <= level) + 1))
            away = columns[level][None, :] - run[first, level][:, None]
            away *= away
            away += sums if len(sums) == len(first) else sums[node[first]]
            sums = away
            node = np.zeros(len(run), np.int64)
            node[first[1:]] = 1
            node = np.cumsum(node)
        best = sums.argmin(1)
        index[start:start + LEAVES] = best[node]
        error[start:start + LEAVES] = sums[np.arange(len(best)), best][node].astype(np.int64)
    return index, error


@dataclass
class Codebooks:
    """Per part position its entries (rows of whole numbers), and the type that distances fit in."""

    entries: list[np.ndarray]
    width: int
    kind: type

    def sha256(self) -> str:
        """Of all components by part, entry and position within the part, in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def distinct_parts(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """(pos, part, weight) in lexicographic order, written out: each different part with its number of rows."""
    cut = F.array(*[F.slice("vector", i * width + 1, width) for i in range(parts)])
    counted = kept.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(
        F.count(F.lit(1)).alias("weight"))
    return settle(counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"))


def refine(parts: DataFrame, books: Codebooks) -> Codebooks:
    """One round: all parts to their nearest entries, which become the floors of the means of their parts."""
    entries, width, kind = books.entries, books.width, books.kind

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(e), width), np.int64) for e in entries]
        rows = [np.zeros(len(e), np.int64) for e in entries]
        for batch in batches:
            pos, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            part = matrix(batch.column(1), width)
            for p in np.unique(pos).tolist():
                at = pos == p
                own, w = part[at], weight[at]
                index, _ = nearest(own, entries[p], kind)
                np.add.at(sums[p], index, own * w[:, None])
                np.add.at(rows[p], index, w)
        for p, (s, n) in enumerate(zip(sums, rows)):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_pydict({
                    "pos": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()),
                    "n": pa.array(n[used]), "sums": pa.array(s[used].tolist(), pa.list_(pa.int64()))})

    partial = parts.mapInArrow(of, "pos int, entry int, n bigint, sums array<bigint>")
    # the number of rows goes with the sums, as one more component
    total = partial.select("pos", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("i", "x")).groupBy(
        "pos", "entry", "i").agg(F.sum("x").alias("x"))
    new = [e.copy() for e in entries]
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in total.collect():  # at most one per component of a codebook, and one per entry
        found.setdefault((r["pos"], r["entry"]), {})[r["i"]] = r["x"]
    for (p, e), x in found.items():
        new[p][e] = [x[i + 1] // x[0] for i in range(width)]
    return Codebooks(new, width, kind)


def fit(kept: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4) -> Codebooks | None:
    """Codebooks from rows (vec_id, vector); None where there are no rows."""
    size, most = kept.agg(F.max(F.size("vector")), F.max(F.greatest(
        F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))).first()
    if size is None:
        return None
    width = -(-size // parts)
    even = kept.select("vec_id", padded("vector", width * parts).alias("vector"))
    first = even.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, width)
    kind = number_type(most or 0, width)
    books = Codebooks([start[:, p].copy() for p in range(parts)], width, kind)
    laid = distinct_parts(even, width, parts)
    for _ in range(rounds):
        books = refine(laid, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, vector) to (vec_id, label, code, error)."""
    entries, width, kind = books.entries, books.width, books.kind
    kinds = dict(kept.dtypes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = matrix(batch.column(2), width * len(entries))
            code = np.zeros((batch.num_rows, len(entries)), np.int64)
            error = np.zeros(batch.num_rows, np.int64)
            for p, own in enumerate(entries):
                part = whole[:, p * width:(p + 1) * width]
                order = np.lexsort(part.T[::-1]) if width else np.arange(len(part))
                index, away = nearest(part[order], own, kind)
                code[order, p] = index
                error[order] += away
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "label": batch.column(1),
                "code": pa.array(["".join(f"{i:02x}" for i in row) for row in code.tolist()], pa.string()),
                "error": pa.array(error)})

    even = kept.select("vec_id", "label", padded("vector", width * len(entries)).alias("vector"))
    return even.mapInArrow(of, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compress(df: DataFrame, scale: int = 1024, entries: int = 256, parts: int = 4, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row of ``df`` (vec_id, embedding, label) that takes part.

    Rows whose embedding is NULL or holds NULL or non-finite components are dropped. Vectors shorter than the
    longest, and lengths that ``parts`` does not divide, count as filled up with zeros; an empty vector has the code of
    zeros. NULL vec_ids come last for the first codebooks, equal ones in the order of their vectors; NULL labels are one
    label. Repeated rows are rows of their own. Other columns are ignored. No rows give none. Squared
    distances of 2^63 and more do not fit the result's type: such tables raise.
    """
    kept = whole_numbers(df, scale, "vec_id", "label")
    books = fit(kept, entries, parts, rounds)
    kinds = dict(df.dtypes)
    if books is None:
        return df.sparkSession.createDataFrame(
            [], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = settle(encode(kept, books))
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_on(coded, per_label, ["label"]).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
