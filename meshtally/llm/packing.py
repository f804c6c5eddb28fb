"""Documents packed into token sequences by the sum-of-squares rule.

A document's place depends only on how many open bins have which gap, so pieces
of one length are interchangeable: the rule runs on the counts of the lengths
(at most ``size`` numbers, whatever the corpus holds), exactly as if piece by piece, and yields, per length, runs
of ranks with the sequences they go to. The pieces are then numbered within
their length, in parallel, and each takes the place of its number.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.session import settle

CACHE = 500_000  # words, and parts of words, that a worker remembers
MARKS = ".,!?;:#%&*$|"
# A capital that becomes two characters, and where readings of "white space" or letters differ.
_ODD = re.compile("[\u0130\u0250-\U0010ffff\x1c-\x1f\x85]")

_tokenizers: dict[str, "Words"] = {}


class Words:
    """Token ids of words as the tokenizer file gives them, remembered.

    The tokenizer lowers case, drops white space and never merges across it, nor across the
    border between letters and marks; so a text's ids are its words' and marks' ids one after
    the other. That is used for texts up to U+024F without control characters that readings of
    "white space" differ on; other texts are split at spaces and line feeds only, and special
    strings stay whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}

    @classmethod
    def at(cls, path: str) -> Words:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _learn(self, words: set[str]) -> None:
        """Ids of new words: of their letters and marks where they are just that, else as a whole."""
        if len(self.cores) > CACHE:
            self.cores = {"": b""}
        parted = {}
        for w in words:
            core = w.rstrip(MARKS)
            parted[w] = (core, w[len(core):]) if core.isalpha() and not _ODD.search(core) else (w, "")
        new = {part for pair in parted.values() for part in pair}.difference(self.cores)
        letters = [part for part in new if part.isalpha() and not _ODD.search(part)]
        for at in range(0, len(letters), 256):
            self._learn_letters(letters[at:at + 256])
        rest = list(new.difference(self.cores))
        for part, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.cores[part] = array("I", e.ids).tobytes()
        for w, (core, tail) in parted.items():
            self.words[w] = self.cores[core] + self.cores[tail]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters, read in one go: each ends with the one id that closes a word."""
        own = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.closes[own]) + 1) * 4
        if len(ends) == len(words):
            data = own.tobytes()
            self.cores.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.words) > CACHE:
            self.words = {"": b""}
        split, new = [], set()
        for text in texts:
            text = text or ""
            if _ODD.search(text) or "<|" in text:
                words = text.replace("\n", " ").split(" ")
            else:
                words = text.lower().split()
            split.append(words)
            new.update(filterfalse(self.words.__contains__, words))
        self._learn(new)
        for words in split:
            yield b"".join(map(self.words.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end``, cut only if longer than ``size``.

    ids: BINARY, little-endian unsigned 32-bit. NULL and empty texts are the one id ``end``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            at: list[int] = []
            piece: list[int] = []
            ids: list[bytes] = []
            for row, own in enumerate(Words.at(tokenizer).ids(batch.column(1).to_pylist())):
                own += last
                for n, i in enumerate(range(0, len(own), 4 * size)):
                    at.append(row)
                    piece.append(n)
                    ids.append(own[i:i + 4 * size])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).take(pa.array(at, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array([n * size for n in piece], pa.int64()),
                "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


class Gaps:
    """Counts of open bins by gap, while pieces of one ``length`` are placed.

    A move puts a piece into a bin of gap g, or a new one (g = ``size``), which then has gap g - ``length``. Its worth is what
    it takes off the sum of squares (odd: bins that fill up, and new ones, change one count only). A move lowers its
    own worth and raises that of others, so what can be done stays so until it is done, and the moves
    worth more than a level have one outcome in whatever order they are made. The rule, one by one, makes all of
    those before any other; so they are made many at a time, level after level, and one by one only within the last.
    """

    FEW = 200  # pieces that are placed one by one at once

    def __init__(self, size: int) -> None:
        self.size, self.n = size, np.zeros(size + 1, np.int64)

    def _worth(self, n: np.ndarray, length: int) -> np.ndarray:
        """Of moves from the gaps length .. size; those without a bin count as well here."""
        w = 2 * (n[length:] - np.concatenate(([0], n[1:self.size - length + 1]))) - 2
        w[0] += 1
        w[-1] = -2 * n[self.size - length] - 1
        return w

    def _down_to(self, length: int, level: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(moves by gap, counts after) of all moves worth more than ``level``; None if more than ``most`` or without end."""
        n, moves, total = self.n.copy(), np.zeros(self.size - length + 1, np.int64), 0
        step = np.full(len(moves), 4)  # that a move lowers its worth by
        step[0] = step[-1] = 2
        seen, sweeps, due = n.copy(), 0, 1
        while True:
            some = np.maximum(0, -((level - self._worth(n, length)) // step))
            some[:-1] = np.minimum(some[:-1], n[length:self.size])
            if not (made := int(some.sum())):
                return moves, n
            total += made
            if total > most:
                return None
            moves += some
            n[length:self.size] -= some[:-1]
            n[1:self.size - length + 1] += some[1:]
            sweeps += 1
            if np.array_equal(n, seen):
                return None
            if sweeps == due:
                seen, due = n.copy(), 2 * due

    def _one_by_one(self, length: int, left: int) -> np.ndarray:
        """Moves by gap of the next ``left`` pieces; of equal ones the smallest gap, a new bin last."""
        n, size, moves = self.n.tolist(), self.size, np.zeros(self.size - length + 1, np.int64)

        def cost(g: int) -> int:
            if g == size:
                return 2 * n[size - length] + 1
            return 1 - 2 * n[g] if g == length else 2 * (n[g - length] - n[g]) + 2

        heap = [(cost(g), g) for g in range(length, size) if n[g]] + [(cost(size), size)]
        heapify(heap)
        # the moves since a mark, and the counts that differ from then: none, and they go on in the same round
        own: dict[int, int] = {}
        apart: dict[int, int] = {}
        since, due, watch = 0, 16, True
        while left:
            known, g = heap[0]
            if g < size and not n[g]:
                heappop(heap)
                continue
            if known != (now := cost(g)):
                heapreplace(heap, (now, g))
                continue
            for gap, d in ((g, -1), (g - length, 1)):
                if 0 < gap < size:
                    n[gap] += d
                    if d := apart.pop(gap, 0) + d:
                        apart[gap] = d
            moves[g - length] += 1
            own[g] = own.get(g, 0) + 1
            left, since = left - 1, since + 1
            for gap in (g - length, g + length):  # worth more now
                if length <= gap < size and n[gap] or gap == size:
                    heappush(heap, (cost(gap), gap))
            if watch and not apart and left >= since:
                rounds = left // since
                for gap, k in own.items():
                    moves[gap - length] += rounds * k
                left, watch = left - rounds * since, False
            elif watch and since == due:
                own, apart, since, due = {}, {}, 0, 2 * due
        self.n = np.array(n, np.int64)
        return moves

    def take(self, length: int, count: int) -> np.ndarray:
        """Place ``count`` pieces; the moves from each of the gaps length .. size."""
        moves = np.zeros(self.size - length + 1, np.int64)
        if length == self.size:
            moves[-1] = count
            return moves
        left, depth = count, 1
        while left > self.FEW and depth:
            there = np.append(self.n[length:self.size] > 0, True)
            best = int(self._worth(self.n, length)[there].max())
            if (done := self._down_to(length, best - depth, left)) is None:
                depth //= 2
                continue
            moves += done[0]
            left -= int(done[0].sum())
            self.n = done[1]
            depth *= 2
        return moves + self._one_by_one(length, left) if left else moves


def sum_of_squares(counts: dict[int, int], size: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place every piece.

    Longest first, each piece goes to the open bin, or a new one, that leaves the sum over the
    gaps of squared counts of open bins smallest; of equal choices the fullest bin. Counts after each length are those
    of placing piece by piece, whatever the numbers (see ``Gaps``).
    """
    gaps = Gaps(size)
    bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by gap: (first sequence, how many)
    placed: list[tuple[int, int, int, int, int]] = []
    new = 0
    for length in sorted(counts, reverse=True):
        rank = 0
        moves = gaps.take(length, counts[length])
        # from the widest gap on: bins that came from a wider one may go on
        for gap in (np.flatnonzero(moves)[::-1] + length).tolist():
            need = int(moves[gap - length])
            if gap == size:
                bins[gap] = [(new, need)]
                new += need
            while need:
                first, many = bins[gap].pop()
                if many > need:
                    bins[gap].append((first + need, many - need))
                    many = need
                placed.append((length, rank, many, first, size - gap))
                rank += many
                need -= many
                if gap > length:
                    bins[gap - length].append((first, many))
    return placed


PART = 50_000  # pieces of one length that are numbered in one task


def place(cut: DataFrame, size: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the columns of ``cut`` (length and others).

    Pieces of a length are dealt to as many parts as their number asks for, numbered inside each, and
    matched with the runs in their order: a run serves the pieces that stand between its begin and the next one's. Runs are
    cut where a stretch of ``PART`` numbers ends, so no task holds more of a length than that. ``cut`` is
    read twice and must be written out.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    many = spark.createDataFrame([(n, -(-c // PART)) for n, c in counts.items()], "_l int, _many bigint")
    dealt = settle(cut.join(F.broadcast(many), F.col("length") == F.col("_l")).withColumn(
        "_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_many"))).drop("_l", "_many").withColumn(
        "_row", F.monotonically_increasing_id()))
    parts = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")
    starts = parts.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), before.alias("_from"))
    inside = W.partitionBy("length", "_part").orderBy("_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(
        starts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p"))).withColumn(
        "_rank", F.col("_rank") + F.col("_from")).drop("_l", "_p", "_from", "_part", "_row")
    runs = [[], [], [], []]
    for length, first, many_, sequence, offset in sum_of_squares(counts, size):
        while many_:
            some = min(many_, PART - first % PART)
            for column, value in zip(runs, (length, first, sequence, offset)):
                column.append(value)
            first, sequence, many_ = first + some, sequence + some, many_ - some
    table = settle(spark.createDataFrame(pa.table(dict(zip(
        ("length", "_rank", "_sequence", "_offset"), [pa.array(c, pa.int64()) for c in runs])))))
    run = table.select("length", "_rank", F.struct(F.col("_rank").alias("first"), "_sequence", "_offset").alias("_run"))
    both = ranked.withColumn("_piece", F.lit(True)).unionByName(run, allowMissingColumns=True)
    stretch = W.partitionBy("length", F.expr(f"_rank div {PART}")).orderBy("_rank", F.col("_run").isNull())
    found = both.withColumn("_run", F.last("_run", ignorenulls=True).over(
        stretch.rowsBetween(W.unboundedPreceding, 0))).where("_piece")
    return found.select(
        *cut.columns, (F.col("_run._sequence") + F.col("_rank") - F.col("_run.first")).alias("sequence_id"),
        F.col("_run._offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> tuple[DataFrame, DataFrame]:
    """(places, pieces) of every row of ``docs`` (doc_id, text; other columns are ignored).

    places: doc_id, piece, start, length, ids_crc32, sequence_id, offset. pieces: the cut
    ids themselves, written to the shared folder, joined to places by (doc_id, piece) where
    doc_ids are unique. NULL ids and repeated rows are packed like any other; no rows give none.
    """
    cut = settle(pieces(docs, tokenizer, size, end))
    light = settle(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return place(light, size), cut


def sequences(places: DataFrame, cut: DataFrame) -> DataFrame:
    """(sequence_id, ids BINARY): the packed sequences; each holds at most ``size`` ids."""
    parts = places.join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
