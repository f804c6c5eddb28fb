"""Language by string kernels: blended-spectrum presence kernels, Nyström landmarks, ridge regression.

The kernel of two texts is the number of n-grams (of bytes, lengths ``NGRAMS``,
ASCII letters in lower case) both hold, over the geometric mean of the numbers
each holds. A bounded set of landmark texts gives the Nyström map; on it one ridge
regression for each language is solved against the rest. As presence kernels are
inner products of presence vectors, scoring a batch is one product of its
presence matrix with a (n-grams x languages) matrix that folds landmarks, whitening and
coefficients together. Its n-grams are those of the landmarks, each for itself: no other n-gram enters a kernel
with a landmark but by the number of n-grams a text holds, which is counted exactly.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_filter, arrow_map, remainder
from meshtally.session import settle

NGRAMS = (2, 3, 4)
UNKNOWN = "und"
AT_ONCE = 1 << 20  # bytes of a text taken at once


def presence(text: bytes) -> np.ndarray:
    """Sorted codes of the different n-grams of a text: their bytes, and their length above those."""
    low = text.lower()
    parts: list[np.ndarray] = []
    for at in range(0, len(low), AT_ONCE):
        # a little of the next part, so that n-grams across parts count
        buf = np.frombuffer(low[at:at + AT_ONCE + max(NGRAMS) - 1], np.uint8).astype(np.uint32)
        code = buf
        for n in range(2, max(NGRAMS) + 1):
            if len(buf) < n:
                break
            code = (code[:len(buf) - n + 1] << np.uint32(8)) | buf[n - 1:]
            if n in NGRAMS:
                own = np.unique(code).astype(np.uint64)
                parts.append(own | np.uint64(n << 32))
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate(parts)) if len(low) > AT_ONCE else np.concatenate(parts)


class Landmarks:
    """Presence sets of the landmarks: ``columns``, their n-grams in order, and a bit per column and landmark."""

    def __init__(self, marks: list[np.ndarray]) -> None:
        self.columns = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.size = len(marks)
        held = np.zeros((len(self.columns), -(-len(marks) // 8)), np.uint8)
        for i, own in enumerate(marks):
            held[np.searchsorted(self.columns, own), i >> 3] |= 128 >> (i & 7)
        self.held = held
        self.norms = np.sqrt([max(1, len(m)) for m in marks])

    def kernels(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, landmarks): shared n-grams over the geometric mean of all."""
        out = np.zeros((len(texts), self.size))
        for i, own in enumerate(texts):
            at = places(own, self.columns)
            out[i] = np.unpackbits(self.held[at], axis=1, count=self.size).sum(0) / np.sqrt(max(1, len(own)))
        return out / self.norms

    def fold(self, coefficients: np.ndarray) -> np.ndarray:
        """(columns, outputs): what each n-gram adds, given what each landmark's kernel does."""
        per_mark = coefficients / self.norms[:, None]
        out = np.zeros((len(self.columns), coefficients.shape[1]), np.float32)
        for at in range(0, len(out), 4096):
            out[at:at + 4096] = np.unpackbits(self.held[at:at + 4096], axis=1, count=self.size) @ per_mark
        return out


def places(own: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where the n-grams of a text that are columns stand."""
    if not len(columns):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
    return at[columns[at] == own]


@dataclass
class Model:
    """``columns``: n-grams of the landmarks in order; ``weights``: (columns, languages), float32."""

    languages: list[str]
    columns: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        """Regression outputs (texts, languages): the batch's presence matrix, mostly zeros, times the weights."""
        held = [presence(t) for t in texts]
        at = [places(own, self.columns) for own in held]
        out = np.zeros((len(texts), len(self.languages)))
        full = [i for i, own in enumerate(at) if len(own)]
        if full:
            starts = np.concatenate(([0], np.cumsum([len(at[i]) for i in full])[:-1]))
            out[full] = np.add.reduceat(self.weights[np.concatenate([at[i] for i in full])], starts)
        return out / np.sqrt([max(1, len(own)) for own in held])[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score in 0..1: its share of the outputs' softmax."""
        if not texts:
            return np.zeros(0, int), np.zeros(0)
        y = np.concatenate([self.outputs(texts[i:i + 64]) for i in range(0, len(texts), 64)]) * 8
        e = np.exp(y - y.max(1, keepdims=True))
        best = y.argmax(1)
        return best, e[np.arange(len(y)), best] / e.sum(1)


def solve(marks: Landmarks, gram: np.ndarray, kernels: np.ndarray, labels: list[str], ridge: float) -> Model:
    """Nyström kernel ridge regression, one against the rest: kernels among landmarks, and of rows with them."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], marks.columns, np.zeros((len(marks.columns), 0), np.float32), np.zeros(0))
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernels @ whiten
    target = np.array([[1.0 if l == name else -1.0 for name in languages] for l in labels])
    weight = np.zeros(len(labels))  # every language counts the same
    for name in languages:
        own = [i for i, l in enumerate(labels) if l == name]
        weight[own] = len(labels) / (len(languages) * len(own))
    mean = (weight @ features) / weight.sum()
    centre = (weight @ target) / weight.sum()
    f = (features - mean) * np.sqrt(weight)[:, None]
    coefficients = np.linalg.solve(f.T @ f + ridge * np.eye(f.shape[1]), f.T @ ((target - centre) * np.sqrt(weight)[:, None]))
    return Model(languages, marks.columns, marks.fold(whiten @ coefficients), centre - mean @ coefficients)


def fit(docs: DataFrame, sample: int = 2000, landmarks: int = 256, ridge: float = 1.0) -> Model:
    """Learn from ``docs`` (doc_id, text, lang) with a text and a lang.

    About ``sample`` different rows are taken, evenly over the languages, by a hash of the text; ``landmarks`` of them, in
    turn from each language, are the landmarks. The others only reach the driver as their kernels with those.
    """
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    h = F.xxhash64("text", F.lit(7))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct(h)).collect()}
    if not sizes:
        return solve(Landmarks([]), np.zeros((0, 0)), np.zeros((0, 0)), [], ridge)
    each = max(1, sample // len(sizes))
    share = F.shiftrightunsigned(h, 11) / float(1 << 53)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.2 * each / max(1, n)))])
    drawn = settle(known.where(share < F.element_at(rate, F.col("lang"))).withColumn("h", h).dropDuplicates(["h", "lang"]))
    # ids first: only the landmarks' texts come here
    ids = sorted((r["lang"], r["h"]) for r in drawn.select("lang", "h").collect())
    by_language: dict[str, list[int]] = {}
    for lang, number in ids:
        by_language.setdefault(lang, []).append(number)
    order = [(lang, own[k]) for k in range(max(map(len, by_language.values()))) for lang, own in by_language.items() if k < len(own)]
    chosen = drawn.sparkSession.createDataFrame(order[:landmarks], "lang string, h bigint")
    texts = drawn.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select(F.col("text").cast("binary"), "lang", "h").collect()
    sets = [presence(bytes(r["text"])) for r in sorted(texts, key=lambda r: (r["lang"], r["h"]))]
    sets = [s for s in sets if len(s)]
    marks = Landmarks(sets)
    shared = drawn.sparkSession.sparkContext.broadcast(marks)  # the landmarks' n-grams

    def of(batch: pa.RecordBatch) -> dict:
        rows = [presence(t) for t in batch.column(0).to_pylist()]
        return {"kernel": pa.array([k.tobytes() if len(r) else b"" for k, r in zip(shared.value.kernels(rows), rows)], pa.binary()),
                "lang": batch.column(1)}

    rows = arrow_map(drawn.select(F.col("text").cast("binary"), "lang"), of, "kernel binary, lang string").collect()
    rows = sorted((r for r in rows if r[0]), key=lambda r: (r[1], zlib.crc32(r[0])))
    kernels = np.array([np.frombuffer(r[0]) for r in rows]).reshape(len(rows), marks.size)
    return solve(marks, marks.kernels(sets), kernels, [r[1] for r in rows], ridge)


def learning_rows(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows a model may learn from: all but those whose crc32(doc_id) leaves ``held``."""
    return docs.where(remainder("doc_id", folds) != held)


def identify(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text; others are ignored).

    NULL texts and texts without a letter are ``und`` with score 0, and so is everything
    if there was nothing to learn from. NULL ids and repeated rows stay; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' n-grams x languages numbers

    def of(batch: pa.RecordBatch) -> dict:
        model = shared.value
        texts, letters = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        at = [i for i, ok in enumerate(letters) if ok and model.languages]
        best, score = model.predict([texts[i] for i in at])
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for i, b, s in zip(at, best.tolist(), score.tolist()):
            names[i], scores[i] = model.languages[b], s
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64())}

    kind = dict(docs.dtypes)["doc_id"]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return arrow_map(
        docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"),
                    F.col("text").cast("binary"), letter.alias("letter")), of,
        f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages with a score of ``least`` or more, with all columns.

    NULL and empty texts, and texts without a letter, go; so does everything if there was nothing to learn from. Texts are
    read whole. Repeated rows are kept or go together; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str | None]) -> list[bool]:
        model = shared.value
        at = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
        _, score = model.predict([texts[i].encode() for i in at])
        good = {i for i, s in zip(at, score.tolist()) if s >= least}
        return [i in good for i in range(len(texts))]

    return arrow_filter(docs, "text", keep)
