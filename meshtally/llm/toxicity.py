"""Toxicity as severity: cumulative-link ordinal regression on the words of a text.

All thresholds share one weight per word: P(grade > k) = 1 / (1 + exp(cut[k] - w.x)),
with cuts in increasing order. The expected severity is the sum of these over k.
The labels only say toxic or not; toxic texts of the bounded sample are graded by how
many words that mark toxic texts they hold, in thirds, and all others are grade 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_map, remainder, sample
from meshtally.session import settle

WORD = re.compile(r"[^\W\d_]+")
GRADES = 4


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Weights of the vocabulary and the cuts between grades."""

    weights: dict[str, float]
    cuts: np.ndarray

    def exceed(self, held: list[set[str]]) -> np.ndarray:
        """P(grade > k) of each text, (texts, GRADES - 1)."""
        known = self.weights.keys()
        z = np.array([sum(self.weights[w] for w in sorted(known & own)) for own in held])
        return _sigmoid(z[:, None] - self.cuts[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def solve(rows: list[np.ndarray], grades: np.ndarray, width: int, steps: int = 400, rate: float = 0.05,
          shrink: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by proximal Adam steps on the likelihood; ``shrink`` sets useless weights to 0.

    ``rows``: numbers of the words each text holds. Both classes count the same in total.
    """
    n = len(rows)
    w = np.zeros(width)
    cuts = np.array([1.0, 2.0, 3.0])[:GRADES - 1]
    if not n or not (grades > 0).any() or not (grades == 0).any():
        return w, cuts + 50.0 * (not (grades > 0).any())
    text = np.repeat(np.arange(n), [len(r) for r in rows])
    word = np.concatenate(rows).astype(np.int64)
    weight = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())
    m, v = np.zeros(width + GRADES - 1), np.zeros(width + GRADES - 1)
    for t in range(1, steps + 1):
        z = np.bincount(text, w[word], n)
        over = _sigmoid(z[:, None] - cuts)  # P(grade > k)
        upper = np.concatenate((np.ones((n, 1)), over), 1)[np.arange(n), grades]
        lower = np.concatenate((over, np.zeros((n, 1))), 1)[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        g_z = -(d_upper - d_lower)
        g_cut = np.array([d_upper[grades == k + 1].sum() - d_lower[grades == k].sum() for k in range(GRADES - 1)])
        g = np.concatenate((np.bincount(word, g_z[text], width), g_cut))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6)
        w = w - step[:width]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
        cuts = np.maximum.accumulate(cuts - step[width:] + np.arange(GRADES - 1) * 1e-6)
    return w, cuts


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, limit: int = 8000,
        vocabulary: int = 8192, least: int = 3, sure: float = 6.0) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and ``docs`` (doc_id, text), leaving out the held fold.

    About ``limit`` toxic and as many other labelled texts, twice that at most. The
    ``vocabulary`` words whose shares among the two differ most, by ``sure`` standard errors or
    more, and that ``least`` texts or more hold, are features. An id marked both ways counts as toxic.
    """
    marks = labels.where((remainder("doc_id", folds) != held) & F.col("doc_id").isNotNull()
                         & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("_id"), "toxic")
    drawn = settle(sample(marks.where("toxic = 1"), limit, "_id").unionByName(
        sample(marks.where("toxic = 0"), limit, "_id")))

    def split(batch: pa.RecordBatch) -> dict:
        return {"toxic": batch.column(0), "words": pa.array([sorted(words(t)) for t in batch.column(1).to_pylist()],
                                                            pa.list_(pa.string()))}

    # the drawn ids are bounded, so the texts stay where they are
    texts = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("toxic", "text")
    texts = settle(arrow_map(texts, split, "toxic int, words array<string>").withColumn(
        "row", F.monotonically_increasing_id()))
    n = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    counts = texts.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("all"), F.sum("toxic").alias("bad")).where(F.col("all") >= least)
    bad, good = F.col("bad") / max(1, n[1]), (F.col("all") - F.col("bad")) / max(1, n[0])
    mean = F.col("all") / max(1, n[0] + n[1])
    z = F.abs(bad - good) / F.sqrt(mean * (1.0001 - mean) * (1 / max(1, n[0]) + 1 / max(1, n[1])))
    chosen = counts.select("word", "all", "bad", z.alias("z")).where(F.col("z") >= sure).orderBy(
        F.desc("z"), "word").limit(vocabulary).collect()
    index = {r["word"]: i for i, r in enumerate(chosen)}
    marking = np.array([r["bad"] / max(1, n[1]) > 20 * (r["all"] - r["bad"] + 0.5) / max(1, n[0]) for r in chosen])

    def number(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column(0), "toxic": batch.column(1), "held": pa.array(
            [np.array([index[w] for w in own if w in index], np.int32).tobytes() for own in batch.column(2).to_pylist()],
            pa.binary())}

    found = sorted(arrow_map(texts.select("row", "toxic", "words"), number,
                             "row bigint, toxic int, held binary").collect())
    rows = [np.frombuffer(r["held"], np.int32) for r in found]
    toxic = np.array([r["toxic"] for r in found], np.int64)
    hits = np.array([int(marking[r].sum()) if len(r) else 0 for r in rows])
    grades = np.zeros(len(rows), np.int64)
    if (toxic == 1).any():
        thirds = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
        grades = np.where(toxic == 1, 1 + (hits > thirds[0]) + (hits > thirds[1]), 0)
    w, cuts = solve(rows, grades, len(chosen))
    return Model({word: float(w[i]) for word, i in index.items() if w[i]}, cuts)


def grade(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, severity, grade, score, toxic) for every row of ``docs`` (doc_id, text; others are ignored).

    severity: the expected grade, 0 to 3; grade: the likeliest one, the lower on ties; score:
    P(grade > 0); toxic: 1 if score >= 0.5. NULL and empty texts hold no words and are
    scored as such. NULL ids and repeated rows stay; no rows give none. Without any toxic text
    to learn from nothing is toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def of(batch: pa.RecordBatch) -> dict:
        over = shared.value.exceed([words(t) for t in batch.column(2).to_pylist()])
        each = np.concatenate((np.ones((len(over), 1)), over), 1) - np.concatenate((over, np.zeros((len(over), 1))), 1)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "severity": pa.array(over.sum(1), pa.float64()),
                "grade": pa.array(each.argmax(1).astype(np.int32)), "score": pa.array(over[:, 0], pa.float64()),
                "toxic": pa.array((over[:, 0] >= 0.5).astype(np.int32))}

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(
        docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "text"), of,
        f"doc_id {kind}, held_out boolean, severity double, grade int, score double, toxic int")
