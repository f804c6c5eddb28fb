"""Text quality from trusted positives and unlabelled texts: non-negative PU learning.

Only texts marked good are trusted; the rest of the web is unlabelled. With the share
of good texts (the class prior, estimated from the same two samples), the risk on bad texts
is the risk of calling the unlabelled bad less the prior's part of good ones; where that
estimate falls below zero it is fitted noise, and the step is reversed (non-negative risk).
The classifier is linear in features of a text's form: how its words look, how often they repeat.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_filter, arrow_map, bounded, remainder, sample

SHAPES = 256
DENSE = 7
WIDTH = SHAPES + DENSE
CACHE = 300_000
SPAN = 256  # words over which repetition is measured
_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+"))

_shapes: dict[str, int] = {}


def _shape(word: str) -> int:
    """Number of a word's form: case of its letter runs, digits, marks (runs as two)."""
    def case(m: re.Match) -> str:
        run = m.group()
        return "x" if run.islower() else "Xx" if run[1:].islower() else "XX" if run.isupper() and len(run) > 1 else "X"

    form = _RUNS[2].sub(r"\1\1", _RUNS[1].sub("0", _RUNS[0].sub(case, word)))
    return zlib.crc32(form.encode()) % SHAPES


def features(text: str | None) -> np.ndarray:
    """Shares of word forms, and repetition, variety, length and marks; all in 0..1 or near."""
    out = np.zeros(WIDTH, np.float32)
    words = (text or "").split()
    if not words:
        out[-1] = 1
        return out
    if len(_shapes) > CACHE:
        _shapes.clear()
    _shapes.update((w, _shape(w)) for w in set(words) if w not in _shapes)
    n = len(words)
    out[:SHAPES] = np.sqrt(np.bincount(np.fromiter(map(_shapes.__getitem__, words), np.int64, n), minlength=SHAPES) / n)
    spans = [words[i:i + SPAN] for i in range(0, n, SPAN)]
    variety = np.array([len(set(s)) / len(s) ** 0.9 for s in spans])
    sizes = np.array([len(s) for s in spans])
    out[SHAPES] = min(2.0, float(variety @ sizes / n))
    out[SHAPES + 1] = float(variety.min())
    out[SHAPES + 2] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[SHAPES + 3] = min(1.0, np.log1p(n) / 12)
    letters = sum(map(len, words))
    out[SHAPES + 4] = min(2.0, letters / n / 10)
    out[SHAPES + 5] = text.count("\n") / n
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; ``gradient`` maps weights (the last is the bias) to their gradient."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def estimate_prior(good: np.ndarray, mixed: np.ndarray, steps: int = 200) -> float:
    """Share of good texts among ``mixed``: the smallest ratio of tail shares, on halves not trained on.

    A classifier of good against mixed texts orders both; at the top of that order only good texts are left.
    """
    if not len(good) or not len(mixed):
        return 0.5
    x, u = good[::2], mixed[::2]
    if not len(good[1::2]) or not len(mixed[1::2]):
        return 0.5

    def gradient(w: np.ndarray) -> np.ndarray:
        a, b = -_sigmoid(-(x @ w)) / len(x), _sigmoid(u @ w) / len(u)
        return x.T @ a + u.T @ b + 1e-3 * w

    w = _descend(gradient, good.shape[1], steps, 0.05)
    p, q = np.sort(good[1::2] @ w), np.sort(mixed[1::2] @ w)
    cuts = np.quantile(p, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_q = 1 - np.searchsorted(q, cuts) / len(q)
    slack = np.sqrt(np.log(8) / 2 / len(p)) + np.sqrt(np.log(8) / 2 / len(q))
    best = int(np.argmin((above_q + slack) / above_p))
    return float(np.clip(above_q[best] / above_p[best], 0.01, 0.99))


def solve(good: np.ndarray, mixed: np.ndarray, prior: float | None = None, steps: int = 600,
          decay: float = 3e-4) -> Model:
    """Minimise the non-negative risk on feature rows of good and of unlabelled texts."""
    both = np.concatenate((good, mixed)) if len(good) + len(mixed) else np.zeros((1, WIDTH))
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)

    def ready(x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))), 1)

    p, u = ready(good.reshape(-1, both.shape[1])), ready(mixed.reshape(-1, both.shape[1]))
    prior = estimate_prior(p, u) if prior is None else prior
    if not len(p) or not len(u):
        return Model(mean, scale, np.zeros(both.shape[1]), 0.0, prior)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        # logistic losses: of calling good ones good, good ones bad, unlabelled ones bad
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_bad = u.T @ (_sigmoid(zu) / len(u)) - prior * (p.T @ (_sigmoid(zp) / len(p)))
        if bad < 0:
            return -g_bad
        g_good = prior * (p.T @ (-_sigmoid(-zp) / len(p)))
        return g_good + g_bad + decay * np.append(w[:-1], 0)

    w = _descend(gradient, p.shape[1], steps, 0.03)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _rows(docs: DataFrame, limit: int) -> np.ndarray:
    """Features of about ``limit`` different rows of ``docs`` (doc_id, text), twice that at most, by a hash of both."""
    def of(batch: pa.RecordBatch) -> dict:
        return {"h": batch.column(1), "f": pa.array([features(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())}

    h = F.xxhash64("doc_id", "text", F.lit(7))
    count = docs.agg(F.approx_count_distinct(h)).first()[0]
    share = F.shiftrightunsigned(h, 11) / float(1 << 53)
    drawn = docs.where(share < limit / max(1, count)).select("text", h.alias("h"))
    # repeated rows shrink to one once they are features, which are short
    held = bounded(arrow_map(drawn, of, "h bigint, f binary").dropDuplicates(["h"]), "h", 2 * limit).collect()
    return np.array(sorted(np.frombuffer(r["f"], np.float32).tolist() for r in held), np.float64).reshape(-1, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, limit: int = 6000) -> Model:
    """Learn from ``labels`` (doc_id, quality) and ``docs`` (doc_id, text), leaving out the held fold of both.

    About ``limit`` different rows marked good and as many unlabelled ones, twice that at most. Ids
    marked both good and bad are not trusted; NULL labels count as none. However often a row or an id is repeated, a
    row counts once.
    """
    marks = labels.where((remainder("doc_id", folds) != held) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("q"))
    trusted = sample(marks.where("q = 1").select(F.col("doc_id").alias("_id")), 2 * limit, "_id")
    learn = docs.where(remainder("doc_id", folds) != held)
    # the trusted ids are bounded, so the texts stay where they are
    good = learn.join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left_semi")
    shuffled = np.random.default_rng(5).permutation
    p, u = _rows(good, limit), _rows(learn, limit)
    return solve(p[shuffled(len(p))], u[shuffled(len(u))])


def assess(docs: DataFrame, model: Model, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text; others are ignored).

    NULL and empty texts get the score of a text without words. NULL ids and repeated rows stay; no
    rows give none. With nothing to learn from every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def of(batch: pa.RecordBatch) -> dict:
        s = shared.value.scores(np.array([features(t) for t in batch.column(2).to_pylist()], np.float64))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(s, pa.float64()),
                "predicted": pa.array((s >= least).astype(np.int32), pa.int32())}

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "text"), of,
                     f"doc_id {kind}, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns.

    NULL and empty texts score as texts without words; texts are read whole. Repeated rows stay or go together; with nothing
    to learn from every score is 0.5. No rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str | None]) -> list[bool]:
        return (shared.value.scores(np.array([features(t) for t in texts], np.float64)) >= least).tolist()

    return arrow_filter(docs, "text", keep)
