"""Lexical search, metric search and vector codes against brute force, with awkward rows."""

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from meshtally.llm import codes, lexical, metric_tree  # noqa: E402
from meshtally.llm.common import ready  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, score string, row string, part string"


@pytest.fixture(scope="module")
def sp(spark):
    return ready(spark)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- 11 lexical search

def brute_search(docs, items, k):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                          re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    docs = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n = len(docs)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) *
                        ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


DOCS = "doc_id bigint, text string, item string, key string, score string, rank string"


def awkward_docs(sp):
    texts = [r["text"] for r in sp.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    rows = [(i, t, "x", "y", "z", None) for i, t in enumerate(texts)]
    rows += [(200 + i, texts[3], None, None, None, None) for i in range(40)]  # ties
    rows += [(7, texts[7], None, None, None, None)] * 3 + [(None, texts[5], None, None, None, None)] * 2
    rows += [(300, None, None, None, None, None), (301, "", None, None, None, None), (302, " ?! ", None, None, None, None),
             (303, "Élan ÉLAN élan zoo Zoo ZOO " * 5000, None, None, None, None), (304, "zoo", None, None, None, None),
             (305, " ".join(f"w{i}" for i in range(30000)) + " zoo", None, None, None, None)]
    items = [(1, texts[3][:200]), (2, texts[7][-150:] + " zoo"), (3, None), (4, ""), (5, "...") , (6, "zoo élan Élan w77"),
             (None, texts[5][:80]), (6, "zoo élan Élan w77"), (8, "nowhere at all qqqq"), (9, texts[10] or "a")]
    return rows, items


@pytest.mark.parametrize("block,batch", [(512, 128 << 10), (16, 100)])
def test_lexical_search(sp, monkeypatch, block, batch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "BATCH", batch)
    rows, items = awkward_docs(sp)
    df = sp.createDataFrame(rows, DOCS).repartition(4)
    queries = sp.createDataFrame([(i, t, "a", "b") for i, t in items], "item_id bigint, text string, doc_id string, key string")
    got = sorted_rows(lexical.search(df, queries, 10), "item_id", "rank", "doc_id", "score")
    assert got == brute_search([r[:2] for r in rows], items, 10)


def test_lexical_empty_tables(sp):
    rows, items = awkward_docs(sp)
    df, queries = sp.createDataFrame(rows, DOCS), sp.createDataFrame(items, "item_id bigint, text string")
    assert lexical.search(df.limit(0), queries).count() == 0
    assert lexical.search(df, queries.limit(0)).count() == 0
    assert lexical.search(df.where("doc_id in (300, 301, 302)"), queries).count() == 0


def test_bounds_hold_and_exclude(sp):
    rows, items = awkward_docs(sp)
    index = lexical.build_index(sp.createDataFrame(rows, DOCS))
    batch = next(lexical.batches(sp.createDataFrame(items, "item_id bigint, text string")))
    lexical.weigh(batch, index)
    hashes = np.array([lexical.xxhash.xxh3_64_intdigest(t) for t in batch.terms], np.uint64)
    scores = {(i, d): s for i, _, d, s in brute_search([r[:2] for r in rows], items, 10**6) if d is not None}
    keys = {r["key"]: r["doc_id"] for r in lexical._keyed(sp.createDataFrame(rows, DOCS)).collect()}
    loose = 0
    for block in index.blocks.collect():
        bound = lexical.bounds(block.asDict(), batch, hashes, index.n, index.length)
        for item, own in zip([b[0] for b in batch.items], bound.tolist()):
            for key, b in zip(block["keys"], own):
                assert b >= scores.get((item, keys[key]), 0)
                loose += b > 0 and (item, keys[key]) not in scores
    assert loose < 0.1 * sum(len(b["keys"]) for b in index.blocks.collect()) * len(batch.items)


# --- 12 metric tree

def brute_nearest(rows, k, every, scale):
    kept = [(v, [math.floor(scale * float(np.float32(x))) for x in e]) for v, e, *_ in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(x, y)), v is None, v or 0, v)
                         for j, (v, y) in enumerate(kept) if j != i), key=lambda s: s[:3])
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return sorted(out, key=repr)


def awkward_vectors(seed=0, n=400, width=8):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((6, width))
    rows = [(i, (middles[i % 6] + rng.standard_normal(width) * 0.1).tolist(), i % 3) for i in range(n)]
    rows += [(1000 + i, rows[20][1], None) for i in range(60)]  # copies: ties
    rows += [(20, rows[40][1], 1)] * 2 + [(None, rows[0][1], 1)] * 2
    rows += [(2000, None, 1), (2020, [], 1), (2040, [0.0] * width, None), (2060, [1.0, None] + [0.0] * (width - 2), 1),
             (2080, [float("nan")] * width, 1), (2100, [float("inf")] * width, 1), (2120, [1.0, -2.0], 0),
             (2140, [-1e-9] * width, 0), (2160, [300.0] * width, 0)]
    return [(v, e, label, "a", "b", "c") for v, e, label in rows]


@pytest.mark.parametrize("part,page", [(4096, 128), (50, 7)])
def test_metric_tree(sp, monkeypatch, part, page):
    monkeypatch.setattr(metric_tree, "PART", part)
    monkeypatch.setattr(metric_tree, "PAGE", page)
    monkeypatch.setattr(metric_tree, "ASK", part)
    rows = awkward_vectors()
    df = sp.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted_rows(metric_tree.search(df, 20, 64, 20), "query_id", "rank", "vec_id", "score")
    assert got == brute_nearest(rows, 20, 20, 64)


def test_metric_tree_small_tables(sp):
    df = sp.createDataFrame(awkward_vectors(n=60), VECTORS)
    assert metric_tree.search(df.limit(0)).count() == 0
    assert metric_tree.search(df.where("vec_id = 0")).count() == 0
    few = [r for r in awkward_vectors(n=60) if r[0] is not None and r[0] < 6]
    got = sorted_rows(metric_tree.search(df.where("vec_id < 6")), "query_id", "rank", "vec_id", "score")
    assert got == brute_nearest(few, 20, 20, 64)
    wide = [(i, [float(x) for x in np.random.default_rng(i).integers(-10**7, 10**7, 5)], 0, "", "", "") for i in range(60)]
    got = sorted_rows(metric_tree.search(sp.createDataFrame(wide, VECTORS.replace("float", "double"))),
                      "query_id", "rank", "vec_id", "score")
    assert got == brute_nearest([(v, [np.float64(x) for x in e]) for v, e, *_ in wide], 20, 20, 64)


def test_stored_bounds_spare_products(sp):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((20, 16)) * 3
    rows = [(i, (middles[i % 20] + rng.standard_normal(16) * 0.05).tolist(), 0, "", "", "") for i in range(2000)]
    tree = metric_tree.build_tree(sp.createDataFrame(rows, VECTORS), 64)
    pages = [r.asDict() for r in tree.pages.collect()]
    vectors = tree.vectors.collect()
    x = tree.space.unpack(pa.array([bytes(r["vector"]) for r in vectors], pa.binary()))
    at = np.arange(0, 2000, 20)
    best, products = metric_tree.search_part(
        tree.space, tree.routes[0], pages, x[at], np.array([vectors[i]["row"] for i in at]), np.full(len(at), metric_tree.NONE), 20)
    assert products < 0.5 * len(at) * len(x)
    exact = np.sort(np.where(np.arange(2000)[None, :] == at[:, None], -10**9, x[at].astype(np.int64) @ x.astype(np.int64).T))
    assert (best.score == exact[:, :-21:-1]).all()


# --- 13 codes

def brute_codes(rows, scale=1024, entries=256, parts=4, rounds=4):
    kept = [(v, [math.floor(scale * float(np.float32(x))) for x in e], label) for v, e, label, *_ in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max(len(x) for _, x, _ in kept) // parts)
    kept = [(v, x + [0] * (width * parts - len(x)), label) for v, x, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = [[tuple(x[p * width:(p + 1) * width]) for p in range(parts)] for _, x, _ in kept]
    books = [[list(x[p * width:(p + 1) * width]) for _, x, _ in first] for p in range(parts)]

    def near(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(e, part)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            memo = {part: near(books[p], part)[1] for part in {c[p] for c in cut}}
            for c in cut:
                held.setdefault(memo[c[p]], []).append(c[p])
            for i, own in held.items():
                books[p][i] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    memo = [{part: near(books[p], part) for part in {c[p] for c in cut}} for p in range(parts)]
    found = [(v, "".join(f"{memo[p][c[p]][1]:02x}" for p in range(parts)), sum(memo[p][c[p]][0] for p in range(parts)), label)
             for (v, _, label), c in zip(kept, cut)]
    total = Counter()
    for _, _, error, label in found:
        total[label] += error
    return sorted(((v, code, error, total[label], digest) for v, code, error, label in found), key=repr)


OUT = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("width", [8, 6])
def test_codes(sp, monkeypatch, width):
    monkeypatch.setattr(codes, "LEAVES", 16)
    rows = awkward_vectors(1, 300, width)
    df = sp.createDataFrame(rows, VECTORS).repartition(4)
    assert sorted_rows(codes.compress(df), *OUT) == brute_codes(rows)


def test_codes_small_tables(sp):
    df = sp.createDataFrame(awkward_vectors(), VECTORS)
    assert codes.compress(df.limit(0)).count() == 0
    assert codes.compress(df.where("vec_id = 2000")).columns == list(OUT)
    empty = codes.compress(df.where("vec_id = 2020")).first()
    assert (empty["code"], empty["error"]) == ("00000000", 0)
    few = [r for r in awkward_vectors() if r[0] is not None and r[0] < 9]
    assert sorted_rows(codes.compress(df.where("vec_id < 9")), *OUT) == brute_codes(few)
    far = sp.createDataFrame([(1, [1e300])], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS label")
    with pytest.raises(Exception):
        codes.compress(far).collect()


@pytest.mark.parametrize("kind", [np.int32, np.float64, np.int64])
def test_trie_shares_prefixes(kind):
    rng = np.random.default_rng(2)
    parts = np.unique(rng.integers(-3, 4, (700, 5)), axis=0)
    entries = rng.integers(-4, 5, (32, 5))
    index, error = codes.nearest(parts, entries, kind)
    away = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == away.argmin(1)).all() and (error == away.min(1)).all()
