"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import re
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from meshtally.llm import (  # noqa: E402
    decontaminate, language, neighbours, packing, quality, sharding, simhash, tokens, toxicity, warc)
from meshtally.llm.common import ready  # noqa: E402
from meshtally.llm.components import components  # noqa: E402
from meshtally.llm.queries import QUERIES, SQL  # noqa: E402
from tools.check_queries import connect, differences, duck_rows, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string, fp string"
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def sp(spark):
    return ready(spark)


@pytest.fixture(scope="module")
def docs(sp):
    """Real texts, with NULLs, empty, very long and repeated rows and columns of clashing names."""
    texts = [r["text"] for r in sp.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en", "s", len(t), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "s", 0, None, None, None),
             (102, LONG, "en", "s", 1, None, None, None), (103, texts[0], "fr", "s", 1, None, None, None),
             (0, texts[0], "en", "s", 1, None, None, None), (None, texts[1], "en", "s", 1, None, None, None),
             (None, "12 34 !?", None, "s", 1, None, None, None), (104, LONG, "en", "s", 1, None, None, None),
             (105, "one two", None, "s", 1, None, None, None), (106, " \n\t", None, "s", 1, None, None, None)]
    return sp.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(sp):
    return sp.createDataFrame([], DOCS)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- components

def test_components_chain_star_and_rubbish(sp):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 900), (None, 3), (7, None)]
    got = dict(components(sp.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect())
    assert got == {**{i: 0 for i in range(101)}, **{500 + i: 500 for i in range(200)}}
    assert components(sp.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 WARC

PAGES = "page_id bigint, url string, html string, key string, digest string"


def brute_warc(rows):
    heads = {}
    for p, _, h, *_ in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and p is not None:
            heads[h] = max(heads.get(h, p), p)
    out = []
    for p, _, h, *_ in rows:
        h = (h or "").encode()
        head = heads.get(h)
        again = head is not None and (p is None or p < head)
        out.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


def test_warc_round_trip(sp, tmp_path):
    big, other = "ü" * 500, "b" * 999
    rows = [(i, f"http://www.h{i % 3}.org/p{i}", big if i % 2 else f"<p>{i}</p>", "k", None) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "", None, None), (52, "http://x.org/\r\nA: b", other, None, None),
             (53, "http://x.org/ü", other, None, None), (None, "http://a.org", big, None, None),
             (39, "http://a.org", big, None, None), (39, "http://a.org", big, None, None),
             (54, "http://long.org", LONG, None, None), (None, None, None, None, None)]
    df = sp.createDataFrame(rows, PAGES).repartition(3)
    got = warc.archive_and_read(df, str(tmp_path / "a"))
    assert sorted(map(tuple, got.drop("url").collect()), key=repr) == brute_warc(rows)
    assert warc.archive_and_read(df.limit(0), str(tmp_path / "b")).count() == 0


def test_warc_lookup_reads_only_wanted_keys(sp, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    rows = [(i, f"http://h{i % 11}.org/{i % 5}", f"page {i}") for i in range(500)]
    captures = warc.write_archives(sp.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "c"))
    index = warc.build_index(captures, str(tmp_path / "c"), shards=6)
    assert len(index.files) > 1
    keys = [warc.url_key("http://h3.org/2"), warc.url_key("http://h10.org/4"), "none,such)/", None]
    found = warc.lookup(sp.createDataFrame([(k,) for k in keys], "key string"), index)
    got = sorted(r["payload"].decode() for r in warc.read_records(found, payload=True).collect())
    assert got == sorted(f"page {i}" for i in range(500) if (i % 11, i % 5) in ((3, 2), (10, 4)))


def test_warc_standard_parts():
    member = warc.record(7, "http://a.org/x", b"hello", hashlib.sha1(b"hello").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    assert warc.parse(member)["payload"] == b"hello"
    assert warc.url_key("https://User@WWW.Example.com:443/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("http://a.org:8080") == "org,a:8080)/" and warc.url_key(None) == ""
    bad = warc.record(7, None, b"hello", hashlib.sha1(b"hullo").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(bad)


# --- 2 SimHash

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links, ids):
    label = list(range(len(ids)))
    for _ in ids:
        new = [min((label[j] for j in range(len(ids)) if links[i][j]), default=i) for i in range(len(ids))]
        if new == label:
            break
        label = new
    least = {}
    for i, l in enumerate(label):
        if ids[i] is not None:
            least[l] = min(least.get(l, ids[i]), ids[i])
    return [least.get(l) for l in label]


def test_simhash_against_brute_force(docs):
    rows = texts_of(docs)
    prints = [brute_print(t) for _, t in rows]
    links = [[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]
    want = sorted(zip([i for i, _ in rows], prints, brute_components(links, [i for i, _ in rows])), key=repr)
    got = simhash.near_duplicates(docs, block=8).collect()
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=repr) == want


def test_simhash_shards_find_every_pair(sp):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [np.uint64(b) ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
            for b in base[:100] for n in (1, 4, 5)]
    prints = np.unique(np.concatenate((base, near)))
    df = sp.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint").repartition(3)
    got = components(simhash.near_links(df, 4, block=16)).collect()
    want = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    labels = {int(a): int(b) for a, b in got}
    signed = prints.view(np.int64)
    for i in range(len(prints)):
        linked = np.flatnonzero(want[i])
        if len(linked) > 1:
            assert len({labels[int(signed[j])] for j in linked}) == 1
        else:
            assert int(signed[i]) not in labels


def test_simhash_keeps_one_row_of_each(docs, empty):
    kept = simhash.one_of_each(docs, block=8)
    assert kept.columns == docs.columns
    found = {tuple(r)[:2] for r in simhash.near_duplicates(docs).select("component_id", "fp").distinct().collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({c for c, _ in found}) and ids.count(0) == 1 and 103 not in ids
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# --- 3 token counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(docs, empty):
    tokenizer = Tokenizer.from_file(BPE)
    want = sorted(((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512)
                   for i, t in texts_of(docs)), key=repr)
    assert sorted(map(tuple, tokens.token_counts(docs, BPE, chunk=997).collect()), key=repr) == want
    assert sorted(map(tuple, tokens.token_counts(docs, BPE).collect()), key=repr) == want
    assert tokens.token_counts(empty, BPE).count() == 0


def test_state_maps_compose_in_any_grouping():
    machine, tokenizer = tokens.Transducer.at(BPE), Tokenizer.from_file(BPE)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'", "12", "!", "é", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endof",
             "text|>", "　", "日本", "́", "\r\n", "᠎"]
    rng = np.random.default_rng(0)
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert machine.counts([text]) == [want]
        size = int(rng.integers(1, 8))
        maps = [machine.state_map(text[i:i + size]) for i in range(0, len(text), size)]
        if len(maps) > 2:
            right = machine.then(maps[0], machine.then(maps[1], maps[2]))
            left = machine.then(machine.then(maps[0], maps[1]), maps[2])
            assert machine.total(right) == machine.total(left)
        if maps:
            assert machine.total(machine.reduce(maps)) == want


def test_counts_come_from_the_merges(monkeypatch):
    """Parts of any bytes, read in order, against the library; and no library where tokens are counted."""
    machine, tokenizer = tokens.Transducer.at(BPE), Tokenizer.from_file(BPE)
    assert not hasattr(machine, "tokenizer")
    rng = np.random.default_rng(1)
    parts = sorted({"".join(rng.choice(list("abehinorst"[:rng.integers(1, 11)]), rng.integers(1, 60))) for _ in range(800)})
    want = [len(tokenizer.encode(p, add_special_tokens=False).ids) for p in parts]
    assert machine.merges.read([p.encode() for p in parts]) == want
    text = "".join(chr(c) for c in rng.integers(0x20, 0x2fff, 60000))
    assert machine.counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]


def test_long_texts_without_blanks_take_linear_time(sp):
    machine, tokenizer = tokens.Transducer.at(BPE), Tokenizer.from_file(BPE)
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghij"), 1_500_000))
    spent = []
    for size in (len(text) // 4, len(text)):
        maps = [machine.state_map(text[i:i + 4096]) for i in range(0, size, 4096)]
        machine.parts.clear()
        machine.emits.clear()
        start = time.perf_counter()
        n = machine.total(machine.reduce([*maps[:-1], machine.state_map(text[(len(maps) - 1) * 4096:size])]))
        spent.append(time.perf_counter() - start)
        assert n == len(tokenizer.encode(text[:size], add_special_tokens=False).ids)
    assert spent[1] < 8 * spent[0]
    df = sp.createDataFrame([(1, text[:400_000]), (2, text[:400_000]), (3, "日本" * 50_000)], "doc_id bigint, text string")
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text[:400_000], text[:400_000], "日本" * 50_000)]
    got = tokens.token_counts(df, BPE, chunk=10_000).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == want


# --- 4 toxicity, 5 quality, 7 language: held-out accuracy

def test_toxicity_learns(sp):
    rng = np.random.default_rng(2)
    clean, bad = [f"word{i}" for i in range(200)], ["nasty", "vile", "foul"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 40))
        if i % 4 == 0:
            words += list(rng.choice(bad, 1 + i % 5))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    d, l = sp.createDataFrame(rows, "doc_id bigint, text string"), sp.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(d, l)
    got = {r["doc_id"]: r for r in toxicity.grade(d, model).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and np.mean([got[i]["toxic"] == int(i % 4 == 0) for i in held]) > 0.95
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert list(model.cuts) == sorted(model.cuts)
    severe = np.mean([got[i]["severity"] for i in got if i % 4 == 0 and i % 5 == 4])
    assert severe > np.mean([got[i]["severity"] for i in got if i % 4 == 0 and i % 5 == 0]) > 0.5


def test_ordinal_gradient_against_differences():
    """One Adam step from zero follows the sign of the numeric gradient of the likelihood."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(60)]
    grades = rng.integers(0, 4, 60)
    weight = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())

    def loss(x):
        w, cuts = x[:6], x[6:]
        total = 0.0
        for held, g, own in zip(rows, grades, weight):
            over = [1.0, *(1 / (1 + np.exp(cuts - w[held].sum()))), 0.0]
            total -= own * np.log(over[g] - over[g + 1])
        return total

    x = np.array([0.0] * 6 + [1.0, 2.0, 3.0])
    numeric = np.array([(loss(x + e) - loss(x - e)) / 2e-5 for e in np.eye(9) * 1e-5])
    w, cuts = toxicity.solve(rows, grades, 6, steps=1, rate=0.01, shrink=0.0)
    step = np.concatenate((w, cuts - [1.0, 2.0, 3.0]))
    assert (np.sign(step) == -np.sign(numeric)).all() and np.allclose(np.abs(step[:6]), 0.01, rtol=0.1)
    far = toxicity.solve(rows, grades, 6, steps=600, rate=0.02, shrink=0.0)
    assert loss(np.concatenate(far)) < loss(x)


def test_non_negative_risk_by_hand():
    """The solution is near a minimum of the risk as its definition reads, found without its gradient."""
    rng = np.random.default_rng(6)
    good, mixed = rng.normal(1, 1, (200, 2)), np.concatenate((rng.normal(1, 1, (60, 2)), rng.normal(-1, 1, (140, 2))))
    model = quality.solve(good, mixed, prior=0.3, steps=1500, decay=0.0)

    def risk(w, b):
        ready = lambda x: np.clip((x - model.mean) / model.scale, -6, 6) @ w + b
        zp, zu = ready(good), ready(mixed)
        bad = np.log1p(np.exp(zu)).mean() - 0.3 * np.log1p(np.exp(zp)).mean()
        return 0.3 * np.log1p(np.exp(-zp)).mean() + max(0.0, bad)

    best = risk(model.weights, model.bias)
    for _ in range(300):
        assert risk(model.weights + rng.normal(0, 0.3, 2), model.bias + rng.normal(0, 0.3)) > best - 2e-3
    assert abs(quality.estimate_prior(np.c_[good, np.ones(200)], np.c_[mixed, np.ones(200)]) - 0.3) < 0.25


def test_kernel_twin():
    """Outputs through the folded matrix are those of kernels counted n-gram by n-gram."""
    texts = [b"the cat sat on the mat", b"Der Hund sa\xc3\x9f im Garten", b"le chat est sur la table", b"a cat and the dog",
             b"die Katze im Haus", b"la table est l\xc3\xa0", b"x", b"", bytes(range(256)) * 40]
    labels = ["en", "de", "fr", "en", "de", "fr", "en", "de", "fr"]

    def grams(t):
        return {t.lower()[i:i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / np.sqrt(max(1, len(grams(a))) * max(1, len(grams(b))))

    marks = texts[:6]
    for t in texts:
        assert len(language.presence(t)) == len(grams(t))
    sets = language.Landmarks([language.presence(t) for t in marks])
    k = np.array([[kernel(t, m) for m in marks] for t in texts])
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    assert np.allclose(sets.kernels([language.presence(t) for t in texts]), k)
    model = language.solve(sets, gram, k, labels, 0.1)
    # the same by hand: features whitened on the landmarks, one weighted ridge for each language
    values, vectors = np.linalg.eigh(gram)
    white = vectors / np.sqrt(values)
    f = k @ white
    w = np.array([9 / (3 * labels.count(l)) for l in labels])
    want = np.zeros((9, 3))
    for j, name in enumerate(["de", "en", "fr"]):
        y = np.where(np.array(labels) == name, 1.0, -1.0)
        fm, ym = (w @ f) / w.sum(), (w @ y) / w.sum()
        beta = np.linalg.solve((f - fm).T @ np.diag(w) @ (f - fm) + 0.1 * np.eye(6), (f - fm).T @ np.diag(w) @ (y - ym))
        want[:, j] = (f - fm) @ beta + ym
    assert np.allclose(model.outputs(texts), want, atol=1e-3)


def test_classifiers_on_awkward_rows(sp, docs, empty):
    none = sp.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for d in (docs, empty):
        assert {r["toxic"] for r in toxicity.grade(d, toxicity.fit(d, none)).collect()} <= {0}
        q = quality.assess(d, quality.fit(d, none))
        assert q.count() == d.count() and q.where("score is null or score not between 0 and 1").count() == 0
        assert {r["lang_pred"] for r in language.identify(d, language.fit(empty)).collect()} <= {"und"}
    marks = sp.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(60)] + [(3, 0, 1), (None, 1, 1), (4, None, None)],
                               "doc_id bigint, quality int, toxic int")
    assert toxicity.grade(docs, toxicity.fit(docs, marks)).count() == docs.count()
    assert quality.good_only(docs, quality.fit(docs, marks)).columns == docs.columns
    got = language.identify(docs, language.fit(docs)).where("score not between 0 and 1").count()
    assert got == 0
    und = [r["doc_id"] for r in language.identify(docs, language.fit(docs)).where("lang_pred = 'und'").collect()]
    assert sorted(und, key=repr) == sorted([100, 101, 106, None], key=repr)


@pytest.mark.parametrize("name,fold,held", [("op5_quality", 4, 2), ("op7_language", 5, 0)])
def test_held_out_accuracy(sp, name, fold, held):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES[name](sp, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % fold == held) for i, r in got.items())
    if name == "op7_language":
        true = {r["doc_id"]: r["lang"] for r in sp.read.parquet(f"{sf}/documents.parquet").collect()}
        right = [got[i]["lang_pred"] == v for i, v in true.items() if got[i]["held_out"]]
    else:
        true = {r["doc_id"]: r["quality"] for r in sp.read.parquet(f"{sf}/labels.parquet").collect()}
        right = [got[i]["predicted"] == v for i, v in true.items() if got[i]["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.97


def test_prior_is_estimated():
    rng = np.random.default_rng(3)
    good = np.concatenate((rng.normal(2, 1, (3000, 1)), np.ones((3000, 1))), 1)
    mixed = np.concatenate((rng.normal(2, 1, (2100, 1)), rng.normal(-2, 1, (900, 1))))
    mixed = np.concatenate((rng.permutation(mixed), np.ones((3000, 1))), 1)
    assert abs(quality.estimate_prior(good, mixed) - 0.7) < 0.06


def test_presence_kernel_is_a_count():
    a, b = language.presence(b"abcab"), language.presence(b"abcd")
    assert len(np.intersect1d(a, b)) == len({"ab", "bc", "abc"}) and len(language.presence(b"")) == 0
    text = b"The quick brown fox " * 200_000
    assert np.array_equal(language.presence(text), language.presence(b"The quick brown fox " * 4))


# --- 6 packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_whole(docs, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    places, cut = packing.pack(docs, WORDS, size=256)
    rows = places.collect()
    want = []
    for i, t in texts_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, n, a, len(p := ids[a:a + 256]), zlib.crc32(np.array(p, "<u4").tobytes()))
                 for n, a in enumerate(range(0, len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * sum(r["length"] for r in rows) / 256 + 1
    assert packing.pack(empty, WORDS)[0].count() == 0
    only = docs.where("doc_id < 50 and doc_id > 0")
    places, cut = packing.pack(only, WORDS, size=256)
    whole = packing.sequences(places, cut).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in places.collect())


def test_words_are_the_tokenizers():
    words, tokenizer = packing.Words(WORDS), Tokenizer.from_file(WORDS)
    parts = [" ", "\n", "\t", "a", "The", "'s", "'", "1", "²", "!", ".", ",", "_", "é", "É", "İ", "\xa0", "\x1c", "\x85", "<|endoftext|>",
             "<|ENDOFTEXT|>", "<|", "|", "　", "日", "́", "ß", "-", "#", "ǅ"]
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)] == want


def brute_sum_of_squares(counts, size):
    """Counts of open bins by gap, and of all bins, piece by piece."""
    n, new = [0] * (size + 1), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            best = None
            for g in [*(g for g in range(length, size) if n[g]), size]:
                after = {g: n[g] - 1} if g < size else {}
                if 0 < g - length < size:
                    after[g - length] = n[g - length] + 1
                change = sum(v * v - n[k] * n[k] for k, v in after.items())
                if best is None or change < best[0]:
                    best = (change, g)
            g = best[1]
            new += g == size
            n[g] -= g < size
            n[g - length] += 0 < g - length < size
    return n[1:size], new


@pytest.mark.parametrize("few", [0, 200])
def test_sum_of_squares_is_that_of_piece_by_piece(monkeypatch, few):
    monkeypatch.setattr(packing.Gaps, "FEW", few)
    rng = np.random.default_rng(3)
    for size, most, total in ((32, 32, 900), (32, 9, 1500), (40, 40, 600), (24, 3, 900), (30, 15, 1200)):
        lengths = rng.integers(1, most + 1, total) if few else rng.choice([1, 2, 5, most, max(1, most // 2)], total)
        values, numbers = np.unique(lengths, return_counts=True)
        counts = dict(zip(values.tolist(), numbers.tolist()))
        runs = packing.sum_of_squares(counts, size)
        used, taken = {}, {}
        for length, first, many, sequence, offset in runs:
            assert first == taken.get(length, 0)  # ranks without holes
            taken[length] = first + many
            for s in range(sequence, sequence + many):
                assert used.get(s, 0) == offset
                used[s] = offset + length
        assert taken == counts
        open_bins = [0] * (size + 1)
        for full in used.values():
            open_bins[size - full] += 1
        want, new = brute_sum_of_squares(counts, size)
        assert (open_bins[1:size], len(used)) == (want, new)


def test_sum_of_squares_takes_counts_of_any_size():
    counts = {3000: 10 ** 9, 1096: 10 ** 9, 4096: 5, 1: 7}
    runs = packing.sum_of_squares(counts)
    assert sum(r[2] for r in runs) == sum(counts.values()) and len(runs) < 5000
    assert max(r[3] + r[2] for r in runs) <= 10 ** 9 + 5 + 2


# --- 8 decontamination

def test_decontamination_against_brute_force(sp, docs, empty):
    texts = [t for _, t in texts_of(docs) if t and len(t.split()) > 30]
    items = [(0, " ".join(texts[3].split()[5:30])), (1, " ".join(texts[4].split()[2:9])), (2, None), (3, ""), (4, "..."),
             (5, "Lorem, IPSUM; dolor"), (10, "lorem ipsum dolor"), (None, "two"), (5, "one")]
    bench = sp.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, spans string")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add("" if i is None else str(i))
    want = []
    for i, t in texts_of(docs):
        w, hit, found = split(t), set(), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs, bench)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_items > 0").count() == 0
    spans = decontaminate.contamination(docs, bench, spans=True).where("doc_id = 105").first()
    assert [tuple(s) for s in spans["spans"]] == [(0, 7)]


def test_decontamination_in_blocks(sp, docs, monkeypatch):
    bench = sp.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "PATTERNS", 50)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr) == whole


# --- 9 neighbours

def brute_links(every):
    """(vec_id, n_links, component_id, kept) per row (vec_id, vector, label)."""
    def usable(v, label):
        return bool(label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v))

    n = len(every)
    links = np.zeros((n, n), bool)
    units = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if usable(r[1], r[2]) else None for r in every]
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and every[i][2] == every[j][2] \
                    and len(units[i]) == len(units[j]):
                links[i, j] = units[i] @ units[j] >= 0.98
    comp = brute_components((links | np.eye(n, dtype=bool)).tolist(), [r[0] for r in every])
    return sorted(((r[0], int(links[i].sum()), comp[i], r[0] == comp[i]) for i, r in enumerate(every)), key=repr)


def link_rows(found):
    return sorted(map(tuple, found.rows.drop("recall").collect()), key=repr)


def test_neighbours_with_one_large_component(sp):
    """Small components decide here, next to one that is 250 times larger."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-0.004, 0.004, (40, 768))
    x[:, 5] = 1.0
    far = rng.standard_normal((30, 768))
    every = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(np.concatenate((x, far)))]
    found = neighbours.near_vectors(sp.createDataFrame(every, "vec_id bigint, embedding array<float>, label int"))
    want = brute_links(every)
    assert sum(r[1] for r in want) == 40 * 39
    assert link_rows(found) == want and found.rows.first()["recall"] > 0.9


def test_neighbours_fall_back_to_the_exact_search(sp, monkeypatch):
    """Lists that are too short for dense labels, and no more rounds: nothing is lost, on either end of a link."""
    monkeypatch.setattr(neighbours, "LONGEST", 2)
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((40, 24))
    x = middles[rng.integers(0, 40, 600)] + 0.06 * rng.standard_normal((600, 24))
    every = [(i, [float(np.float32(c)) for c in v], int(i % 2)) for i, v in enumerate(x)]
    df = sp.createDataFrame(every, "vec_id bigint, embedding array<float>, label int").repartition(4)
    short = neighbours.near_vectors(df, k=2, most=2, orders=1, rounds=1)
    assert link_rows(short) == brute_links(every) and short.recall == 1.0
    some = neighbours.near_vectors(df, k=4, most=8, orders=2, rounds=4, recall=0.0)  # only saturated vectors ask
    got, want = {r[0]: r for r in link_rows(some)}, {r[0]: r for r in brute_links(every)}
    assert sum(r[1] for r in got.values()) >= 0.9 * sum(r[1] for r in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)


def test_neighbours_against_brute_force(sp):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    crowd = base[0] + 0.02 * rng.standard_normal((120, 16))
    pairs = base[1:40] + 0.05 * rng.standard_normal((39, 16))
    x = np.concatenate((base, crowd, pairs, base[:30], base[:5] * 3)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3, "x") for i, v in enumerate(x)]
    odd = [(1000, None, 1, "x"), (1001, [0.0] * 16, 1, None), (1002, [float("nan")] * 16, 1, None),
           (1003, [1.0] + [None] * 15, 1, None), (1004, x[0].tolist(), None, None), (1005, [], 1, None),
           (1006, [1.0, 2.0], 1, None), (1007, [2.0, 4.0], 1, None), (1006, [1.0, 2.0], 1, None),
           (None, x[2].tolist(), 2, None), (1008, [float("inf")] * 16, 1, None)]
    df = sp.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int, n_links string").repartition(3)
    found = neighbours.near_vectors(df, most=24)
    assert found.recall > 0.9
    assert link_rows(found) == brute_links([r[:3] for r in rows + odd])
    assert neighbours.near_vectors(df.limit(0)).rows.count() == 0


# --- 10 sharding

@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(sp, docs, empty, law):
    rows = sharding.shards(docs, count=3, law=law, keep=("text",)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(texts_of(docs), key=repr)
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
    by = {k: [r for r in rows if r["shard"] == k] for k in range(3)}
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    weight = [sum(r["size"] if law == "bytes" else 1 for r in own) for own in by.values()]
    slack = max(r["size"] for r in rows) if law == "bytes" else 1
    assert max(weight) - min(weight) <= 2 * slack if law == "bytes" else max(weight) - min(weight) <= 1
    assert sharding.shards(empty, law=law).count() == 0


def test_shards_of_one_hot_text_and_no_python(sp):
    rows = sp.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 20), concat('t', id)) as text")
    out = sharding.shards(rows, count=8)
    sizes = [r[0] for r in out.groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 81
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sharding.shards(rows, law="colour")


# --- registered queries

@pytest.mark.parametrize("name", list(SQL))
def test_queries_with_sql(sp, name):
    assert differences(spark_rows(QUERIES[name](sp, SF)), duck_rows(connect(SF), SQL[name])) is None


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


# --- pipeline

def test_pipeline(sp):
    import corpus_pipeline as pipeline

    docs = before = sp.read.parquet(f"{SF}/documents.parquet").cache()
    kept = {}
    for name, stage in pipeline.STAGES:
        after = stage(sp, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == before.columns
            after = after.cache()
        kept[name] = (docs, after)
        docs = after
    was, now = kept["simhash_near_dedup"]
    ids = {r["component_id"] for r in simhash.near_duplicates(was).collect()}
    assert {r["doc_id"] for r in now.collect()} == ids and now.count() == len(ids)
    was, now = kept["benchmark_decontamination"]
    marks = decontaminate.contamination(was, sp.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in marks.where("not contaminated").collect()}
    packed = kept["best_fit_packing"][1]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in now.collect()}
    truth = {r["doc_id"]: r["quality"] for r in sp.read.parquet(f"{SF}/labels.parquet").collect()}
    was, now = kept["quality_classifier"]
    stay = {r["doc_id"] for r in now.collect()}
    known = [r["doc_id"] for r in was.collect() if r["doc_id"] in truth]
    assert np.mean([(i in stay) == (truth[i] == 1) for i in known]) > 0.9
    assert pipeline.run(sp, SF).count() == packed.count()
