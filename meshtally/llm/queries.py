"""The registered queries of the operators here, over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.llm import (
    codes, decontaminate, language, lexical, metric_tree, neighbours, packing, quality, sharding, simhash, tokens,
    toxicity, warc)
from meshtally.llm.common import ready

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, seed=42, bits=4)
    return same.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), count=8, law="bytes")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, size=4096, end=1)[0]


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer, limit=512)


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(language.learning_rows(docs)))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"), link=0.98).rows


@query("op1_warc", """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages),
    h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id < head THEN head END AS refers_to
    FROM p LEFT JOIN h USING (payload_digest)
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


@query("op11_lexical", r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
    t AS (
        SELECT r, doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM d),
    docs AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY ALL),
    whole AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS docs_l FROM docs),
    tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
    q AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark) GROUP BY ALL),
    w AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs_n + 2) / (2 * df + 1))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), whole),
    scored AS (
        SELECT item_id, r, doc_id, CAST(sum(times * w * (
            (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs_n) // docs_l)))) AS BIGINT) AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN docs USING (r), whole GROUP BY ALL),
    ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
            doc_id, score
        FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 10
""")
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op12_metric_tree", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
            vec_id, score
        FROM scored)
    SELECT * FROM ranked WHERE rank <= 20
""")
def op12_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.search(table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks of each round as tables of their own."""
    assigned = """
        SELECT w.pos, w.part, w.weight, arg_min(b.entry, {{a: d.away, b: b.entry}}) AS entry, min(d.away) AS away
        FROM w JOIN book{i} b USING (pos), LATERAL (SELECT list_inner_product(w.part, w.part)
            - 2 * list_inner_product(w.part, b.part) + list_inner_product(b.part, b.part) AS away) d
        GROUP BY ALL"""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED ({assigned.format(i=i)})")
        if i < rounds:
            steps.append(f"""
        mean{i} AS (
            SELECT pos, entry, i, sum(weight * CAST(part[i] AS BIGINT)) AS s, sum(weight) AS n
            FROM near{i}, range(1, len(part) + 1) AS x(i) GROUP BY ALL),
        list{i} AS (
            SELECT pos, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS part
            FROM mean{i} GROUP BY ALL),
        book{i + 1} AS MATERIALIZED (
            SELECT pos, entry, coalesce(l.part, b.part) AS part FROM book{i} b LEFT JOIN list{i} l USING (pos, entry))""")
    return f"""
    WITH v AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (
        SELECT vec_id, label, pos, v[pos * (len(v) // 4) + 1:(pos + 1) * (len(v) // 4)] AS part
        FROM v, range(4) AS x(pos)),
    w AS MATERIALIZED (SELECT pos, part, count(*) AS weight FROM p GROUP BY ALL),
    book0 AS MATERIALIZED (
        SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part
        FROM p QUALIFY entry < 256),
    {", ".join(steps)},
    coded AS (
        SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(away) AS BIGINT) AS error
        FROM p JOIN near{rounds} USING (pos, part) GROUP BY ALL),
    digest AS (
        SELECT sha256(string_agg(array_to_string(list_transform(part, lambda x: CAST(x AS BIGINT)), ','), ','
            ORDER BY pos, entry)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded, digest
"""


@query("op13_codes", _codes_sql())
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), scale=1024, entries=256, parts=4, rounds=4)
