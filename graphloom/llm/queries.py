"""The thin queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, fingerprints, langid, licenses, linededup, neardup, packing, secretscan, sharding, topk

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), BYTE_VOCABULARY)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85, bands=28, rows=5)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir), licenses.public())


def op4_licenses_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir), licenses.public(), copyright_line=licenses.ANY_COPYRIGHT_LINE)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(documents(spark, sf_dir), shards=8)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", sharding.record_bytes("text").alias("size"), crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_VOCABULARY, capacity=2048)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(langid.fold() != 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.fold() == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_bpe, op2_neardup, op3_secrets, op4_licenses, op4_licenses_public, op5_linededup, op6_sharding, op7_topk, op8_fingerprints, op9_packing, op10_langid)
    return {f.__name__: f for f in every}


ORACLES = {
    "op2_neardup": r"""
    WITH words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM words),
    base AS (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n FROM sets),
    grams AS (SELECT doc_id, md5_number_lower(g) AS g FROM (SELECT doc_id, unnest(s) AS g FROM sets)),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM pairs JOIN base x ON x.doc_id = a JOIN base y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, r) AS (
        SELECT doc_id, doc_id FROM base
        UNION SELECT l.b, reach.r FROM reach JOIN sides l ON l.a = reach.doc_id),
    comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT base.doc_id, n AS n_shingles, component_id, base.doc_id = component_id AS kept FROM base JOIN comp USING (doc_id)""".replace("WITH words", "WITH RECURSIVE words", 1),
    "op4_licenses": licenses.oracle(),
    "op5_linededup": r"""
    WITH texts AS (
        SELECT text, min(doc_id) AS owner FROM documents GROUP BY text),
    lines AS (
        SELECT owner, text, string_split(text, chr(10)) AS l FROM texts),
    named AS (
        SELECT owner, text, l, list_transform(l, lambda x: len(regexp_extract_all(x, '\S+'))) AS w FROM lines),
    runs AS (
        SELECT owner, i, j, md5(array_to_string(l[i:j], chr(10))) AS run, j - i + 1 AS size
        FROM (SELECT owner, l, w, i, unnest(range(i, len(l) + 1)) AS j FROM (SELECT owner, l, w, unnest(range(1, len(l) + 1)) AS i FROM named))
        WHERE list_sum(w[i:j]) >= 10),
    later AS (
        SELECT owner, i, j FROM (SELECT *, row_number() OVER (PARTITION BY run, size ORDER BY owner, i) AS r FROM runs) WHERE r > 1),
    gone AS (SELECT DISTINCT owner, unnest(range(i, j + 1)) AS p FROM later),
    gones AS (SELECT owner, list(p) AS g FROM gone GROUP BY owner),
    result AS (
        SELECT d.doc_id, n.l, d.text, n.owner = d.doc_id OR list_sum(n.w) < 10 AS own, CASE WHEN n.owner = d.doc_id THEN coalesce(g.g, []) ELSE [] END AS g
        FROM documents d JOIN named n ON n.text = d.text LEFT JOIN gones g ON g.owner = n.owner)
    SELECT doc_id, len(l)::INTEGER AS n_lines, (CASE WHEN own THEN len(g) ELSE len(l) END)::INTEGER AS n_removed,
        sha256(CASE WHEN own THEN array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(g, i)), lambda i: l[i]), chr(10)) ELSE '' END) AS text_sha256
    FROM result""",
    "op7_topk": """
    WITH good AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scores AS (
        SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(r.v)) + 1), lambda i: q.v[i] * r.v[i]))::BIGINT AS score
        FROM good q JOIN good r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
