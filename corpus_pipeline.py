"""A corpus pipeline of five operators: language ID, line dedup, near-dedup, secrets, packing.

Each stage is written as Parquet and reread as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, langid, linededup, neardup, packing, secretscan
from graphloom.llm.queries import WORD_VOCABULARY

#: A document goes if no language fits it: it has no letters, or its best language has under half of the odds.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; ``lang`` stays as it was given."""
    model = langid.train(docs)
    found = langid.identify(docs, model, prefix="__")
    kept = found.where((F.col("__lang_pred") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, and documents of which nothing but blank is left."""
    found = linededup.dedup_lines(docs)
    return found.where("n_removed = 0 or trim(both ' \\t\\r\\n' from text) <> ''").select(*_resized(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates (similarity 0.8 of five-word shingles)."""
    groups = neardup.near_duplicates(docs, percent=80, bands=40, rows=5)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret, base or decoded, by a mark."""
    return secretscan.redact_secrets(docs).select(*_resized(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, WORD_VOCABULARY, capacity=2048)


def _resized(docs: DataFrame) -> list:
    """The columns of documents, with ``n_chars`` after the text's change."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return [size.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Classifiers and best-fit rounds are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and goes when the next
    stage is written.  The result is read from the last one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
