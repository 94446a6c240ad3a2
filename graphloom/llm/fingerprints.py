"""Operator 8: document fingerprints by MinHash over word shingles.

A fingerprint is a row of universal hash minima over all five-word shingles of a text, written
as hexadecimal; the share of equal minima estimates the Jaccard similarity of the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shuffle_parts, text_groups
from graphloom.llm.neardup import near_duplicates
from graphloom.llm.shingles import MinHash, shingle_lists

HASHES = 128
SHINGLE = 5
#: Keys of a sample for each range, and characters of texts that are worked on together.
SAMPLE, GROUP_CHARS = 60, 1 << 21


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, shingle: int = SHINGLE) -> DataFrame:
    """``id_col, n_shingles, fingerprint`` of every row; null text counts as empty, and texts
    without words all have the fingerprint of ``f``s.  Repeated rows repeat."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(hashes)
        for b in batches:
            for lo, texts in text_groups(b.column(1), GROUP_CHARS):
                lists = shingle_lists([(t or "").encode() for t in texts], shingle)
                prints = [fingerprint_hex(s) for s in family.signatures(lists)]
                sizes = [len(np.unique(x)) for x in lists]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(sizes, pa.int64()), pa.array(prints, pa.string())], names=[id_col, "n_shingles", "fingerprint"])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, fingerprint string")


def similar_documents(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept``: documents joined by signature bands (40 of 5 values) with the Jaccard
    similarity verified on full sets, as connected components; see ``neardup.near_duplicates``, whose rounds keep copies and hot
    buckets from multiplying."""
    return near_duplicates(df, percent=percent, shingle=SHINGLE, bands=40, rows=5, id_col=id_col, text_col=text_col)


def edited_fingerprints(df: DataFrame, hashes: int = HASHES, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: fingerprints of every text and of its
    edited text, whose last third (rounded down) is
    replaced by the beginning of the next document in descending order of id; after the last
    comes the first.

    The rows cross the network once, with their texts: ranges of ids go to one place each and
    a copy of each range's first row goes to the range before it too.  Null text counts as
    empty; rows without an id come last in the order; rows with equal ids are ordered by a hash of their text, which
    also parts them into ranges.  Ids may have any type that can be ordered.  Other columns are left out."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.struct("id", F.md5(F.col("text").cast("binary")).alias("hash")))
    parts = max(2, shuffle_parts(spark) * 2)
    # ranges from a sample of the keys: as many as there are partitions, whatever the data
    seen = docs.select("key").sample(min(1.0, SAMPLE * parts / max(1, docs.count())), seed=5).select("key.*").orderBy("id", "hash").collect()
    cuts = [seen[i * len(seen) // parts] for i in range(1, parts)] if seen else []
    bounds = F.array(*[F.struct(F.lit(c["id"]).cast(kind).alias("id"), F.lit(c["hash"]).alias("hash")) for c in cuts]).cast(f"array<struct<id:{kind},hash:string>>")
    rank = F.size(F.filter(bounds, lambda c: c > F.col("key")))
    heads = docs.select("key", rank.alias("part")).groupBy("part").agg(F.max("key").alias("head")).select("part", "head.*").collect()
    heads = sorted(((r["part"], r["id"], r["hash"]) for r in heads), key=lambda r: r[0])
    table = spark.createDataFrame([(p, i, h, heads[n - 1][0]) for n, (p, i, h) in enumerate(heads)], f"part int, head_id {kind}, head_hash string, before int")
    known = docs.withColumn("part", rank).join(F.broadcast(table), "part")  # a row for each range
    copy = F.struct(F.col("before").alias("part"), F.lit(True).alias("halo"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    first = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("key.hash") == F.col("head_hash"))
    placed = known.select("id", "text", "key", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("to")).select("id", "text", "key", "to.part", "to.halo")
    placed = placed.repartition(parts, "part").sortWithinPartitions("part", "halo", F.col("key").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(hashes)
        held: tuple | None = None  # the row that waits for its successor: its place in ``ids``, text and signature
        kept, part, closed = None, None, False
        for b in batches:
            for lo, texts in text_groups(b.column(1), GROUP_CHARS):
                x = b.slice(lo, len(texts))
                ids = x.column(0) if kept is None else pa.concat_arrays([kept, x.column(0)])
                shift = 0 if kept is None else 1
                out = []
                sigs = family.signatures(shingle_lists([t.encode() for t in texts], shingle))
                for i, (text, at, halo, sig) in enumerate(zip(texts, x.column(2).to_pylist(), x.column(3).to_pylist(), sigs, strict=True), shift):
                    if at != part:
                        part, closed, held = at, False, None
                    if held is not None and not closed:
                        out.append((*held, text, sig))
                    closed = closed or halo
                    held = (i, text, sig)
                kept, held = ids.slice(held[0], 1), (0, *held[1:])
                if out:
                    yield finished(family, ids, out)

    def finished(family: MinHash, ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cut = [len(text) // 3 for _, text, *_ in rows]
        edited = [text[: len(text) - n] + following[:n] for n, (_, text, _, following, _) in zip(cut, rows, strict=True)]
        sigs = family.signatures(shingle_lists([t.encode() for t in edited], shingle))
        columns = [
            ids.take(pa.array([r[0] for r in rows])),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([fingerprint_hex(r[2]) for r in rows]),
            pa.array([fingerprint_hex(s) for s in sigs]),
            pa.array([likeness(r[2], s) for r, s in zip(rows, sigs, strict=True)], pa.float64()),
            pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.select("id", "text", "part", "halo").mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
