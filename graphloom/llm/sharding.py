"""Operator 6: sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records uniformly into buckets of bounded bytes by a seeded hash of their
contents; pass two draws a Fisher-Yates permutation of each bucket and writes the bucket in that order.  The
order of all records is that of the buckets, and shards are dealt from it in turn, so their
row counts differ by one at most (law ``rows``).

Nothing depends on files, partitions or attempts: keys come from contents, a bucket is sorted before it is
drawn, and the partition that seeds the draw follows from the bucket's number.  A task that runs again gives the
same rows, so no checkpoint is needed, and the same rows in other files get the same shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import sums_before

BUCKET_BYTES = 16 << 20
SEED = 42
#: Rows that are equal in all columns more often than this are counted and numbered, so that they scatter like others.
REPEATS = 1000
PLACED = ("law", "shard", "slot", "grown_shard")


def record_bytes(text_col: str):
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0).cast("long")) + 1


def _flat(field: T.StructField) -> Column:
    """A column as something that can be hashed; nested ones as JSON."""
    col = F.col(f"`{field.name}`")
    return F.to_json(F.struct(col)) if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType)) else col


def _bytes(field: T.StructField) -> Column:
    flat = _flat(field)
    wide = not isinstance(field.dataType, T.AtomicType) or isinstance(field.dataType, (T.StringType, T.BinaryType))
    return F.coalesce(F.octet_length(flat), F.lit(0)).cast("long") + 16 if wide else F.lit(16).cast("long")


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType)) and all(_ordered(f.dataType) for f in getattr(kind, "fields", [])) and (not isinstance(kind, T.ArrayType) or _ordered(kind.elementType))


def _numbered(df: DataFrame, seed: int) -> DataFrame:
    """``__a, __b, __record``: two seeded hashes of each row's contents; those of rows that repeat often also
    hold the number of the copy."""
    flat = [_flat(f) for f in df.schema.fields]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in flat])  # a hash skips nulls
    a, b = F.xxhash64(F.lit(seed), nulls, *flat), F.xxhash64(F.lit(seed + 1), nulls, *flat)
    rows = df.select(a.alias("__a"), b.alias("__b"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__record"))
    often = rows.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > REPEATS)
    if often.isEmpty():
        return rows
    once = rows.join(often, ["__a", "__b"], "left_semi").groupBy("__a", "__b").agg(F.first("__record").alias("__record"), F.count(F.lit(1)).alias("__n"))
    copies = once.select("__a", "__b", "__record", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__k"))
    copies = copies.select(F.xxhash64("__a", "__k").alias("__a"), F.xxhash64("__b", "__k").alias("__b"), "__record")
    return rows.join(often, ["__a", "__b"], "left_anti").unionByName(copies)


def external_shuffle(df: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of ``df`` with ``__bucket long``, ``__slot long``, a random order inside each bucket, and ``__place long``, the
    place among all rows.

    Any column may be null and rows may repeat: rows that are equal in all columns are told apart by nothing, and if
    more than ``REPEATS`` are equal they are numbered, so that no bucket outgrows its size by much.  Sizes count all
    columns.  No rows, no buckets."""
    total = df.agg(F.sum(reduce(lambda x, y: x + y, [_bytes(f) for f in df.schema.fields]))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    keyed = _numbered(df, seed).withColumn("__bucket", F.pmod("__a", F.lit(buckets)))
    begins = sums_before(keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")), "__bucket").withColumnRenamed("before", "__begin")
    one = F.struct("__a", "__b", "__record")
    order = None if _ordered(df.schema) else lambda x, y: F.when(x["__a"] < y["__a"], -1).when(x["__a"] > y["__a"], 1).when(x["__b"] < y["__b"], -1).when(x["__b"] > y["__b"], 1).otherwise(0)
    dealt = keyed.repartition(min(buckets, 100_000), "__bucket")
    gathered = dealt.groupBy("__bucket").agg(F.array_sort(F.collect_list(one), order).alias("__all")).join(begins, "__bucket")
    drawn = gathered.sortWithinPartitions("__bucket").select("__bucket", "__begin", F.shuffle("__all", seed=seed).alias("__all"))
    placed = drawn.select("__bucket", "__begin", F.posexplode("__all").alias("__slot", "__one"))
    slot = F.col("__slot").cast("long")
    return placed.select("__bucket", slot.alias("__slot"), (F.col("__begin") + slot).alias("__place"), "__one.__record.*")


def assign_shards(df: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``df`` with ``law, shard, slot, grown_shard`` (columns of these names in ``df`` are replaced):
    law ``rows``, so ``grown_shard`` is null.  Slots of a shard run from 0 without gaps.  Null
    and empty texts are records like others; no rows, no shards."""
    kept = [c for c in df.columns if c not in PLACED]
    shuffled = external_shuffle(df.select(*[F.col(f"`{c}`") for c in kept]), seed, bucket_bytes)
    return shuffled.select(
        *[F.col(f"`{c}`") for c in kept],
        F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 8, rows_per_file: int = 100_000, **options) -> None:
    """Writes the records as Parquet, one folder ``shard=N`` for each, files in slot order and sorted by slot."""
    placed = assign_shards(df, shards, **options)
    part = F.floor(F.col("slot") / rows_per_file)
    placed.repartitionByRange(shards * 4, "shard", part, "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
