"""Helpers that several operators share: checkpoints, global order, small Arrow kernels."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in ``spark.checkpoint.dir``; only where that is
    unset and all runs on one machine (tests) a folder of our own is used, a cluster without one raises."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and truncates lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what a finished round left behind: shuffle files and checkpoints stay on disk until
    their handles are collected, which loops can't leave to chance."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, order: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the given order, without a single-task window.

    The rows are range-partitioned and sorted; each partition numbers its own rows and a table
    of partition sizes (one row per partition, so bounded by the cluster's settings and not by
    the data) turns those into global numbers.  The result is checkpointed, so the numbers
    don't change when an executor is lost."""
    spark = df.sparkSession
    parts = parts or shuffle_parts(spark)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = cut(ranged.withColumn("__mono", F.monotonically_increasing_id()))
    part, row = F.shiftright("__mono", 33), F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).collect()
    offsets, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        offsets[r["__part"]] = total
        total += r["__n"]
    if not offsets:
        return local.withColumn(name, F.lit(0).cast("long")).drop("__mono")
    table = spark.createDataFrame(list(offsets.items()), "__part int, __offset long")
    return (
        local.withColumn("__part", part.cast("int"))
        .join(F.broadcast(table), "__part")
        .withColumn(name, F.col("__offset") + row)
        .drop("__mono", "__part", "__offset")
    )


def text_groups(column: pa.Array, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column as Python strings, in groups of up to ``chars`` bytes (or one text): first place and texts.
    A batch is a view of Arrow memory, so only one group at a time takes up Python's."""
    at, group, size = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py()
        if group and size + len(text or "") > chars:
            yield at, group
            at, group, size = i, [], 0
        group.append(text)
        size += len(text or "") + 1
    if group:
        yield at, group


#: Numbers whose sums one window adds up.
CHUNK = 4096


def sums_before(counts: DataFrame, by: str, level: int = 0) -> DataFrame:
    """``by, before``: for each row of ``counts`` (``by``, a number from 0 that no other row has, and ``n``) the sum of ``n`` over
    smaller numbers.  Windows add up chunks of ``CHUNK`` numbers, and sums of chunks are added up in turn, so no task sees all
    rows and none passes the driver."""
    inside = F.sum("n").over(Window.partitionBy("__chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    own = counts.select(by, "n", F.floor(F.col(by) / CHUNK).cast("long").alias("__chunk")).withColumn("__inside", F.coalesce(inside, F.lit(0).cast("long")))
    if level == 2:  # 2^36 numbers
        return own.select(by, F.col("__inside").alias("before"))
    whole = own.groupBy("__chunk").agg(F.sum("n").alias("n"))
    above = sums_before(whole.select(F.col("__chunk").alias(f"__c{level}"), "n"), f"__c{level}", level + 1)
    return own.join(above, own["__chunk"] == above[f"__c{level}"]).select(by, (F.col("before") + F.col("__inside")).alias("before"))
