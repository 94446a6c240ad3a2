"""Fix-point loops over DataFrames: lineage is cut by reliable checkpoints each round."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Clusters name the shared folder in ``spark.checkpoint.dir``; a folder of our own only
    serves where that is unset and all runs on one machine, as in tests.  A cluster without one raises."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """What the rounds of a loop found, a table for each round.  Nothing is written again each round; now and then (after
    ``compact`` rounds) the tables become one, so plans stay short and n rows are rewritten once in so many rounds."""

    def __init__(self, first: DataFrame, compact: int = 12):
        self.parts, self.compact = [first], compact

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) > self.compact:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool], rounds: int) -> DataFrame:
    """Applies ``step`` until ``done(old, new)`` or so many rounds have passed."""
    state = cut(state)
    for i in range(rounds):
        new = cut(step(state, i))
        if done(state, new):
            return new
        state = new
    return state


def global_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Numbers the rows from 0 in the given order without a single-task window: rows are
    range-sorted, each partition numbers its own, and the partition sizes (one row each) add up."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = sorted((r["p"], r["n"]) for r in local.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.lit(None).cast("map<bigint,bigint>")
    return local.withColumn(name, F.element_at(table, part) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")
