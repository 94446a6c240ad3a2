"""Connected components of a table of links: forests of parts, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, release

LINKS_PER_TASK = 100_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _forests(links: DataFrame, most: int) -> DataFrame:
    """Before any shuffle, each part's links as stars: every node with the smallest node that it
    reaches there.  A part with more than ``most`` links gives several such forests, so that memory
    stays bounded; they connect the same nodes."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        read = 0

        def root(x):
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(above, above)
            return x

        def stars(schema: pa.Schema) -> pa.RecordBatch:
            pairs = [(x, top) for x in list(up) if (top := root(x)) != x]
            columns = ([p[k] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=["a", "b"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if read == most:
                    yield stars(schema)
                    up.clear()
                    read = 0
                read += 1
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield stars(schema)

    return links.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``), a table that is cheap to read
    twice; the component's name is its smallest node.  Links to oneself and repeated links are
    allowed; no links, no rows.  There are as many parts as the links need, ``LINKS_PER_TASK`` each: what
    fits one part is settled by its forest, and more parts meet in stars, which only join and take
    minima, so no group is gathered in one place; the number of steps grows with the logarithm of the
    largest distance."""
    most = LINKS_PER_TASK
    edges = links.where("a <> b").select("a", "b")
    size = edges.count()
    edges = cut(_forests(edges.coalesce(max(1, -(-size // most))), most))
    before, settled = None, size <= most
    while not settled:
        # large star: each node hands its larger neighbours the least of its neighbourhood
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(large.where("a <> b").distinct())
        # small star: each node hands its smaller neighbours, and itself, the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges = cut(small.where("a <> b").distinct())
        after = _state(edges)
        settled, before = after == before, after
        if not settled and after[0] <= most:
            edges, settled = cut(_forests(edges.coalesce(1), most)), True
        del both, least, large, small
        release(links.sparkSession)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
