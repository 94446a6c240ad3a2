"""Degrees, degree centrality and numeric reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Collection


def degrees(c: Collection, include_loops: bool = True) -> DataFrame:
    """``id, degree, indegree, outdegree`` of the collection's nodes in the whole graph."""
    g = c.graph if include_loops else c.graph.with_(edges=c.graph.edges.where("source <> target"))
    d = c.nodes.select("id").join(g.degrees, "id", "left")
    return d.select("id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("degree", "indegree", "outdegree")])


def degree_summary(c: Collection, include_loops: bool = True) -> DataFrame:
    """One row: minima, maxima and the total of degrees; null for an empty collection."""
    aggs = [f(k).alias(f"{n}_{k}") for k in ("degree", "indegree", "outdegree") for n, f in (("min", F.min), ("max", F.max))]
    return degrees(c, include_loops).agg(*aggs, F.sum("degree").alias("total_degree"))


def _strength(c: Collection, weight: Column, directed: bool) -> DataFrame:
    """Number and weight of the collection's edges at each node; a loop counts once."""
    e = c.edges.select("source", "target", weight.cast("double").alias("w"))
    if directed:
        ends = e.select(F.col("target").alias("id"), "w", F.lit("in").alias("d")).union(e.select("source", "w", F.lit("out")))
    else:
        ends = e.select(F.col("source").alias("id"), "w", F.lit("all").alias("d")).union(e.where("source <> target").select("target", "w", F.lit("all")))
    per = ends.groupBy("id").agg(*[f.alias(f"{n}_{d}") for d in (("in", "out") if directed else ("all",)) for n, f in (("k", F.count(F.when(F.col("d") == d, 1))), ("s", F.sum(F.when(F.col("d") == d, F.col("w")))))])
    return c.nodes.select("id", "ord").join(per, "id", "left")


def degree_centrality(c: Collection, weight: Column | None = None, alpha: float = 0.0, directed: bool = False) -> DataFrame:
    """``id, degree`` or ``id, indegree, outdegree``: k^(1-alpha) * s^alpha of the k edges and their weight s."""
    rows = _strength(c, F.lit(1.0) if weight is None else weight, directed)

    def value(d: str) -> Column:
        k, s = F.coalesce(f"k_{d}", F.lit(0)).cast("double"), F.coalesce(f"s_{d}", F.lit(0.0))
        return F.pow(k, F.lit(1 - alpha)) * F.pow(s, F.lit(alpha))

    if directed:
        return rows.select("id", value("in").alias("indegree"), value("out").alias("outdegree"))
    return rows.select("id", value("all").alias("degree"))


def degree_centrality_normalized(c: Collection, weight: Column | None = None, alpha: float = 0.0, directed: bool = False) -> DataFrame:
    """The same over its maximum in the collection; 0 if that is 0."""
    rows = degree_centrality(c, weight, alpha, directed)
    names = [n for n in rows.columns if n != "id"]
    most = rows.agg(*[F.max(n).alias(f"m_{n}") for n in names])
    scaled = [F.when(F.col(f"m_{n}") == 0, 0.0).otherwise(F.col(n) / F.col(f"m_{n}")).alias(n) for n in names]
    return rows.join(F.broadcast(most)).select("id", *scaled)  # one row


def _finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def number_summary(df: DataFrame, value: Column) -> DataFrame:
    """``min, max, mean, median`` of the finite values."""
    v = _finite(value)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"))


def sum_normalize(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the share of the column's total."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.join(F.broadcast(total)).withColumn(name, F.col(value) / F.col("__total")).drop("__total")  # one row


def ranked(df: DataFrame, by: Column, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(by, "ord")))
