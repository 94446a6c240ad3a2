"""Traversals: each is a few semi-joins on the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Collection, _semi
from graphloom.operators.iterate import Rounds, cut


# Fixed value: the depth of nodes without children.
TOP = 9007199254740990


def connected_edges(c: Collection) -> Collection:
    """Edges of the whole graph that touch a node of the collection."""
    ids = c.nodes.select("id")
    touching = c.graph.both_ways.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").select("id").distinct()
    return c._of(edges=_semi(c.graph.edges, touching))


def connected_nodes(c: Collection) -> Collection:
    ends = c.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return c._of(nodes=_semi(c.graph.nodes, ends))


def sources(c: Collection) -> Collection:
    return c._of(nodes=_semi(c.graph.nodes, c.edges.select("source").distinct()))


def targets(c: Collection) -> Collection:
    return c._of(nodes=_semi(c.graph.nodes, c.edges.select("target").distinct()))


def source(c: Collection) -> Collection:
    return sources(c._of(edges=c.edges.orderBy("ord").limit(1)))


def target(c: Collection) -> Collection:
    return targets(c._of(edges=c.edges.orderBy("ord").limit(1)))


def neighborhood(c: Collection) -> Collection:
    """Adjacent nodes and the edges between; a loop makes a node its own neighbour."""
    near = cut(c.graph.both_ways.join(c.nodes.select(F.col("id").alias("a")), "a", "left_semi"))
    return c._of(_semi(c.graph.nodes, near.select("b").distinct()), _semi(c.graph.edges, near.select("id").distinct()))


def closed_neighborhood(c: Collection) -> Collection:
    return neighborhood(c).union(c)


def outgoers(c: Collection) -> Collection:
    out = _semi(c.graph.edges, c.nodes.select("id"), "source")
    return c._of(_semi(c.graph.nodes, out.select("target").distinct()), out)


def incomers(c: Collection) -> Collection:
    into = _semi(c.graph.edges, c.nodes.select("id"), "target")
    return c._of(_semi(c.graph.nodes, into.select("source").distinct()), into)


def _reach(c: Collection, a: str, b: str) -> Collection:
    """Everything reachable along edges a -> b; a start only if a cycle leads back to it."""
    edges = c.graph.edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    reached = cut(edges.join(c.nodes.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
    front, rounds = reached, Rounds(reached)
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = cut(step.join(rounds.all(), "id", "left_anti"))
        rounds.add(front)
    reached = rounds.all()
    walked = _semi(c.graph.edges, c.nodes.select("id").union(reached).distinct(), a)
    return c._of(_semi(c.graph.nodes, reached), walked)


def successors(c: Collection) -> Collection:
    return _reach(c, "source", "target")


def predecessors(c: Collection) -> Collection:
    return _reach(c, "target", "source")


def _ends(c: Collection, far: str) -> Collection:
    proper = c.graph.edges.where("source <> target").select(far).distinct()
    return c._of(nodes=_semi(c.nodes, proper, how="left_anti"))


def roots(c: Collection) -> Collection:
    """Nodes without an incoming edge from another node, in the whole graph."""
    return _ends(c, "target")


def leaves(c: Collection) -> Collection:
    return _ends(c, "source")


def edges_with(c: Collection, other: Collection) -> Collection:
    a, b = c.nodes.select("id"), other.nodes.select("id")
    e = c.graph.edges
    there = _semi(_semi(e, a, "source"), b, "target")
    back = _semi(_semi(e, b, "source"), a, "target")
    return c._of(edges=_semi(e, there.select("id").union(back.select("id")).distinct()))


def edges_to(c: Collection, other: Collection) -> Collection:
    return c._of(edges=_semi(_semi(c.graph.edges, c.nodes.select("id"), "source"), other.nodes.select("id"), "target"))


def _same_ends(c: Collection, key: list[Column]) -> Collection:
    keyed = lambda df: df.withColumns({f"__k{i}": k for i, k in enumerate(key)})
    names = [f"__k{i}" for i in range(len(key))]
    mine = keyed(c.edges).select(*names).distinct()
    return c._of(edges=keyed(c.graph.edges).join(mine, names, "left_semi").drop(*names))


def parallel_edges(c: Collection) -> Collection:
    """Edges with the same two ends either way round, those of the collection included."""
    return _same_ends(c, [F.least("source", "target"), F.greatest("source", "target")])


def codirected_edges(c: Collection) -> Collection:
    return _same_ends(c, [F.col("source"), F.col("target")])


# compound hierarchy


def parents_of(c: Collection) -> Collection:
    return c._of(nodes=_semi(c.graph.nodes, c.nodes.where("parent is not null").select("parent").distinct()))


def ancestors(c: Collection) -> Collection:
    up = c.graph.closure().join(c.nodes.select("id"), "id", "left_semi")
    return c._of(nodes=_semi(c.graph.nodes, up.select("ancestor").distinct()))


def common_ancestors(c: Collection) -> Collection:
    """Ancestors that all nodes share; none for an empty collection."""
    up = c.graph.closure().join(c.nodes.select("id"), "id", "left_semi")
    n = c.nodes.agg(F.count(F.lit(1)).alias("n"))
    shared = up.groupBy("ancestor").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(n), F.col("m") == F.col("n"))  # one row
    return c._of(nodes=_semi(c.graph.nodes, shared.select("ancestor")))


def children(c: Collection) -> Collection:
    return c._of(nodes=_semi(c.graph.nodes, c.nodes.select("id"), "parent"))


def descendants(c: Collection) -> Collection:
    down = c.graph.closure().join(c.nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return c._of(nodes=_semi(c.graph.nodes, down.select("id").distinct()))


def siblings(c: Collection) -> Collection:
    kin = _semi(c.graph.nodes, c.nodes.where("parent is not null").select("parent").distinct(), "parent")
    return c._of(nodes=_semi(kin, c.nodes.select("id"), how="left_anti"))


def orphans(c: Collection) -> Collection:
    return c._of(nodes=c.nodes.where("parent is null"))


def nonorphans(c: Collection) -> Collection:
    return c._of(nodes=c.nodes.where("parent is not null"))


def z_depth(c: Collection) -> DataFrame:
    """``id, grp, depth``: a parent's depth in the hierarchy; nodes without children stand on top of everything
    (``TOP``), an edge as high as the higher of its ends."""
    deep = c.graph.closure().groupBy("id").agg(F.max("depth").alias("d"))
    parents = c.graph.parents().withColumn("p", F.lit(True))
    of = c.graph.nodes.select("id").join(deep, "id", "left").join(parents, "id", "left")
    of = of.select("id", F.when(F.col("p"), F.coalesce("d", F.lit(0)).cast("long")).otherwise(F.lit(TOP)).alias("depth"))
    ends = c.edges.select("id", F.explode(F.array("source", "target")).alias("__e")).join(of.select(F.col("id").alias("__e"), "depth"), "__e")
    edges = ends.groupBy("id").agg(F.max("depth").alias("depth")).select("id", F.lit("edges").alias("grp"), "depth")
    return _semi(of, c.nodes.select("id")).select("id", F.lit("nodes").alias("grp"), "depth").unionByName(edges)


def is_parent(c: Collection) -> DataFrame:
    """``id, is_parent, is_childless, is_child, is_orphan`` of each node."""
    marks = c.graph.parents().withColumn("__p", F.lit(True))
    p = F.coalesce("__p", F.lit(False))
    return c.nodes.join(marks, "id", "left").select("id", p.alias("is_parent"), (~p).alias("is_childless"), F.col("parent").isNotNull().alias("is_child"), F.col("parent").isNull().alias("is_orphan"))
