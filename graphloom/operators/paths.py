"""Searches, shortest paths, spanning trees and components as checkpointed relaxation loops.

Every operator works on a collection: its nodes, and those of its edges whose ends are both
in it.  ``weight`` is a condition-free column over the edge table, 1 by default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Collection, _semi
from graphloom.llm.components import components as linked
from graphloom.operators.iterate import Rounds, cut

INF = float("inf")


def inner_edges(c: Collection, loops: bool = True) -> DataFrame:
    e = c.edges if loops else c.edges.where("source <> target")
    ids = c.nodes.select("id")
    return _semi(_semi(e, ids, "source"), ids, "target")


def arcs(c: Collection, weight: Column | None = None, directed: bool = False, loops: bool = False) -> DataFrame:
    """``a, b, edge, ord, w``: how a walk may go."""
    e = inner_edges(c, loops).select("source", "target", F.col("id").alias("edge"), "ord", (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    there = e.withColumnsRenamed({"source": "a", "target": "b"})
    if directed:
        return there
    return there.unionByName(e.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"), "edge", "ord", "w"))


def bfs(c: Collection, roots: DataFrame, directed: bool = False, max_depth: int = 1 << 30, goal: Column | None = None) -> DataFrame:
    """``id, depth, edge, pred``: layers from all roots; of several ways into a node the first edge by
    order of insertion counts.  Stops below the first layer with a node where ``goal`` holds."""
    walk = cut(arcs(c, directed=directed))
    seen = cut(_semi(c.nodes, roots).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge"), F.lit(None).cast("string").alias("pred")))
    front, rounds = seen, Rounds(seen)
    for depth in range(1, max_depth + 1):
        if front.isEmpty() or (goal is not None and not _semi(c.nodes, front.select("id")).where(goal).isEmpty()):
            break
        step = walk.join(front.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct("edge", "a"), F.struct("ord", "a")).alias("via"))
        front = cut(step.join(rounds.all().select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("via.edge").alias("edge"), F.col("via.a").alias("pred")))
        rounds.add(front)
    return rounds.all()


def visits(c: Collection, roots: DataFrame, directed: bool = False, found: Column | None = None, stop: Column | None = None) -> DataFrame:
    """``place, id, depth, edge, pred, found``: the order in which a breadth-first walk visits - layer by layer, in a layer by
    order of insertion.  The walk ends with the first visit where ``found`` or ``stop`` (conditions on nodes) holds."""
    from graphloom.operators.iterate import global_index

    ends = [t for t in (found, stop) if t is not None]
    goal = None if not ends else ends[0] if len(ends) == 1 else F.coalesce(ends[0], F.lit(False)) | F.coalesce(ends[1], F.lit(False))
    walk = bfs(c, roots, directed, goal=goal)
    marks = c.nodes.select("id", "ord", F.coalesce(found, F.lit(False)).alias("found") if found is not None else F.lit(False).alias("found"), F.coalesce(goal, F.lit(False)).alias("__end") if goal is not None else F.lit(False).alias("__end"))
    placed = global_index(walk.join(marks, "id"), ["depth", "ord", "id"], "place")
    last = placed.where("__end").agg(F.min("place")).first()[0]
    return (placed if last is None else placed.where(F.col("place") <= last)).select("place", "id", "depth", "edge", "pred", "found")


def _cheapest(walk: DataFrame) -> DataFrame:
    """Of parallel arcs the lightest, of those the first."""
    return walk.groupBy("a", "b").agg(F.min(F.struct("w", "ord", "edge")).alias("m")).select("a", "b", "m.w", "m.edge")


def _start(c: Collection, root: str) -> DataFrame:
    return cut(c.nodes.where(F.col("id") == root).select("id", F.lit(0.0).alias("distance"), F.lit(None).cast("string").alias("edge"), F.lit(None).cast("string").alias("pred")))


def _best(rounds: Rounds) -> DataFrame:
    """Of what the rounds found for a node, the nearest."""
    return rounds.all().groupBy("id").agg(F.min(F.struct("distance", "edge", "pred")).alias("m")).select("id", "m.*")


def _relax(walk: DataFrame, front: DataFrame, rounds: Rounds) -> DataFrame:
    """Nodes that come nearer through the front.  No edge leads straight back, which only matters to negative ones."""
    via = walk.join(front.select(F.col("id").alias("a"), "distance", F.col("edge").alias("__by")), "a").where("__by is null or edge <> __by")
    via = via.select(F.col("b").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), "edge", F.col("a").alias("pred"))
    via = via.groupBy("id").agg(F.min(F.struct("distance", "edge", "pred")).alias("m")).select("id", "m.*")
    old = rounds.all().groupBy("id").agg(F.min("distance").alias("old"))
    return cut(via.join(old, "id", "left").where("old is null or distance < old").drop("old"))


def shortest_paths(c: Collection, root: str, weight: Column | None = None, directed: bool = False, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``id, distance, edge, pred`` of the nodes that can be reached, and those that the last round
    still improved (with as many rounds as nodes: those behind a negative cycle)."""
    walk = cut(_cheapest(arcs(c, weight, directed)))
    front = _start(c, root)
    found, n = Rounds(front), 0
    limit = rounds if rounds is not None else c.nodes.count()
    while n < limit and not front.isEmpty():
        n += 1
        front = _relax(walk, front, found)
        found.add(front)
    return cut(_best(found)), front


def dijkstra(c: Collection, root: str, weight: Column | None = None, directed: bool = False) -> DataFrame:
    """``id, distance, edge, pred`` of every node of the collection; infinity where there is no
    way.  Weights must not be negative."""
    found, _ = shortest_paths(c, root, weight, directed)
    return c.nodes.select("id").join(found, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(INF)))


def bellman_ford(c: Collection, root: str, weight: Column | None = None, directed: bool = False) -> tuple[DataFrame, bool]:
    """Distances as for ``dijkstra``, with any weights, and whether there is a negative cycle."""
    found, improving = shortest_paths(c, root, weight, directed)
    return c.nodes.select("id").join(found, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(INF))), not improving.isEmpty()


def negative_cycles(c: Collection, root: str, weight: Column | None = None, directed: bool = False) -> DataFrame:
    """``cycle, place, id, edge``: the negative cycles that the predecessors close among what can be reached from ``root``; each
    is named by its smallest node, where it begins (place 0), and ``edge`` leads to the next place's node (from the last to
    the first).  No rows without any.

    Pointers double: as many steps back as there are nodes end on a cycle, and places are distances to its name."""
    found, improving = shortest_paths(c, root, weight, directed)
    back = cut(found.where("pred is not null").select("id", "pred", "edge"))
    jump, steps, n = back.select("id", F.col("pred").alias("to")), 1, c.nodes.count()
    while steps < n:
        jump = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("on")), "to").select("id", F.col("on").alias("to")))
        steps *= 2
    ring = cut(back.join(_semi(jump, improving.select("id")).select(F.col("to").alias("id")).distinct(), "id", "left_semi"))
    while True:  # a start may land in the middle of a cycle: take all of it
        more = cut(back.join(ring.select(F.col("pred").alias("id")).distinct(), "id", "left_semi").join(ring.select("id"), "id", "left_anti"))
        if more.isEmpty():
            break
        ring = cut(ring.unionByName(more))
    name, hop, span, n = ring.select("id", F.col("id").alias("cycle")), ring.select("id", F.col("pred").alias("to")), 1, ring.count()
    while span < n:
        seen = name.select(F.col("id").alias("to"), F.col("cycle").alias("other"))
        name = cut(name.join(hop, "id").join(seen, "to").select("id", F.least("cycle", "other").alias("cycle")))
        hop = cut(hop.join(hop.select(F.col("id").alias("to"), F.col("to").alias("on")), "to").select("id", F.col("on").alias("to")))
        span *= 2
    rows = ring.join(name, "id")
    far = cut(rows.select("id", F.when(F.col("id") != F.col("cycle"), F.col("pred")).alias("to"), F.when(F.col("id") == F.col("cycle"), 0).otherwise(1).cast("long").alias("place")))
    while not far.where("to is not null").isEmpty():
        ahead = far.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("place").alias("more"))
        far = cut(far.join(ahead, "to", "left").select("id", F.col("on").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
    placed = rows.join(far.select("id", "place"), "id")
    leaves = placed.select(F.col("pred").alias("id"), F.col("edge").alias("out"))  # the edge into a node leaves its predecessor
    return placed.select("cycle", "place", "id").join(leaves, "id").select("cycle", "place", "id", F.col("out").alias("edge"))


def path_to(found: DataFrame, goal: str) -> list[str]:
    """Nodes and edges from the root to ``goal`` in turn, walked back by one lookup a step."""
    row = found.where(F.col("id") == goal).first()
    if row is None or ("distance" in found.columns and row["distance"] == INF):
        return []
    out = [goal]
    while row is not None and row["pred"] is not None:
        out += [row["edge"], row["pred"]]
        row = found.where(F.col("id") == row["pred"]).first()
    return out[::-1]


def a_star(c: Collection, root: str, goal: str, weight: Column | None = None, directed: bool = False, heuristic: Column | None = None) -> dict:
    """``found, distance, path, steps`` between two nodes.  ``heuristic``, a column of nodes, must not be more than the way left
    to the goal; a round goes on from all open nodes that may still lie on a shorter way.  ``steps`` counts those."""
    walk = cut(_cheapest(arcs(c, weight, directed)))
    left = c.nodes.select("id", (F.lit(0.0) if heuristic is None else F.coalesce(heuristic.cast("double"), F.lit(0.0))).alias("left"))
    front, steps = _start(c, root), 0
    found = Rounds(front)
    while not front.isEmpty():
        bound = found.all().where(F.col("id") == goal).agg(F.min("distance").alias("m")).first()["m"]
        open_ = front if bound is None else front.join(left, "id").where(F.col("distance") + F.col("left") < bound).drop("left")
        steps += open_.count()
        front = _relax(walk, open_, found)
        found.add(front)
    best = cut(_best(found))
    path = path_to(best, goal)
    distance = best.where(F.col("id") == goal).first()
    return {"found": bool(path), "distance": distance["distance"] if distance else None, "path": path or None, "steps": steps}


def reached_from(walk: DataFrame, starts: DataFrame) -> DataFrame:
    """``a, b, distance``: from every node of ``starts`` (``id``) to all that it reaches, itself included; all starts relax together."""
    front = cut(starts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")))
    found = Rounds(front)
    while not front.isEmpty():
        step = front.join(walk.select(F.col("a").alias("b"), F.col("b").alias("z"), "w"), "b").groupBy("a", F.col("z").alias("b")).agg(F.min(F.col("distance") + F.col("w")).alias("distance"))
        old = found.all().groupBy("a", "b").agg(F.min("distance").alias("old"))
        front = cut(step.join(old, ["a", "b"], "left").where("old is null or distance < old - 1e-12").drop("old"))
        found.add(front)
    return cut(found.all().groupBy("a", "b").agg(F.min("distance").alias("distance")))


def batches(c: Collection, size: int) -> list[DataFrame]:
    """The nodes in parts of about ``size``, by a hash of their ids."""
    parts = max(1, -(-c.nodes.count() // size))
    of = F.pmod(F.xxhash64("id"), F.lit(parts))
    return [c.nodes.select("id").where(of == i) for i in range(parts)]


def all_pairs(c: Collection, weight: Column | None = None, directed: bool = False, batch: int = 2000) -> DataFrame:
    """``a, b, distance`` of all pairs with a way between them, itself included.  Weights must not be negative.  Starts go in
    batches, so a round holds ``batch`` times the nodes at most; the result has a row for each pair."""
    walk = cut(_cheapest(arcs(c, weight, directed)))
    return reduce(DataFrame.unionByName, [reached_from(walk, part) for part in batches(c, batch)])


def pair_path(c: Collection, pairs: DataFrame, a: str, b: str, weight: Column | None = None, directed: bool = False) -> list[str]:
    """Nodes and edges of a shortest way from ``a`` to ``b`` in turn, read off the distances of ``all_pairs``; none: empty."""
    walk = _cheapest(arcs(c, weight, directed))
    ends = cut(pairs.where(F.col("b") == b).select("a", "distance"))
    near = walk.join(ends.withColumnRenamed("distance", "here"), "a").join(ends.select(F.col("a").alias("b"), F.col("distance").alias("there")), "b")
    tight = cut(near.where(F.abs(F.col("w") + F.col("there") - F.col("here")) <= 1e-9 * (1 + F.abs("here"))).select("a", "b", "edge"))
    if ends.where(F.col("a") == a).isEmpty():
        return []
    back: dict[str, tuple[str, str] | None] = {a: None}
    layer = [a]  # a breadth-first walk over tight arcs, so ways of weight 0 don't turn in a ring
    while b not in back:
        rows = tight.where(F.col("a").isin(layer)).groupBy("b").agg(F.min(F.struct("edge", "a")).alias("m")).collect()
        layer = [r["b"] for r in rows if r["b"] not in back]
        back.update({r["b"]: (r["m"]["edge"], r["m"]["a"]) for r in rows if r["b"] not in back})
        if not layer:
            return []
    out = [b]
    while back[out[-1]] is not None:
        out += back[out[-1]]
    return out[::-1]


def components(c: Collection) -> DataFrame:
    """``id, component``: weakly connected components of the collection, named by the smallest id.
    Links are joined as forests of parts and then as stars (``llm/components.py``), so rounds are few."""
    links = cut(inner_edges(c, loops=False).select(F.col("source").alias("a"), F.col("target").alias("b")))
    found = linked(links).select(F.col("node").alias("id"), "component")
    return cut(c.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def component_of(c: Collection, element_id: str) -> Collection:
    """The component of one element in the whole graph."""
    every = c.graph.elements()
    found = cut(components(every))
    root = every.graph.edges.where(F.col("id") == element_id).select("source").union(found.where(F.col("id") == element_id).select("id"))
    name = found.join(root.limit(1).withColumnRenamed("source", "id"), "id", "left_semi").select("component")
    nodes = found.join(name, "component", "left_semi").select("id")
    return c._of(_semi(c.graph.nodes, nodes), _semi(c.graph.edges, nodes, "source"))


def minimum_spanning_forest(c: Collection, weight: Column | None = None) -> DataFrame:
    """``edge, source, target, w``: Boruvka's rounds; the order (weight, insertion) has no ties, so the
    forest is the one that taking edges in that order gives."""
    e = inner_edges(c, loops=False).select(F.col("id").alias("edge"), "source", "target", (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), "ord")
    e = cut(e)
    label = cut(c.nodes.select("id", F.col("id").alias("l")))
    chosen = None
    while True:
        a, b = label.withColumnsRenamed({"id": "source", "l": "la"}), label.withColumnsRenamed({"id": "target", "l": "lb"})
        across = cut(e.join(a, "source").join(b, "target").where("la <> lb"))
        if across.isEmpty():
            break
        sides = across.select("la", "w", "ord", "edge").union(across.select("lb", "w", "ord", "edge"))
        picked = cut(sides.groupBy("la").agg(F.min(F.struct("w", "ord", "edge")).alias("m")).select(F.col("m.edge").alias("edge")).distinct())
        chosen = picked if chosen is None else cut(chosen.union(picked))
        bridges = e.join(chosen, "edge", "left_semi")
        tree = Collection(c.graph, c.nodes, _semi(c.graph.edges, bridges.select("edge")))
        label = components(tree).withColumnRenamed("component", "l")
    none = e.limit(0) if chosen is None else e.join(chosen, "edge", "left_semi")
    return none.select("edge", "source", "target", "w")


def strongly_connected(c: Collection) -> DataFrame:
    """``id, component``: by forward and backward colouring; the name is a node of the component.

    In a round, the smallest id that reaches a node is its colour; the nodes of a colour that
    reach its owner back form the owner's component and leave."""
    walk = cut(arcs(c, directed=True).select("a", "b").distinct())
    left = cut(c.nodes.select("id"))
    done = None
    while not left.isEmpty():
        here = cut(walk.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
        colour = _spread(here, left.select("id", F.col("id").alias("l")), "a", "b")
        within = here.join(colour.withColumnsRenamed({"id": "a", "l": "la"}), "a").join(colour.withColumnsRenamed({"id": "b", "l": "lb"}), "b").where("la = lb")
        within = cut(within.select("a", "b"))
        reached = cut(colour.where("id = l").select("id"))
        front, rounds = reached, Rounds(reached)
        while not front.isEmpty():
            back = within.join(front.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
            front = cut(back.join(rounds.all(), "id", "left_anti"))
            rounds.add(front)
        reached = rounds.all()
        found = colour.join(reached, "id", "left_semi").select("id", F.col("l").alias("component"))
        done = cut(found if done is None else done.unionByName(found))
        left = cut(left.join(reached, "id", "left_anti"))
    return c.nodes.select("id", F.col("id").alias("component")).limit(0) if done is None else done


def between_components(c: Collection, found: DataFrame) -> DataFrame:
    """``id``: the edges that lie in none of the strongly connected components that ``found`` names."""
    of = found.select("id", "component")
    e = inner_edges(c).select("id", "source", "target")
    e = e.join(of.withColumnsRenamed({"id": "source", "component": "__s"}), "source").join(of.withColumnsRenamed({"id": "target", "component": "__t"}), "target")
    return e.where("__s <> __t").select("id")


def _spread(walk: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest label that reaches each node along a -> b."""
    state = cut(labels)
    while True:
        near = walk.join(state.withColumnRenamed("id", a), a).groupBy(F.col(b).alias("id")).agg(F.min("l").alias("m"))
        new = cut(state.join(near, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("was")))
        if new.where("l <> was").isEmpty():
            return state
        state = new.select("id", "l")


def euler_check(c: Collection, directed: bool = False) -> DataFrame:
    """``exists``: whether a trail uses every edge once - degrees of the whole graph and, of the
    nodes that have edges, one component."""
    d = c.nodes.select("id").join(c.graph.degrees, "id")
    if directed:
        odd = d.agg(F.coalesce(F.sum((F.col("outdegree") - F.col("indegree") == 1).cast("int")), F.lit(0)).alias("p"), F.coalesce(F.sum((F.col("indegree") - F.col("outdegree") == 1).cast("int")), F.lit(0)).alias("m"), F.coalesce(F.sum((F.abs(F.col("indegree") - F.col("outdegree")) > 1).cast("int")), F.lit(0)).alias("o"))
        test = (F.col("o") == 0) & (F.col("p") <= 1) & (F.col("m") <= 1)
    else:
        odd = d.agg(F.coalesce(F.sum((F.col("degree") % 2).cast("int")), F.lit(0)).alias("o"))
        test = F.col("o").isin(0, 2)
    parts = components(c).join(d.select("id"), "id", "left_semi").agg(F.countDistinct("component").alias("parts"))
    return odd.join(F.broadcast(parts)).select((test & (F.col("parts") <= 1)).alias("exists"))  # one row each
