"""Inherently sequential algorithms as iterative kernels, one group of rows for each component.

A kernel gets the arcs of one weakly connected component and nothing else, so the work is spread by
component; a component must fit a task's memory, as it must for any sequential algorithm, and ``max_rows``
turns a component that is too large into an error and not into a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Collection
from graphloom.operators.iterate import cut
from graphloom.operators.paths import components, inner_edges

MAX_ROWS = 5_000_000


def by_component(c: Collection, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, weight: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Runs the kernel on rows ``component, kind ('n' or 'e'), id, source, target, w, ord``."""
    label = cut(components(c))
    none = F.lit(None).cast("string")
    n = c.nodes.select("id", "ord").join(label, "id").select("component", F.lit("n").alias("kind"), "id", none.alias("source"), none.alias("target"), F.lit(0.0).alias("w"), "ord")
    e = inner_edges(c).withColumn("w", F.lit(1.0) if weight is None else weight.cast("double"))
    e = e.join(label.withColumnRenamed("id", "source"), "source").select("component", F.lit("e").alias("kind"), "id", "source", "target", "w", "ord")

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > max_rows:
            raise ValueError(f"component {rows['component'].iloc[0]!r} has {len(rows)} elements, more than max_rows={max_rows}")
        return kernel(rows.sort_values(["kind", "ord"], ascending=[False, True], kind="stable"))

    return n.unionByName(e).groupBy("component").applyInPandas(guarded, schema)


def _adjacency(rows: pd.DataFrame, directed: bool) -> tuple[list[str], dict[str, list[tuple[str, str]]]]:
    nodes = rows.loc[rows["kind"] == "n", "id"].tolist()
    near: dict[str, list[tuple[str, str]]] = {v: [] for v in nodes}
    for r in rows.loc[rows["kind"] == "e", ["id", "source", "target"]].itertuples(index=False):
        near[r.source].append((r.target, r.id))
        if not directed and r.source != r.target:
            near[r.target].append((r.source, r.id))
    return nodes, near


def dfs(c: Collection, root: str, directed: bool = False) -> DataFrame:
    """``id, place, depth, edge, pred`` in the order of visits from the root: a node is marked when it
    leaves the stack, so of several edges into it the last pushed counts."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, near = _adjacency(rows, directed)
        out, seen = [], set()
        stack = [(root, 0, None, None)] if root in near else []
        while stack:
            v, depth, edge, pred = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            out.append((v, len(out), depth, edge, pred))
            stack.extend((w, depth + 1, e, v) for w, e in near[v] if w not in seen)
        return pd.DataFrame(out, columns=["id", "place", "depth", "edge", "pred"])

    return by_component(c, kernel, "id string, place int, depth int, edge string, pred string")


def biconnected(c: Collection) -> DataFrame:
    """``part string, id, kind ('n' or 'e'), cut boolean``: members of each biconnected component,
    named by its smallest edge (an isolated node: by itself); ``cut`` marks cut vertices.  Direction,
    and loops for the low links, don't count; a loop joins the components of its node."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, near = _adjacency(rows, False)
        index, low, cuts, parts = {}, {}, set(), []
        for root in nodes:
            if root in index:
                continue
            index[root] = low[root] = len(index)
            branches, edges = 0, []
            stack = [(root, None, iter(near[root]))]
            while stack:
                v, via, todo = stack[-1]
                for w, e in todo:
                    if w == v or e == via:
                        continue
                    if w not in index:
                        edges.append((v, w, e))
                        index[w] = low[w] = len(index)
                        branches += v == root
                        stack.append((w, e, iter(near[w])))
                        break
                    if index[w] < index[v]:
                        edges.append((v, w, e))
                        low[v] = min(low[v], index[w])
                else:
                    stack.pop()
                    if stack:
                        u = stack[-1][0]
                        low[u] = min(low[u], low[v])
                        if low[v] >= index[u]:
                            part = []
                            while True:
                                x = edges.pop()
                                part.append(x)
                                if x[0] == u and x[1] == v:
                                    break
                            parts.append(part)
                            if u != root:
                                cuts.add(u)
            if branches > 1:
                cuts.add(root)
        out, covered = [], set()
        loops: dict[str, list[str]] = {}
        for r in rows.loc[(rows["kind"] == "e") & (rows["source"] == rows["target"]), ["id", "source"]].itertuples(index=False):
            loops.setdefault(r.source, []).append(r.id)
        for part in parts:
            name = min(e for _, _, e in part)
            members = {x for v, w, _ in part for x in (v, w)}
            covered |= members
            out += [(name, v, "n", v in cuts) for v in sorted(members)] + [(name, e, "e", False) for _, _, e in part]
            out += [(name, e, "e", False) for v in sorted(members) for e in loops.get(v, [])]
        for v in nodes:
            if v not in covered:
                out += [(v, v, "n", False)] + [(v, e, "e", False) for e in loops.get(v, [])]
        return pd.DataFrame(out, columns=["part", "id", "kind", "cut"])

    return by_component(c, kernel, "part string, id string, kind string, cut boolean")


def euler_trail(c: Collection, root: str | None = None, directed: bool = False) -> DataFrame:
    """``place, id``: nodes and edges of a trail that uses every edge of the collection once, in turn,
    starting at ``root`` or, without one, where a trail must start; no rows if there is none.
    Nodes appear as often as the trail meets them."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, near = _adjacency(rows, directed)
        none = pd.DataFrame([], columns=["place", "id"])
        count = int((rows["kind"] == "e").sum())
        if not count:
            return none
        e = rows.loc[rows["kind"] == "e"]
        out_n, in_n = e["source"].value_counts(), e["target"].value_counts()
        balance = {v: (int(out_n.get(v, 0)), int(in_n.get(v, 0))) for v in nodes}
        if directed:
            starts = [v for v, (o, i) in balance.items() if o - i == 1]
            odd = [v for v, (o, i) in balance.items() if o != i]
            if any(abs(o - i) > 1 for o, i in balance.values()) or len(odd) not in (0, 2):
                return none
        else:
            odd = starts = [v for v, (o, i) in balance.items() if (o + i) % 2]
            if len(odd) not in (0, 2):
                return none
        if root is not None and root in near and odd and root not in starts:
            return none
        first = root if root in near and near[root] else starts[0] if starts else next(v for v in nodes if near[v])
        used, stack, walk = set(), [(first, None)], []
        todo = {v: list(reversed(x)) for v, x in near.items()}
        while stack:
            v = stack[-1][0]
            while todo[v] and todo[v][-1][1] in used:
                todo[v].pop()
            if todo[v]:
                w, edge = todo[v].pop()
                used.add(edge)
                stack.append((w, edge))
            else:
                walk.append(stack.pop())
        if len(used) != count:
            return none
        ids = []
        for v, edge in reversed(walk):
            ids += ([edge] if edge is not None else []) + [v]
        return pd.DataFrame({"place": range(len(ids)), "id": ids})

    trails = by_component(c, kernel, "place int, id string")
    from graphloom.operators.paths import euler_check

    return trails.join(F.broadcast(euler_check(c, directed).where("exists")).select(F.lit(True).alias("__ok"))).drop("__ok")  # one row


def min_cut(c: Collection, seed: int = 1, trials: int | None = None) -> dict:
    """``cut`` edge ids and the two sides ``partition1``, ``partition2`` of a small cut by recursive
    random contraction; the trials run in parallel and the smallest cut (of equals the first trial's)
    wins.  Loops don't count.  Raises for fewer than two nodes or a graph in several parts."""
    e = inner_edges(c, loops=False).select("id", "source", "target").orderBy("id").limit(MAX_ROWS + 1)
    edges = [tuple(r) for r in e.collect()]  # a contraction needs the whole edge list; MAX_ROWS bounds it
    nodes = [r["id"] for r in c.nodes.select("id").orderBy("id").limit(MAX_ROWS + 1).collect()]
    if max(len(edges), len(nodes)) > MAX_ROWS:
        raise ValueError("the graph is too large for contraction")
    n = len(nodes)
    if n < 2:
        raise ValueError("At least 2 nodes are required for Karger-Stein algorithm")
    place = {v: i for i, v in enumerate(nodes)}
    ends = np.array([(place[s], place[t]) for _, s, t in edges], dtype=np.int64).reshape(-1, 2)
    runs = trials or math.ceil(math.log2(n) ** 2) + 1
    spark = c.graph.nodes.sparkSession
    shared = spark.sparkContext.broadcast((n, ends))

    def contract(label: np.ndarray, to: int, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
        parts = len(np.unique(label))
        label = label.copy()
        for i in order:
            if parts <= to:
                break
            a, b = label[ends[i, 0]], label[ends[i, 1]]
            if a != b:
                label[label == b] = a
                parts -= 1
        return label

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ends = shared.value
        for batch in batches:
            for trial in batch["id"]:
                rng = np.random.default_rng([seed, int(trial)])
                base = contract(np.arange(n), max(2, int(n / math.sqrt(2))), rng.permutation(len(ends)), ends)
                for k in range(2):
                    label = contract(base, 2, rng.permutation(len(ends)), ends)
                    if len(np.unique(label)) > 2:
                        raise ValueError("Graph must be connected to run Karger-Stein")
                    crossing = np.flatnonzero(label[ends[:, 0]] != label[ends[:, 1]])
                    yield pd.DataFrame({"size": [len(crossing)], "trial": [2 * int(trial) + k], "edges": [crossing.tolist()], "side": [np.flatnonzero(label == label[0]).tolist()]})

    best = spark.range(runs).mapInPandas(run, "size long, trial long, edges array<long>, side array<long>").orderBy("size", "trial").first()
    side = {nodes[i] for i in best["side"]}
    return {"cut": [edges[i][0] for i in best["edges"]], "partition1": sorted(side), "partition2": sorted(set(nodes) - side)}
