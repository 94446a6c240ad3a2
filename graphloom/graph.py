"""A property graph as two DataFrames, and collections of its elements.

``nodes``: ``id string, ord long, parent string``, any data columns, ``classes array<string>``,
``x, y double`` and flags.  ``edges``: the same with ``source, target string`` and no parent or
position.  ``ord`` is the order of insertion; wherever the first of several elements wins, it decides.
Columns that a table lacks are added as constants, which cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = {
    "selected": False, "selectable": True, "locked": False, "grabbed": False, "grabbable": True,
    "active": False, "pannable": False, "removed": False,
}
NODE_COLUMNS = ["ord", "id", "parent", "classes", "x", "y", *FLAGS]
EDGE_COLUMNS = ["ord", "id", "source", "target", "classes", *FLAGS]
#: Values that a fold takes at a time, and those that a fold without a merge takes at all.
FOLD, ONE_ROW = 4096, 1_000_000
#: Identity of elements; ``data`` setters leave these alone, only ``move`` changes them.
IMMUTABLE = ("id", "source", "target", "parent")


def normalise(df: DataFrame, edges: bool) -> DataFrame:
    """Adds the standard columns that are missing and casts the ids."""
    have, add = set(df.columns), {}
    for c in ("id", "source", "target") if edges else ("id",):
        add[c] = F.col(c).cast("string")
    if "ord" not in have:
        add["ord"] = F.monotonically_increasing_id()
    if not edges:
        add["parent"] = F.col("parent").cast("string") if "parent" in have else F.lit(None).cast("string")
        for c in ("x", "y"):
            add[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    if "classes" not in have:
        add["classes"] = F.array().cast("array<string>")
    for c, value in FLAGS.items():
        add[c] = F.coalesce(F.col(c), F.lit(value)) if c in have else F.lit(value)
    return df.withColumns(add)


@dataclass(frozen=True)
class Graph:
    """An immutable graph: every change gives a new one.

    ``hidden`` and ``opacity`` conditions of the style, which some states ask for, are ordinary
    columns ``display``, ``visibility``, ``opacity`` of the tables, where present."""

    nodes: DataFrame
    edges: DataFrame
    data: dict[str, Any] = field(default_factory=dict)
    scratch: dict[str, Any] = field(default_factory=dict)
    autolock: bool = False
    autoungrabify: bool = False
    autounselectify: bool = False
    zoom: float = 1.0
    pan: tuple[float, float] = (0.0, 0.0)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, **options) -> Graph:
        return cls(normalise(nodes, False), normalise(edges, True), **options)

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    # data of the graph itself

    def set_data(self, **values: Any) -> Graph:
        """The graph with these fields of its own data set."""
        return self.with_(data={**self.data, **values})

    def remove_data(self, *names: str) -> Graph:
        """Without these fields of its own data, without any if none is named."""
        return self.with_(data={k: v for k, v in self.data.items() if names and k not in names})

    def set_scratch(self, **values: Any) -> Graph:
        return self.with_(scratch={**self.scratch, **values})

    def remove_scratch(self, *names: str) -> Graph:
        return self.with_(scratch={k: v for k, v in self.scratch.items() if names and k not in names})

    # scans and lookups

    def elements(self, selector: str | None = None) -> Collection:
        every = Collection(self, self.nodes, self.edges)
        return every if selector is None or selector == "" else every.filter(selector)

    select = elements

    def get(self, element_id: str) -> Collection:
        """The element with this id; an equality that reaches the scan."""
        return Collection(self, self.nodes.where(F.col("id") == element_id), self.edges.where(F.col("id") == element_id))

    def has(self, element_id: str) -> bool:
        return not self.get(element_id).is_empty()

    def empty(self) -> Collection:
        return Collection(self, self.nodes.limit(0), self.edges.limit(0))

    @cached_property
    def both_ways(self) -> DataFrame:
        """``a, b, id, ord, forward``: each edge from both of its ends, a loop once."""
        e = self.edges.select("id", "ord", "source", "target")
        there = e.select(F.col("source").alias("a"), F.col("target").alias("b"), "id", "ord", F.lit(True).alias("forward"))
        back = e.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"), "id", "ord", F.lit(False).alias("forward"))
        return there.unionByName(back)

    @cached_property
    def degrees(self) -> DataFrame:
        """``id, degree, indegree, outdegree`` of nodes that have edges; a loop counts twice in
        the degree and once in each of the others."""
        ends = self.edges.select(F.explode(F.array(
            F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("e")).select("e.*")
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))

    def closure(self) -> DataFrame:
        """``id, ancestor, depth`` of the compound hierarchy, nearest ancestor first (depth 1).
        Each round doubles the depth, until nothing is deeper; a hierarchy with a ring raises."""
        from graphloom.operators.iterate import cut

        up = self.nodes.where("parent is not null").select("id", "parent")
        up = up.join(self.nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
        found = level = cut(up.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
        deepest = 1
        while level.where("id = ancestor").isEmpty():
            step = found.where(F.col("depth") == deepest).select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
            level = cut(found.join(step, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + deepest).alias("depth")))
            if level.isEmpty():
                return found
            found, deepest = found.unionByName(level), 2 * deepest
        raise ValueError("a node of the hierarchy is its own ancestor")

    def parents(self) -> DataFrame:
        """``id`` of nodes that are the parent of some node."""
        return self.nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()


def _semi(df: DataFrame, ids: DataFrame, on: str = "id", how: str = "left_semi") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias("__in")), df[on] == F.col("__in"), how)


@dataclass(frozen=True)
class Collection:
    """A set of elements of a graph: two subsets of its tables, with all their columns."""

    graph: Graph
    nodes: DataFrame
    edges: DataFrame

    def _of(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Collection:
        none = self.graph.nodes.limit(0), self.graph.edges.limit(0)
        return Collection(self.graph, none[0] if nodes is None else nodes, none[1] if edges is None else edges)

    def only_nodes(self, selector: str | None = None) -> Collection:
        c = self._of(nodes=self.nodes)
        return c if selector is None else c.filter(selector)

    def only_edges(self, selector: str | None = None) -> Collection:
        c = self._of(edges=self.edges)
        return c if selector is None else c.filter(selector)

    def ids(self) -> DataFrame:
        return self.nodes.select("id").union(self.edges.select("id"))

    def table(self) -> DataFrame:
        """``id, grp, ord``, nodes before edges."""
        n = self.nodes.select("id", F.lit("nodes").alias("grp"), "ord")
        return n.unionByName(self.edges.select("id", F.lit("edges").alias("grp"), "ord"))

    def by_group(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "edges": self.edges}

    # filters

    def filter(self, test: str | Callable[[DataFrame], Column]) -> Collection:
        """By selector text, or by a condition that is built from each table."""
        if callable(test):
            return self._of(self.nodes.where(test(self.nodes)), self.edges.where(test(self.edges)))
        from graphloom.plans.selector import apply_selector

        if test == "":
            return self._of()
        return apply_selector(test, self)

    def within(self, ids: DataFrame) -> Collection:
        return self._of(_semi(self.nodes, ids), _semi(self.edges, ids))

    def without(self, ids: DataFrame) -> Collection:
        return self._of(_semi(self.nodes, ids, how="left_anti"), _semi(self.edges, ids, how="left_anti"))

    # set algebra

    def union(self, other: Collection) -> Collection:
        """Left order first, then what is new on the right: it stays an element's own ``ord``."""
        extra = other.without(self.ids())
        return self._of(self.nodes.unionByName(extra.nodes), self.edges.unionByName(extra.edges))

    def difference(self, other: Collection) -> Collection:
        return self._of(_semi(self.nodes, other.nodes.select("id"), how="left_anti"), _semi(self.edges, other.edges.select("id"), how="left_anti"))

    def intersection(self, other: Collection | str) -> Collection:
        if isinstance(other, str):
            return self.filter(other)
        return self._of(_semi(self.nodes, other.nodes.select("id")), _semi(self.edges, other.edges.select("id")))

    def symmetric_difference(self, other: Collection) -> Collection:
        left, right = self.difference(other), other.difference(self)
        return self._of(left.nodes.unionByName(right.nodes), left.edges.unionByName(right.edges))

    def diff(self, other: Collection) -> dict[str, Collection]:
        return {"left": self.difference(other), "right": other.difference(self), "both": self.intersection(other)}

    def absolute_complement(self) -> Collection:
        return self.graph.elements().difference(self)

    __or__ = __add__ = union
    __sub__ = difference
    __and__ = intersection
    __xor__ = symmetric_difference
    merge, unmerge = union, difference  # frames don't change; rebind the name instead
    add, u, or_ = union, union, union
    not_, subtract, relative_complement = difference, difference, difference
    intersect, and_, n = intersection, intersection, intersection
    xor, symdiff = symmetric_difference, symmetric_difference
    complement, abscomp = absolute_complement, absolute_complement

    # comparisons

    def is_(self, selector: str) -> bool:
        return not self.filter(selector).is_empty()

    def all_are(self, selector: str) -> bool:
        return self.difference(self.filter(selector)).is_empty()

    def some(self, test: Callable[[DataFrame], Column]) -> bool:
        return not self.filter(test).is_empty()

    def every(self, test: Callable[[DataFrame], Column]) -> bool:
        return self.filter(lambda df: ~F.coalesce(test(df), F.lit(False))).is_empty()

    def same(self, other: Collection) -> bool:
        return self.symmetric_difference(other).is_empty()

    def any_same(self, other: Collection) -> bool:
        return not self.intersection(other).is_empty()

    def contains(self, other: Collection) -> bool:
        return other.difference(self).is_empty()

    def all_are_neighbors(self, other: Collection) -> bool:
        from graphloom.operators.traverse import neighborhood

        return neighborhood(self).contains(other)

    equals, has = same, contains

    # order, size and folds

    def is_empty(self) -> bool:
        return self.nodes.isEmpty() and self.edges.isEmpty()

    def size(self) -> int:
        return self.nodes.count() + self.edges.count()

    def indexed(self) -> DataFrame:
        """``id, grp, index``: places from 0, nodes first, then by ``ord``."""
        from graphloom.operators.iterate import global_index

        return global_index(self.table(), [F.col("grp").desc(), "ord", "id"], "index").select("id", "grp", "index")

    def slice(self, start: int = 0, end: int | None = None) -> Collection:
        """By place, end exclusive; negative numbers count from the end."""
        placed = self.indexed()
        n = placed.count() if start < 0 or (end or 0) < 0 else 0
        lo = start + n if start < 0 else start
        test = F.col("index") >= lo
        if end is not None:
            test &= F.col("index") < (end + n if end < 0 else end)
        return self.within(placed.where(test).select("id"))

    def eq(self, i: int) -> Collection:
        return self.slice(i, i + 1 if i != -1 else None)

    def first(self) -> Collection:
        return self.within(self.table().orderBy(F.col("grp").desc(), "ord", "id").limit(1).select("id"))

    def last(self) -> Collection:
        return self.within(self.table().orderBy("grp", F.col("ord").desc(), F.col("id").desc()).limit(1).select("id"))

    def sort(self, *keys: Column | str) -> DataFrame:
        """Nodes sorted by the keys, ties in order of insertion."""
        return self.nodes.orderBy(*keys, "ord")

    def top(self, k: int, *keys: Column | str) -> DataFrame:
        return self.sort(*keys).limit(k)

    def extreme(self, value: Column, largest: bool = True) -> DataFrame:
        """``value, id`` of the node with the largest (smallest) number; the first of equals;
        NaN and null never win; no row if there is none."""
        v = value.cast("double")
        rows = self.nodes.select("id", "ord", v.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
        return rows.orderBy(F.col("value").desc() if largest else "value", "ord").limit(1).select("value", "id")

    def reduce(self, start: Column, step: Callable[[Column, Column], Column], value: Column, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """``result``: a left fold over the nodes' values in order.  With ``merge``, which joins two results of neighbouring
        parts (and leaves a result as it is when joined with ``start``), parts of ``FOLD`` values are folded apart and their results merged, level by
        level, so any number of nodes will do.  A step without one needs all values in one row: more than ``ONE_ROW`` raise."""
        from graphloom.operators.iterate import cut, global_index

        fold = lambda df, f: df.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all")).withColumn("v", F.aggregate("all", start, lambda acc, x: f(acc, x["v"])))
        if merge is None:
            rows = self.nodes.select(F.col("ord").alias("i"), value.alias("v"))
            if rows.count() > ONE_ROW:
                raise ValueError(f"a fold of more than {ONE_ROW} values needs a merge")
            return fold(rows, step).select(F.col("v").alias("result"))
        rows, f = global_index(self.nodes.select("ord", value.alias("v")), ["ord"], "i"), step
        while True:
            parts = cut(fold(rows.groupBy(F.floor(F.col("i") / FOLD).alias("part")), f).select(F.col("part").alias("i"), "v"))
            if parts.count() <= 1:
                return fold(parts, merge).select(F.col("v").alias("result"))
            rows, f = parts, merge

    def to_rows(self) -> Iterator:
        """Streams the elements to the driver, a partition at a time."""
        return self.table().orderBy(F.col("grp").desc(), "ord").toLocalIterator()
