"""Changes: every operator gives a new graph; the members of a collection are marked by a join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import FLAGS, IMMUTABLE, Collection, Graph, _semi, normalise
from graphloom.operators.iterate import cut


SCRATCH = "scratch:"


def _member() -> Column:
    return F.coalesce("__member", F.lit(False))



def _marked(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select("id").distinct().withColumn("__member", F.lit(True)), "id", "left")


def _update(df: DataFrame, members: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Sets columns on members only; new columns are null elsewhere."""
    marked = _marked(df, members)
    test = _member() if where is None else _member() & where
    new = {c: F.when(test, v).otherwise(F.col(f"`{c}`") if c in df.columns else F.lit(None)) for c, v in values.items()}
    return marked.withColumns(new).drop("__member") if new else df


def _each(c: Collection, values: dict[str, Column | Callable], where: Column | None = None) -> Graph:
    """A value may be a function of the table that gives its column, or None to leave the table alone."""

    def of(df: DataFrame) -> dict[str, Column]:
        given = {k: v(df) if callable(v) and not isinstance(v, Column) else v for k, v in values.items()}
        return {k: v for k, v in given.items() if v is not None}

    return c.graph.with_(nodes=_update(c.graph.nodes, c.nodes, of(c.graph.nodes), where), edges=_update(c.graph.edges, c.edges, of(c.graph.edges), where))


# data


def set_data(c: Collection, values: dict[str, Any]) -> Graph:
    """Sets data fields (constants, columns, or functions of a table that give one) on all elements; identity fields are left alone."""
    return _each(c, {k: v if isinstance(v, Column) or callable(v) else F.lit(v) for k, v in values.items() if k not in IMMUTABLE})


def remove_data(c: Collection, names: list[str] | None = None) -> Graph:
    """Undefines the fields, by default all data fields but the identity."""
    from graphloom.graph import EDGE_COLUMNS, NODE_COLUMNS

    def gone(df: DataFrame, fixed: list[str]) -> dict[str, Column]:
        return {k: F.lit(None).cast(df.schema[k].dataType) for k in (df.columns if names is None else names) if k in df.columns and k not in fixed and k not in IMMUTABLE}

    return c.graph.with_(nodes=_update(c.graph.nodes, c.nodes, gone(c.nodes, NODE_COLUMNS)), edges=_update(c.graph.edges, c.edges, gone(c.edges, EDGE_COLUMNS)))


def set_scratch(c: Collection, values: dict[str, Any]) -> Graph:
    """Like ``set_data`` on a bag of its own, which selectors and JSON don't see: columns ``scratch:name``."""
    return _each(c, {f"{SCRATCH}{k}": v if isinstance(v, Column) or callable(v) else F.lit(v) for k, v in values.items()})


def scratch(c: Collection, name: str) -> DataFrame:
    """``id, value`` of nodes and edges that have the field in their scratch."""
    field = f"{SCRATCH}{name}"
    parts = [df.select("id", F.col(f"`{field}`").alias("value")) for df in (c.nodes, c.edges) if field in df.columns]
    found = reduce(DataFrame.unionByName, parts) if parts else c.nodes.select("id", F.lit(None).cast("string").alias("value"))
    return found.where("value is not null")


def remove_scratch(c: Collection, names: list[str] | None = None) -> Graph:
    """Undefines the fields of the scratch, by default all."""
    gone = lambda df: {k: F.lit(None).cast(df.schema[k].dataType) for k in df.columns if k.startswith(SCRATCH) and (names is None or k.removeprefix(SCRATCH) in names)}
    return c.graph.with_(nodes=_update(c.graph.nodes, c.nodes, gone(c.graph.nodes)), edges=_update(c.graph.edges, c.edges, gone(c.graph.edges)))


def batch_data(g: Graph, updates: DataFrame) -> Graph:
    """A table ``id, field...`` of new values; null leaves the old one."""
    names = [c for c in updates.columns if c not in IMMUTABLE]
    new = updates.select("id", *[F.col(c).alias(f"__{c}") for c in names])

    def on(df: DataFrame) -> DataFrame:
        joined = df.join(new, "id", "left")
        return joined.withColumns({c: F.coalesce(f"__{c}", c) if c in df.columns else F.col(f"__{c}") for c in names}).drop(*[f"__{c}" for c in names])

    return g.with_(nodes=on(g.nodes), edges=on(g.edges))


# classes


def _names(text: str) -> Column:
    return F.array(*[F.lit(n) for n in dict.fromkeys(text.split())]).cast("array<string>")


def set_classes(c: Collection, text: str) -> Graph:
    return _each(c, {"classes": _names(text)})


def add_class(c: Collection, text: str) -> Graph:
    return _each(c, {"classes": F.array_union("classes", _names(text))})


def remove_class(c: Collection, text: str) -> Graph:
    return _each(c, {"classes": F.array_except("classes", _names(text))})


def toggle_class(c: Collection, text: str, on: bool | None = None) -> Graph:
    if on is not None:
        return add_class(c, text) if on else remove_class(c, text)
    new = _names(text)
    return _each(c, {"classes": F.concat(F.array_except("classes", new), F.array_except(new, "classes"))})


def has_class(df: DataFrame, name: str) -> Column:
    return F.array_contains(df["classes"], name)


# flags

SWITCHES = {
    "lock": ("locked", True), "unlock": ("locked", False), "grabify": ("grabbable", True), "ungrabify": ("grabbable", False),
    "select": ("selected", True), "unselect": ("selected", False), "deselect": ("selected", False), "selectify": ("selectable", True),
    "unselectify": ("selectable", False), "activate": ("active", True), "unactivate": ("active", False), "panify": ("pannable", True),
    "unpanify": ("pannable", False),
}


def switch(c: Collection, name: str) -> Graph:
    """lock, unlock, select, ...; selecting needs an element that is selectable in a graph without autounselectify."""
    flag, on = SWITCHES[name]
    where = None
    if flag == "selected":
        if c.graph.autounselectify:
            return c.graph
        where = F.col("selectable")
    return _each(c, {flag: F.lit(on)}, where)


def flags(g: Graph) -> DataFrame:
    """Flags as they read, with the graph's overrides."""
    read = {"locked": F.col("locked") | F.lit(g.autolock), "grabbable": F.col("grabbable") & ~F.lit(g.autoungrabify), "selectable": F.col("selectable") & ~F.lit(g.autounselectify)}
    cols = ["id", *[read.get(f, F.col(f)).alias(f) for f in FLAGS]]
    return g.nodes.select(*cols).unionByName(g.edges.select(*cols))


# structure


def add(g: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """Inserts elements: ids that exist are skipped, the first of equal new ids wins, an edge
    without both ends raises, a parent that doesn't exist is dropped."""
    from graphloom.sources.elements import checked

    def grown(old: DataFrame, new: DataFrame | None, is_edges: bool) -> DataFrame:
        if new is None:
            return old
        last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).first()["m"]
        new = normalise(new, is_edges).withColumn("ord", F.col("ord") + last + 1)
        return old.unionByName(_semi(new, g.nodes.select("id").union(g.edges.select("id")), how="left_anti"), allowMissingColumns=True)

    both = checked(grown(g.nodes, nodes, False), grown(g.edges, edges, True))
    return g.with_(nodes=both[0], edges=both[1])


def remove(c: Collection) -> Graph:
    """Removes the elements, the descendants of their nodes and the edges of all those nodes."""
    from graphloom.operators.traverse import descendants

    gone = cut(c.nodes.select("id").union(descendants(c).nodes.select("id")).distinct())
    nodes = _semi(c.graph.nodes, gone, how="left_anti")
    edges = _semi(_semi(_semi(c.graph.edges, c.edges.select("id"), how="left_anti"), gone, "source", "left_anti"), gone, "target", "left_anti")
    return c.graph.with_(nodes=nodes, edges=edges)


def restore(g: Graph, removed: Collection) -> Graph:
    """Puts removed elements back that the graph no longer has."""
    return add(g, _semi(removed.nodes, g.nodes.select("id"), how="left_anti"), _semi(removed.edges, g.edges.select("id"), how="left_anti"))


def move(c: Collection, source: str | None = None, target: str | None = None, parent: str | None = "") -> Graph:
    """New ends for edges or a new parent for nodes (None: no parent); ids that don't exist are
    ignored, and so is a parent that is the node itself or below it."""
    g, values = c.graph, {}
    for name, new in (("source", source), ("target", target)):
        if new is not None and not g.nodes.where(F.col("id") == new).isEmpty():
            values[name] = F.lit(new)
    edges = _update(g.edges, c.edges, values) if values else g.edges
    nodes = g.nodes
    if parent is None:
        nodes = _update(nodes, c.nodes, {"parent": F.lit(None).cast("string")})
    elif parent != "" and not g.nodes.where(F.col("id") == parent).isEmpty():
        above = g.closure().where(F.col("id") == parent).select(F.col("ancestor").alias("id"))
        movable = _semi(c.nodes.where(F.col("id") != parent), above, how="left_anti")
        nodes = _update(nodes, movable, {"parent": F.lit(parent)})
    return g.with_(nodes=nodes, edges=edges)


def sync(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Makes the graph hold exactly these elements: missing ones are inserted, present ones take the
    new values where given, others go; children of a parent that goes become orphans first."""

    def merged(old: DataFrame, new: DataFrame, is_edges: bool) -> DataFrame:
        given = set(new.columns)
        new = normalise(new, is_edges)
        old_names = {c: F.col(c).alias(f"__old_{c}") for c in old.columns}
        joined = new.join(old.select(*old_names.values()), F.col("id") == F.col("__old_id"), "left")
        out = []
        for c in dict.fromkeys([*old.columns, *new.columns]):
            was = F.col(f"__old_{c}") if c in old.columns else None
            if c == "ord":
                out.append(F.coalesce("__old_ord", F.col("ord") + F.lit(1 << 40)).alias("ord"))
            elif c not in given and was is not None:
                out.append((F.when(F.col("__old_id").isNotNull(), was).otherwise(F.col(c)) if c in new.columns else was).alias(c))
            else:
                out.append((F.coalesce(F.col(c), was) if was is not None else F.col(c)).alias(c))
        return joined.select(*out)

    from graphloom.sources.elements import checked

    both = checked(merged(g.nodes, nodes, False), merged(g.edges, edges, True))
    return g.with_(nodes=both[0], edges=both[1])


# positions


def set_positions(c: Collection, x: Column, y: Column) -> Graph:
    """Nodes that aren't locked take the new place, and what is below them moves along."""
    g = c.graph
    free = c.nodes.where(~(F.col("locked") | F.lit(g.autolock)))
    to = free.select("id", (x - F.col("x")).alias("__dx"), (y - F.col("y")).alias("__dy"))
    return _moved(g, to)


def shift(c: Collection, dx: float, dy: float) -> Graph:
    """Moves nodes that aren't locked; a node below another moved node moves once."""
    free = c.nodes.where(~(F.col("locked") | F.lit(c.graph.autolock)))
    return _moved(c.graph, free.select("id", F.lit(float(dx)).alias("__dx"), F.lit(float(dy)).alias("__dy")))


def _moved(g: Graph, to: DataFrame) -> Graph:
    """A step for each moved node; those below follow their farthest moved ancestor's step."""
    to = cut(to)
    lead = g.closure().join(to.withColumnRenamed("id", "ancestor"), "ancestor")
    led = lead.groupBy("id").agg(F.max_by(F.struct("__dx", "__dy"), "depth").alias("s")).select("id", "s.__dx", "s.__dy")
    steps = to.join(led, "id", "left_anti").unionByName(led)
    nodes = g.nodes.join(steps, "id", "left")
    dx, dy = F.coalesce("__dx", F.lit(0.0)), F.coalesce("__dy", F.lit(0.0))
    return g.with_(nodes=nodes.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).drop("__dx", "__dy"))


def rendered_position(g: Graph) -> DataFrame:
    """``id, x, y`` on the screen: model times zoom plus pan."""
    return g.nodes.select("id", (F.col("x") * g.zoom + g.pan[0]).alias("x"), (F.col("y") * g.zoom + g.pan[1]).alias("y"))


def relative_position(g: Graph) -> DataFrame:
    """``id, x, y`` from the parent's place; without a parent the place itself."""
    p = g.nodes.select(F.col("id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    joined = g.nodes.join(p, "parent", "left")
    return joined.select("id", (F.col("x") - F.coalesce("px", F.lit(0.0))).alias("x"), (F.col("y") - F.coalesce("py", F.lit(0.0))).alias("y"))
