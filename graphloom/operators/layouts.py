"""Layouts: operators that give ``id, x, y``; parents take no part, locked nodes stay."""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Collection, Graph
from graphloom.operators.iterate import cut, global_index

Box = tuple[float, float, float, float]  # x1, y1, w, h
#: Nodes whose forces are worked out together.
PUSHED = 256
LAYOUTS: dict[str, Callable[..., DataFrame]] = {}


def layout(name: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in LAYOUTS:
            raise ValueError(f"there is a layout {name!r} already")
        LAYOUTS[name] = f
        return f

    return register


def run(c: Collection, name: str, **options) -> DataFrame:
    return LAYOUTS[name](c, **options)


def apply(g: Graph, positions: DataFrame, spacing: float = 1.0) -> Graph:
    """Puts the positions into the graph; ``spacing`` scales them about the middle of their box."""
    p = positions.select("id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    if spacing != 1.0:
        mid = p.agg(((F.min("__x") + F.max("__x")) / 2).alias("mx"), ((F.min("__y") + F.max("__y")) / 2).alias("my"))
        p = p.join(F.broadcast(mid)).select("id", ((F.col("__x") - F.col("mx")) * spacing + F.col("mx")).alias("__x"), ((F.col("__y") - F.col("my")) * spacing + F.col("my")).alias("__y"))  # one row
    nodes = g.nodes.join(p, "id", "left")
    free = F.col("__x").isNotNull() & ~(F.col("locked") | F.lit(g.autolock))
    return g.with_(nodes=nodes.withColumns({"x": F.when(free, F.col("__x")).otherwise(F.col("x")), "y": F.when(free, F.col("__y")).otherwise(F.col("y"))}).drop("__x", "__y"))


def _placed(c: Collection, sort: list[Column | str] | None) -> tuple[DataFrame, int]:
    """Childless nodes with their place in the order, and their number."""
    rows = cut(global_index(c.nodes.join(c.graph.parents(), "id", "left_anti"), [*(sort or []), "ord"], "__i"))
    return rows, rows.count()


@layout("null")
def null(c: Collection) -> DataFrame:
    return c.nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


@layout("preset")
def preset(c: Collection, positions: DataFrame) -> DataFrame:
    """Given places; nodes without one, and locked nodes, keep theirs."""
    p = positions.select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    rows = c.nodes.join(p, "id", "left")
    return rows.select("id", *[F.when(F.col("locked"), F.col(k)).otherwise(F.coalesce(f"p{k}", k)).alias(k) for k in ("x", "y")])


@layout("random")
def random(c: Collection, box: Box = (0, 0, 1000, 1000), seed: int = 1) -> DataFrame:
    """Uniform whole numbers in the box, from 28 bits of a hash of the seed and the id."""
    text = lambda axis: F.concat(F.lit(f"{seed}:{axis}:"), F.col("id"))
    u = lambda axis: F.conv(F.substring(F.md5(text(axis).cast("binary")), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
    return c.nodes.select("id", F.floor(box[0] + u(1) * box[2] + 0.5).cast("double").alias("x"), F.floor(box[1] + u(2) * box[3] + 0.5).cast("double").alias("y"))


def grid_shape(cells: int, w: float, h: float, rows: int | None = None, cols: int | None = None) -> tuple[int, int]:
    """Rows and columns for so many cells in a box.

    Free sides start at the nearest whole numbers to those of square cells.  If that is too much room, one line less is
    enough, if any: of the shorter side if the rest still has room, since that saves most, else of the longer one.  If it is too
    little, lines are added until there is room: to the longer side if that is enough, since it adds least, else to the
    shorter one.  Of equal sides the rows give way first."""
    if rows or cols:
        return rows or math.ceil(cells / cols), cols or math.ceil(cells / rows)
    splits = math.sqrt(cells * h / w)
    shape = (math.floor(splits + 0.5), math.floor(w / h * splits + 0.5))
    room = lambda s: s[0] * s[1] >= cells

    def lines(s: tuple[int, int], longer: bool, by: int) -> tuple[int, int]:
        on_rows = s[0] >= s[1] if longer else s[0] <= s[1]
        return (s[0] + by, s[1]) if on_rows else (s[0], s[1] + by)

    if shape[0] * shape[1] > cells:
        return next(s for s in (lines(shape, False, -1), lines(shape, True, -1), shape) if room(s))
    while not room(shape):
        wide = lines(shape, True, 1)
        shape = wide if room(wide) else lines(shape, False, 1)
    return shape


@layout("grid")
def grid(c: Collection, box: Box = (0, 0, 1000, 1000), rows: int | None = None, cols: int | None = None, sort: list[Column | str] | None = None, condense: bool = False, avoid_overlap: bool = False, padding: float = 10.0, size: tuple[Column, Column] | None = None, position: tuple[Column, Column] | None = None, skip_locked: bool = False) -> DataFrame:
    """Row by row in cells that fill the box.  ``condense``: cells of no size, so that with ``avoid_overlap`` they are as wide and
    as high as the largest node and ``padding``; ``size`` gives the widths and heights (default: columns ``width, height``, else 1).
    ``position``: columns of the row and the column of nodes that choose their own; a node with one of the two gets the first
    places that no node with both has taken in that row or column, in order.  The others pass over chosen cells.  With ``skip_locked``, locked
    nodes take no cell and stay; else they have one, which ``apply`` doesn't move them to."""
    placed, n = _placed(c, sort)
    if not n or not box[2] or not box[3]:
        return placed.select("id", F.lit(float(box[0])).alias("x"), F.lit(float(box[1])).alias("y"))
    r, k = grid_shape(n, box[2], box[3], rows, cols)
    w, h = (0.0, 0.0) if condense else (box[2] / k, box[3] / r)
    if avoid_overlap:
        sizes = size or tuple(F.col(s) if s in c.nodes.columns else F.lit(1.0) for s in ("width", "height"))
        most = placed.agg(*[F.max(s.cast("double")) for s in sizes]).first()
        w, h = max(w, (most[0] or 0.0) + padding), max(h, (most[1] or 0.0) + padding)
    at = lambda df: df.select("id", (F.col("__c") * w + w / 2 + box[0]).alias("x"), (F.col("__r") * h + h / 2 + box[1]).alias("y"))
    free = placed.where("not locked") if skip_locked else placed
    stay = placed.where("locked" if skip_locked else "false").select("id", "x", "y")
    if position is None:
        if not skip_locked:
            return at(free.select("id", F.floor(F.col("__i") / k).alias("__r"), (F.col("__i") % k).alias("__c")))
        taken = None
    else:
        own = cut(free.select("id", "__i", position[0].cast("long").alias("__r"), position[1].cast("long").alias("__c")))
        both = own.where("__r is not null and __c is not null").select("id", "__r", "__c")
        chosen = both
        for have, lack in (("__r", "__c"), ("__c", "__r")):
            part = own.where(f"{have} is not null and {lack} is null").select("id", "__i", F.col(have).alias("g"))
            used = both.groupBy(F.col(have).alias("g")).agg(F.collect_set(lack).alias("used"))  # one row or column of the grid
            rank = part.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("__i")) - 1).join(used, "g", "left")
            spare = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("k") + F.size(F.coalesce("used", F.array().cast("array<bigint>")))), F.coalesce("used", F.array().cast("array<bigint>")))
            chosen = chosen.unionByName(rank.select("id", F.col("g").alias(have), F.get(spare, F.col("k").cast("int")).alias(lack)))
        chosen = cut(chosen)
        taken = chosen.where(F.col("__c").between(0, k - 1)).select((F.col("__r") * k + F.col("__c")).alias("cell")).distinct()
        free = free.join(own.where("__r is null and __c is null").select("id"), "id", "left_semi")
    rest = global_index(free.select("id", "__i"), ["__i"], "key").select("id", "key")
    if taken is not None:
        # the i-th node's cell is its place among nodes and taken cells, which count from the cell's number less the taken ones before it
        gone = global_index(taken, ["cell"], "j").select(F.lit(None).cast("string").alias("id"), (F.col("cell") - F.col("j")).alias("key"))
        mixed = rest.withColumn("kind", F.lit(1)).unionByName(gone.withColumn("kind", F.lit(0)))
        rest = global_index(mixed, ["key", "kind"], "cell").where("kind = 1").select("id", F.col("cell").alias("key"))
    auto = at(rest.select("id", F.floor(F.col("key") / k).alias("__r"), (F.col("key") % k).alias("__c")))
    done = auto.unionByName(stay)
    return done if position is None else done.unionByName(at(chosen))


@layout("circle")
def circle(c: Collection, box: Box = (0, 0, 1000, 1000), start: float = 1.5 * math.pi, sweep: float | None = None, clockwise: bool = True, radius: float | None = None, sort: list[Column | str] | None = None, spacing: float = 0.0) -> DataFrame:
    """On a circle from ``start``; ``spacing`` is the least distance of neighbours (0: what the box gives)."""
    placed, n = _placed(c, sort)
    sweep = (2 * math.pi - 2 * math.pi / max(1, n)) if sweep is None else sweep
    step = sweep / max(1, n - 1)
    r = radius if radius is not None else min(box[2], box[3]) / 2 - spacing if n > 1 else 0.0
    if n > 1 and spacing:
        dx, dy = math.cos(step) - 1, math.sin(step)
        r = max(r, math.sqrt(spacing * spacing / (dx * dx + dy * dy)))
    theta = F.lit(start) + F.col("__i") * (step if clockwise else -step)
    return placed.select("id", (F.lit(box[0] + box[2] / 2) + r * F.cos(theta)).alias("x"), (F.lit(box[1] + box[3] / 2) + r * F.sin(theta)).alias("y"))


@layout("concentric")
def concentric(c: Collection, value: Column | None = None, width: float | None = None, box: Box = (0, 0, 1000, 1000), spacing: float = 10.0, start: float = 1.5 * math.pi, equidistant: bool = False, clockwise: bool = True) -> DataFrame:
    """Rings of falling ``value`` (default: degree): a new ring begins when the value is ``width`` (default: a quarter of
    the largest degree) away from its ring's first; nodes without a value count as lowest.  ``equidistant`` rings lie as far
    apart as the outermost would be from the middle.  The distinct values pass by the driver in
    order, which keeps the rings only; places in the rings follow from ranks."""
    from graphloom.operators.aggregate import degrees

    d = degrees(c)
    rows = c.nodes.join(c.graph.parents(), "id", "left_anti").join(d.select("id", "degree"), "id")
    rows = rows.withColumn("__v", F.coalesce(F.col("degree").cast("double") if value is None else F.nanvl(value.cast("double"), F.lit(None)), F.lit(-math.inf)))
    rows = cut(rows)
    wide = width if width is not None else (rows.agg(F.max("degree")).first()[0] or 0) / 4
    values = rows.groupBy("__v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("__v").desc())
    firsts, counts = array("d"), array("q")
    for v, n in values.toLocalIterator():
        if not firsts or (v != firsts[-1] and abs(firsts[-1] - v) >= wide):
            firsts.append(v)
            counts.append(0)
        counts[-1] += n
    size = float(c.nodes.agg(F.max("width")).first()[0] or 1) if "width" in c.nodes.columns else 1.0
    least, r, steps, radii = size + spacing, 0.0, array("d"), array("d")
    for n in counts:
        sweep = 2 * math.pi - 2 * math.pi / n
        step = sweep / max(1, n - 1)
        if n > 1:
            dx, dy = math.cos(step) - 1, math.sin(step)
            r = max(r, math.sqrt(least * least / (dx * dx + dy * dy)))
        steps.append(step)
        radii.append(r)
        r += least
    if equidistant and radii:
        radii = array("d", [radii[0] + max(radii) * i for i in range(len(radii))])
    heads, before = -np.array(firsts), np.cumsum([0, *counts])[:-1]
    by_ring = np.array(steps), np.array(radii), before

    @F.pandas_udf("ring int, step double, r double, __f long")
    def ring_of(v: pd.Series) -> pd.DataFrame:
        i = np.searchsorted(heads, -v.to_numpy(), side="right") - 1
        return pd.DataFrame({"ring": i.astype("int32"), **dict(zip(("step", "r", "__f"), (x[i] for x in by_ring)))})

    placed = cut(rows.withColumn("__r", ring_of("__v"))).select("*", "__r.*").drop("__r")
    placed = global_index(placed, ["ring", F.col("__v").desc(), "ord"], "__i")
    theta = F.lit(start) + (F.col("__i") - F.col("__f")) * F.col("step") * (1 if clockwise else -1)
    return placed.select("id", (F.lit(box[0] + box[2] / 2) + F.col("r") * F.cos(theta)).alias("x"), (F.lit(box[1] + box[3] / 2) + F.col("r") * F.sin(theta)).alias("y"), "ring")


@layout("breadthfirst")
def breadthfirst(c: Collection, roots: DataFrame | None = None, directed: bool = False, box: Box = (0, 0, 1000, 1000), circular: bool = False) -> DataFrame:
    """Layers by depth from the roots (default: of a directed layout nodes without incoming edges, else the
    nodes of largest degree of each component); in a layer, nodes stand by their parents' places, then by
    id.  Nodes that no root reaches stand in the last layer."""
    from graphloom.operators.aggregate import degrees
    from graphloom.operators.paths import bfs, components
    from graphloom.operators.traverse import roots as sources

    if roots is None and directed:
        roots = sources(c).nodes.select("id")
    if roots is None or (directed and roots.isEmpty()):
        d = components(c).join(degrees(c).select("id", "degree"), "id")
        most = d.groupBy("component").agg(F.max("degree").alias("degree"))
        roots = d.join(most, ["component", "degree"]).select("id")
    found = bfs(c, roots, directed=directed)
    deepest = found.agg(F.max("depth")).first()[0] or 0
    rows = cut(c.nodes.join(c.graph.parents(), "id", "left_anti").join(found, "id", "left").select("id", "ord", "pred", F.coalesce("depth", F.lit(deepest)).alias("depth")))
    layers = deepest + 1
    share, done = rows.where("depth = 0").select("id", F.lit(0.5).alias("p")), None
    for k in range(layers):
        layer = rows.where(F.col("depth") == k)
        if k:
            layer = layer.join(share.withColumnsRenamed({"id": "pred", "p": "pp"}), "pred", "left")
        placed = cut(global_index(layer.withColumn("__p", F.coalesce("pp", F.lit(0.5)) if k else F.lit(0.5)), ["__p", "id"], "__i"))
        n = placed.count()
        share = placed.select("id", ((F.col("__i") + 1) / (n + 1)).alias("p"))
        out = placed.select("id", F.lit(k).alias("depth"), F.col("__i"), F.lit(n).alias("n"))
        done = out if done is None else done.unionByName(out)
    if circular:
        unit = min(box[2], box[3]) / 2 / max(1, layers)
        theta = 2 * math.pi * F.col("__i") / F.col("n") - math.pi / 2
        r = unit * (F.col("depth") + (0 if rows.where("depth = 0").count() <= 1 else 1))
        return done.select("id", (box[0] + box[2] / 2 + r * F.cos(theta)).alias("x"), (box[1] + box[3] / 2 + r * F.sin(theta)).alias("y"), "depth")
    return done.select("id", (box[0] + (F.col("__i") + 1) * box[2] / (F.col("n") + 1)).alias("x"), (box[1] + (F.col("depth") + 1) * box[3] / (layers + 1)).alias("y"), "depth")


@layout("cose")
def cose(c: Collection, seed: int = 1, iterations: int = 1000, repulsion: float = 2048.0, ideal: float | Column = 32.0, elasticity: float = 32.0, gravity: float = 1.0, temperature: float = 1000.0, cooling: float = 0.99, minimum: float = 1.0, gap: float = 40.0) -> DataFrame:
    """Force-directed, one kernel for each component: repulsion, edge springs and gravity under a falling
    temperature; the components are then packed in rows.  ``ideal`` lengths may be a column of edges.  Random starts come
    from the seed.  A kernel works on ``PUSHED`` rows of pairs at a time; components of over 20,000 elements raise."""
    from graphloom.operators.kernels import by_component

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows.loc[rows["kind"] == "n", "id"].tolist()
        place = {v: i for i, v in enumerate(ids)}
        e = rows.loc[rows["kind"] == "e"]
        s, t = e["source"].map(place).to_numpy(int), e["target"].map(place).to_numpy(int)
        rest = e["w"].to_numpy(float)[s != t]
        s, t = s[s != t], t[s != t]
        n = len(ids)
        p = np.random.default_rng([seed, n]).uniform(0, 40 * math.sqrt(n), (n, 2))
        heat = temperature
        for _ in range(iterations):
            force = np.empty((n, 2))
            for lo in range(0, n, PUSHED):
                part = p[lo : lo + PUSHED]
                d = part[:, None, :] - p[None, :, :]
                far = np.maximum((d * d).sum(axis=2), 1e-2)
                far[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
                force[lo : lo + PUSHED] = (d / far[:, :, None] ** 1.5 * repulsion * 100).sum(axis=1)
            if len(s):
                v = p[t] - p[s]
                length = np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-9)
                pull = v / length[:, None] * (np.sign(length - rest) * (length - rest) ** 2 / elasticity)[:, None]
                np.add.at(force, s, pull)
                np.add.at(force, t, -pull)
            away = p.mean(axis=0) - p
            dist = np.sqrt((away * away).sum(axis=1))
            force += np.where(dist[:, None] > 1, away / np.maximum(dist, 1e-9)[:, None] * gravity, 0)
            size = np.maximum(np.sqrt((force * force).sum(axis=1)), 1e-9)
            p = p + force / size[:, None] * np.minimum(size, heat)[:, None]
            heat *= cooling
            if heat < minimum:
                break
        p = p - p.min(axis=0)
        return pd.DataFrame({"component": rows["component"].iloc[0], "id": ids, "x": p[:, 0], "y": p[:, 1]})

    placed = cut(by_component(c, kernel, "component string, id string, x double, y double", weight=ideal if isinstance(ideal, Column) else F.lit(float(ideal)), max_rows=20_000))
    boxes = placed.groupBy("component").agg((F.max("x") + gap).alias("w"), (F.max("y") + gap).alias("h"))
    side = math.sqrt(boxes.agg(F.sum(F.col("w") * F.col("h"))).first()[0] or 1.0)
    # components in a row by falling size until it is as wide as the square of the same area
    wide = cut(global_index(boxes, [F.col("w").desc(), "component"], "__i"))
    per_row = max(1, int(side // (wide.agg(F.max("w")).first()[0] or 1.0)))
    row, col = F.floor(F.col("__i") / per_row), F.col("__i") % per_row
    cell = wide.agg(F.max("w").alias("cw"), F.max("h").alias("ch"))
    offset = wide.join(F.broadcast(cell)).select("component", (col * F.col("cw")).alias("ox"), (row * F.col("ch")).alias("oy"))  # one row
    return placed.join(offset, "component").select("id", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"))


