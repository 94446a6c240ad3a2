"""Boxes, spatial queries and viewport arithmetic.

Node bodies are boxes of ``width`` by ``height`` (1 by 1 without style) around ``x, y``; edges are
straight.  Element boxes grow by 1 on each side, as the bounding box of a drawing does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Collection, Graph
from graphloom.operators.iterate import cut


def _size(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("double"), F.lit(1.0)) if name in df.columns else F.lit(1.0)


def outer_size(dim: Column, border: Column, padding: Column, position: str = "center") -> Column:
    """Width or height with border and padding."""
    return dim + border * {"center": 1, "outside": 2, "inside": 0}[position] + 2 * padding


def node_boxes(c: Collection) -> DataFrame:
    """``id, x1, y1, x2, y2`` of node bodies, without margin."""
    w, h = _size(c.nodes, "width"), _size(c.nodes, "height")
    return c.nodes.select("id", (F.col("x") - w / 2).alias("x1"), (F.col("y") - h / 2).alias("y1"), (F.col("x") + w / 2).alias("x2"), (F.col("y") + h / 2).alias("y2"))


def edge_ends(c: Collection) -> DataFrame:
    """``id, sx, sy, tx, ty`` of straight edges."""
    p = c.graph.nodes.select("id", "x", "y")
    s = p.withColumnsRenamed({"id": "source", "x": "sx", "y": "sy"})
    t = p.withColumnsRenamed({"id": "target", "x": "tx", "y": "ty"})
    return c.edges.join(s, "source").join(t, "target").select("id", "sx", "sy", "tx", "ty", *(["width"] if "width" in c.edges.columns else []))


def midpoints(c: Collection) -> DataFrame:
    return edge_ends(c).select("id", ((F.col("sx") + F.col("tx")) / 2).alias("x"), ((F.col("sy") + F.col("ty")) / 2).alias("y"))


def element_boxes(c: Collection, nodes: bool = True, edges: bool = True) -> DataFrame:
    """Boxes of all elements, grown by 1; boxes without area are left out."""
    parts = []
    if nodes:
        parts.append(node_boxes(c))
    if edges:
        e = edge_ends(c)
        half = _size(e, "width") / 2
        parts.append(e.select("id", (F.least("sx", "tx") - half).alias("x1"), (F.least("sy", "ty") - half).alias("y1"), (F.greatest("sx", "tx") + half).alias("x2"), (F.greatest("sy", "ty") + half).alias("y2")))
    boxes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return boxes.where("x2 > x1 and y2 > y1").select("id", *[(F.col(k) + d).alias(k) for k, d in (("x1", -1), ("y1", -1), ("x2", 1), ("y2", 1))])


def bounding_box(c: Collection, nodes: bool = True, edges: bool = True) -> DataFrame:
    """One row ``x1, y1, x2, y2, w, h``; zeros for nothing."""
    b = element_boxes(c, nodes, edges).agg(*[F.coalesce(f(k), F.lit(0.0)).alias(k) for k, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))])
    return b.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})


def rendered(box: DataFrame, zoom: float, pan: tuple[float, float]) -> DataFrame:
    """A box on the screen."""
    out = box.withColumns({"x1": F.col("x1") * zoom + pan[0], "x2": F.col("x2") * zoom + pan[0], "y1": F.col("y1") * zoom + pan[1], "y2": F.col("y2") * zoom + pan[1]})
    return out.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})


def bounding_box_at(c: Collection, x: Column, y: Column) -> DataFrame:
    """The box if the nodes stood at other places."""
    nodes = c.nodes.withColumns({"x": x, "y": y})
    return bounding_box(Collection(c.graph.with_(nodes=nodes), nodes, c.edges))


def relative_padding(w: Column, h: Column, padding: float | str, relative_to: str = "width") -> Column:
    """Padding in pixels, or, as text like ``10%``, of the width, the height, or their average, least or largest; a part of
    no size gives none."""
    if not isinstance(padding, str):
        return F.lit(float(padding))
    share = float(padding.rstrip("%")) / 100
    of = {"width": w, "height": h, "average": (w + h) / 2, "min": F.least(w, h), "max": F.greatest(w, h)}[relative_to]
    there = w > 0 if relative_to == "width" else h > 0 if relative_to == "height" else (w > 0) & (h > 0)
    return F.when(there, of * share).otherwise(0.0)


def _shift(size: Column, least: float, before: float, after: float) -> Column:
    """How far the middle moves when a side grows to its minimum, by the shares that lie before and behind."""
    if before + after <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(float(least)) - size, F.lit(0.0)) * ((after - before) / (before + after) / 2)


def compound_bounds(g: Graph, padding: float | str = 0.0, min_width: float = 0.0, min_height: float = 0.0, relative_to: str = "width", bias: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """``id, x, y, w, h`` of all nodes: a parent covers its children's boxes plus padding (see ``relative_padding``), at least the
    minimum; its place is the middle of the children's box, moved where a minimum takes more room on one side
    (``bias``: left, right, top, bottom).  Level by level from the deepest parents up."""
    w, h = _size(g.nodes, "width"), _size(g.nodes, "height")
    depth = g.closure().groupBy("id").agg(F.max("depth").alias("depth"))
    base = cut(g.nodes.join(depth, "id", "left").select("id", "parent", F.coalesce("depth", F.lit(0)).alias("depth"), "x", "y", w.alias("w"), h.alias("h")))
    deepest = base.agg(F.max("depth")).first()[0] or 0
    for d in range(deepest, 0, -1):
        kids = base.where(F.col("depth") == d).groupBy("parent").agg(F.min(F.col("x") - F.col("w") / 2).alias("x1"), F.max(F.col("x") + F.col("w") / 2).alias("x2"), F.min(F.col("y") - F.col("h") / 2).alias("y1"), F.max(F.col("y") + F.col("h") / 2).alias("y2"))
        kids = kids.where("x2 > x1 and y2 > y1").withColumnRenamed("parent", "id")
        grown = base.join(kids, "id", "left")
        has, kw, kh = F.col("x1").isNotNull(), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        pad = relative_padding(kw, kh, padding, relative_to)
        new = {
            "x": (F.col("x1") + F.col("x2")) / 2 + _shift(kw, min_width, *bias[:2]),
            "y": (F.col("y1") + F.col("y2")) / 2 + _shift(kh, min_height, *bias[2:]),
            "w": F.greatest(kw, F.lit(float(min_width))) + 2 * pad,
            "h": F.greatest(kh, F.lit(float(min_height))) + 2 * pad,
        }
        base = cut(grown.select("id", "parent", "depth", *[F.when(has, v).otherwise(F.col(k)).alias(k) for k, v in new.items()]))
    return base.select("id", "x", "y", "w", "h")


# box algebra on columns


def boxes_intersect(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed intervals on both axes."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def box_in_box(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Is b inside a?"""
    return (b["x1"] >= a["x1"]) & (b["x2"] <= a["x2"]) & (b["y1"] >= a["y1"]) & (b["y2"] <= a["y2"])


def sides(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x1", "y1", "x2", "y2")}


def expand(box: dict[str, Column], top: float, right: float, bottom: float, left: float) -> dict[str, Column]:
    return {"x1": box["x1"] - left, "y1": box["y1"] - top, "x2": box["x2"] + right, "y2": box["y2"] + bottom}


def in_box(c: Collection, x1: float, y1: float, x2: float, y2: float, mode: str = "overlap") -> DataFrame:
    """``id`` of nodes whose bodies overlap a box, or are contained in it; the corners may be swapped."""
    box = {"x1": F.lit(float(min(x1, x2))), "y1": F.lit(float(min(y1, y2))), "x2": F.lit(float(max(x1, x2))), "y2": F.lit(float(max(y1, y2)))}
    test = boxes_intersect(box, sides()) if mode == "overlap" else box_in_box(box, sides()) if mode == "contain" else F.lit(False)
    return node_boxes(c).where(test).select("id")


def select_in_box(c: Collection, x1: float, y1: float, x2: float, y2: float, mode: Callable[[DataFrame], Column] | str = "contain") -> DataFrame:
    """``id, grp`` of nodes and edges that a box selects, each by its own mode - ``contain``, ``overlap`` or ``none`` -, which a
    function gives as a column of nodes or edges.  A node counts with its body grown by 1; an edge is contained if both ends are inside and overlaps if
    one is or it crosses a side."""
    box = {"x1": F.lit(float(min(x1, x2))), "y1": F.lit(float(min(y1, y2))), "x2": F.lit(float(max(x1, x2))), "y2": F.lit(float(max(y1, y2)))}
    own = lambda df: df.select("id", (mode(df) if callable(mode) else F.lit(mode)).alias("mode"))
    chosen = lambda contain, overlap: F.when(F.col("mode") == "contain", contain).when(F.col("mode") == "overlap", overlap).otherwise(False)
    bodies = element_boxes(c, edges=False).join(own(c.nodes), "id")
    nodes = bodies.where(chosen(box_in_box(box, sides()), boxes_intersect(box, sides())))
    inside = lambda x, y: F.col(x).between(box["x1"], box["x2"]) & F.col(y).between(box["y1"], box["y2"])
    s, t = inside("sx", "sy"), inside("tx", "ty")
    line = [F.col(k) for k in ("sx", "sy", "tx", "ty")]
    corners = [(box["x1"], box["y1"]), (box["x2"], box["y1"]), (box["x2"], box["y2"]), (box["x1"], box["y2"])]
    crosses = F.lit(False)
    for p, q in zip(corners, [*corners[1:], corners[0]], strict=True):
        crosses = crosses | segments_cross(line, [*p, *q])
    edges = edge_ends(c).join(own(c.edges), "id").where(chosen(s & t, s | t | crosses))
    return nodes.select("id", F.lit("nodes").alias("grp")).unionByName(edges.select("id", F.lit("edges").alias("grp")))


def in_boxes(c: Collection, boxes: DataFrame, cell: float, mode: str = "overlap") -> DataFrame:
    """``box, id``: the same for a table of boxes (``box, x1, y1, x2, y2``), as a range join over grid cells: a node
    goes to the cells that it covers, so does a box, and only those that share a cell are compared; the pair is
    taken in the cell of the corner of their overlap, so it comes once."""
    def cells(df: DataFrame) -> DataFrame:
        axis = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
        return df.withColumn("cx", F.explode(axis("x1", "x2"))).withColumn("cy", F.explode(axis("y1", "y2")))

    b = cells(boxes).withColumnsRenamed({k: f"b_{k}" for k in ("x1", "y1", "x2", "y2")})
    joined = cells(node_boxes(c)).join(b, ["cx", "cy"])
    test = boxes_intersect(sides("b_"), sides()) if mode == "overlap" else box_in_box(sides("b_"), sides())
    own = (F.floor(F.greatest("x1", "b_x1") / cell) == F.col("cx")) & (F.floor(F.greatest("y1", "b_y1") / cell) == F.col("cy"))
    return joined.where(test & own).select("box", "id")


def nearest(c: Collection, x: float, y: float, threshold: float = 8.0, zoom: float = 1.0) -> DataFrame:
    """At most one row each of ``kind, id``: the top-most node (largest ``ord``) whose body holds the point, and
    the edge nearest to it within threshold / zoom."""
    px, py = F.lit(float(x)), F.lit(float(y))
    n = node_boxes(c).join(c.nodes.select("id", "ord"), "id").where((F.col("x1") <= px) & (px <= F.col("x2")) & (F.col("y1") <= py) & (py <= F.col("y2")))
    n = n.orderBy(F.col("ord").desc()).limit(1).select(F.lit("node").alias("kind"), "id")
    d = segment_sqdist(px, py, F.col("sx"), F.col("sy"), F.col("tx"), F.col("ty"))
    e = edge_ends(c).withColumn("d", d).where(F.col("d") <= (threshold / zoom) ** 2).orderBy("d", "id").limit(1).select(F.lit("edge").alias("kind"), "id")
    return n.union(e)


# points and segments


def sqdist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def segment_sqdist(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment."""
    length = sqdist(ax, ay, bx, by)
    t = F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), length), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return sqdist(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def segments_cross(a: list[Column], b: list[Column]) -> Column:
    """Do two segments [x1, y1, x2, y2] meet?  Parallel ones don't."""
    d = (b[3] - b[1]) * (a[2] - a[0]) - (b[2] - b[0]) * (a[3] - a[1])
    s = F.try_divide((b[2] - b[0]) * (a[1] - b[1]) - (b[3] - b[1]) * (a[0] - b[0]), d)
    t = F.try_divide((a[2] - a[0]) * (a[1] - b[1]) - (a[3] - a[1]) * (a[0] - b[0]), d)
    return F.coalesce((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), F.lit(False))


def in_ellipse(px: Column, py: Column, w: Column, h: Column, cx: Column, cy: Column, padding: float = 0.0) -> Column:
    rx, ry = w / 2 + padding, h / 2 + padding
    return ((px - cx) / rx) * ((px - cx) / rx) + ((py - cy) / ry) * ((py - cy) / ry) <= 1


def in_polygon(px: Column, py: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting against a constant polygon."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
            inside = inside != hit
    return inside


# viewport


def fit(g: Graph, width: float, height: float, padding: float = 0.0, lo: float = 1e-50, hi: float = 1e50) -> Graph:
    """Zoom and pan that show all elements in a window of that size."""
    b = bounding_box(g.elements()).first()
    if not b["w"] or not b["h"]:
        return g
    zoom = max(lo, min(hi, min((width - 2 * padding) / b["w"], (height - 2 * padding) / b["h"])))
    return g.with_(zoom=zoom, pan=((width - zoom * (b["x1"] + b["x2"])) / 2, (height - zoom * (b["y1"] + b["y2"])) / 2))


def center(g: Graph, width: float, height: float) -> Graph:
    b = bounding_box(g.elements()).first()
    return g.with_(pan=((width - g.zoom * (b["x1"] + b["x2"])) / 2, (height - g.zoom * (b["y1"] + b["y2"])) / 2))


def zoom_to(g: Graph, level: float, at: tuple[float, float] | None = None, lo: float = 1e-50, hi: float = 1e50) -> Graph:
    """A new zoom level; ``at`` (on the screen) stays where it is."""
    level = max(lo, min(hi, level))
    if at is None:
        return g.with_(zoom=level)
    return g.with_(zoom=level, pan=tuple(p - (p - q) * level / g.zoom for p, q in zip(at, g.pan, strict=True)))


def pan_by(g: Graph, dx: float, dy: float) -> Graph:
    return g.with_(pan=(g.pan[0] + dx, g.pan[1] + dy))


def extent(g: Graph, width: float, height: float) -> dict[str, float]:
    """The part of the model that a window shows."""
    x1, y1 = -g.pan[0] / g.zoom, -g.pan[1] / g.zoom
    return {"x1": x1, "y1": y1, "x2": x1 + width / g.zoom, "y2": y1 + height / g.zoom, "w": width / g.zoom, "h": height / g.zoom}
