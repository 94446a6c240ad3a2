"""Stylesheets as ordered conditional projections.

A sheet is a list of rules ``(selector, {property: value})``; of the rules that match an element the
later wins for each property.  All rules become one projection: a rule of plain checks is a
condition on the element's own row, one with relations is a mark from a semi-join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import colors
from graphloom.graph import Graph
from graphloom.plans import selector as sel

# Defaults of properties - of text, of bodies and their borders, of compound nodes, of lines and arrows -, and the default sheet.
DEFAULTS: dict[str, Any] = {
    "events": "yes", "text-events": "no", "display": "element", "visibility": "visible", "opacity": 1.0, "z-index": 0, "z-compound-depth": "auto", "z-index-compare": "auto", "box-selection": "contain",
    "label": "", "color": "#000", "font-family": "Helvetica Neue, Helvetica, sans-serif", "font-style": "normal", "font-weight": "normal", "font-size": 16, "min-zoomed-font-size": 0, "line-height": 1, "text-valign": "top", "text-halign": "center",
    "text-justification": "auto", "text-opacity": 1, "text-transform": "none", "text-wrap": "none", "text-max-width": 9999, "text-rotation": "none", "text-margin-x": 0, "text-margin-y": 0, "text-outline-color": "#000", "text-outline-width": 0,
    "text-outline-opacity": 1, "text-background-color": "#000", "text-background-opacity": 0, "text-background-shape": "rectangle", "text-background-padding": 0, "text-border-color": "#000", "text-border-width": 0, "text-border-opacity": 0, "text-border-style": "solid",
    "source-label": "", "target-label": "", "source-text-offset": 0, "target-text-offset": 0,
    "overlay-color": "#000", "overlay-opacity": 0, "overlay-padding": 10, "overlay-shape": "round-rectangle", "underlay-color": "#000", "underlay-opacity": 0, "underlay-padding": 10, "underlay-shape": "round-rectangle",
    "shape": "ellipse", "width": 30.0, "height": 30.0, "bounds-expansion": 0, "background-color": "#999", "background-opacity": 1, "background-blacken": 0, "background-fill": "solid",
    "border-color": "#000", "border-opacity": 1, "border-width": 0.0, "border-style": "solid", "border-position": "center", "border-cap": "butt", "border-join": "miter", "outline-color": "#999", "outline-opacity": 1, "outline-width": 0, "outline-offset": 0, "outline-style": "solid",
    "ghost": "no", "ghost-offset-x": 0, "ghost-offset-y": 0, "ghost-opacity": 0,
    "padding": 0.0, "padding-relative-to": "width", "compound-sizing-wrt-labels": "include", "min-width": 0, "min-width-bias-left": 0, "min-width-bias-right": 0, "min-height": 0, "min-height-bias-top": 0, "min-height-bias-bottom": 0,
    "line-color": "#999", "line-style": "solid", "line-fill": "solid", "line-cap": "butt", "line-opacity": 1, "line-outline-width": 0, "line-outline-color": "#000", "line-dash-offset": 0, "curve-style": "haystack", "haystack-radius": 0, "arrow-scale": 1,
    "control-point-step-size": 40, "control-point-weights": 0.5, "segment-weights": 0.5, "segment-distances": 20, "segment-radii": 15, "taxi-radius": 15, "taxi-turn-min-distance": 10, "taxi-direction": "auto", "edge-distances": "intersection",
    "source-distance-from-node": 0, "target-distance-from-node": 0, "source-endpoint": "outside-to-node", "target-endpoint": "outside-to-node",
}
ARROWS = {"arrow-shape": "none", "arrow-color": "#999", "arrow-fill": "filled", "arrow-width": 1}
ENDS = ("source", "mid-source", "target", "mid-target")
EDGE_DEFAULTS: dict[str, Any] = {"width": 3.0}
DEFAULT_SHEET: list[tuple[str, dict[str, Any]]] = [
    (":parent", {"shape": "rectangle", "padding": 10.0, "background-color": "#eee", "border-color": "#ccc", "border-width": 1.0}),
    ("edge", {"width": 3.0}),
    (":loop", {"curve-style": "bezier"}),
    ("edge:compound", {"curve-style": "bezier", "source-endpoint": "outside-to-line", "target-endpoint": "outside-to-line"}),
    (":selected", {"background-color": "#0169D9", "line-color": "#0169D9", "source-arrow-color": "#0169D9", "target-arrow-color": "#0169D9", "mid-source-arrow-color": "#0169D9", "mid-target-arrow-color": "#0169D9"}),
    (":parent:selected", {"background-color": "#CCE1F9", "border-color": "#aec8e5"}),
    (":active", {"overlay-color": "black", "overlay-padding": 10, "overlay-opacity": 0.25}),
]
# Enumerated properties and their values.
ENUMS = {
    "display": ("none", "element"),
    "visibility": ("hidden", "visible"),
    "events": ("yes", "no"),
    "text-events": ("yes", "no"),
    "ghost": ("yes", "no"),
    "box-selection": ("contain", "overlap", "none"),
    "shape": ("ellipse", "rectangle", "round-rectangle", "triangle", "diamond", "pentagon", "hexagon", "octagon", "star", "vee"),
    "curve-style": ("bezier", "unbundled-bezier", "haystack", "segments", "straight", "taxi", "round-segments", "round-taxi"),
    "text-valign": ("top", "center", "bottom"),
    "text-halign": ("left", "center", "right"),
    "text-justification": ("left", "center", "right", "auto"),
    "text-transform": ("none", "uppercase", "lowercase"),
    "text-wrap": ("none", "wrap", "ellipsis"),
    "font-style": ("italic", "normal", "oblique"),
    "z-compound-depth": ("bottom", "orphan", "auto", "top"),
    "z-index-compare": ("auto", "manual"),
    "border-style": ("solid", "dotted", "dashed", "double"),
    "border-position": ("center", "inside", "outside"),
    "border-cap": ("butt", "round", "square"),
    "border-join": ("round", "bevel", "miter"),
    "outline-style": ("solid", "dotted", "dashed", "double"),
    "line-style": ("solid", "dotted", "dashed"),
    "line-cap": ("butt", "round", "square"),
    "padding-relative-to": ("width", "height", "average", "min", "max"),
    "compound-sizing-wrt-labels": ("include", "exclude"),
    "overlay-shape": ("rectangle", "roundrectangle", "round-rectangle", "ellipse"),
    "underlay-shape": ("rectangle", "roundrectangle", "round-rectangle", "ellipse"),
}
UNITS = {"": 1.0, "px": 1.0, "em": 16.0, "deg": 3.141592653589793 / 180, "rad": 1.0, "s": 1000.0, "ms": 1.0}
SIGNED = ("z-index", "background-blacken", "text-margin-x", "text-margin-y", "ghost-offset-x", "ghost-offset-y", "outline-offset", "line-dash-offset", "segment-distances", "bounds-expansion", "source-distance-from-node", "target-distance-from-node", "control-point-weights", "segment-weights")
DEFAULTS |= {f"{end}-{name}": value for end in ENDS for name, value in ARROWS.items()}
#: Least and largest value of numbers: shares from 0 to 1, some with a sign, the others at least 0.
NUMBERS = {name: (0.0, 1.0) if name.endswith("opacity") or name == "haystack-radius" else (-1.0, 1.0) if name == "background-blacken" else (None, None) if name in SIGNED else (0.0, None) for name, value in DEFAULTS.items() if isinstance(value, (int, float))}


class StyleError(ValueError):
    pass


@dataclass(frozen=True)
class Data:
    """``data(field)``: the field's value; undefined values leave what earlier rules gave."""

    name: str

    def column(self, df: DataFrame) -> Column | None:
        found = sel.field(df, self.name)
        return found[0].cast("string") if found else None


@dataclass(frozen=True)
class MapData:
    """``mapData(field, a, b, x, y)``: linear from [a, b] to [x, y], clamped; colours by channel."""

    name: str
    a: float
    b: float
    x: Any
    y: Any

    def column(self, df: DataFrame) -> Column | None:
        found = sel.field(df, self.name)
        if not found:
            return None
        v = sel._as_number(*found)
        share = F.least(F.greatest((v - self.a) / (self.b - self.a), F.lit(0.0)), F.lit(1.0)) if self.a != self.b else F.when(v.isNotNull(), 0.0)
        if isinstance(self.x, str):
            lo, hi = colors.parse(self.x), colors.parse(self.y)
            channels = [F.floor(share * (q - p) + p + 0.5).cast("int").cast("string") for p, q in zip(lo[:3], hi[:3], strict=True)]
            return F.concat(F.lit("rgb("), F.concat_ws(",", *channels), F.lit(")"))
        return (share * (self.y - self.x) + self.x).cast("string")


@dataclass
class Sheet:
    rules: list[tuple[str, dict[str, Any]]] = field(default_factory=list)

    def rule(self, selector: str, **props: Any) -> Sheet:
        return Sheet([*self.rules, (selector, {k.replace("_", "-"): v for k, v in props.items()})])

    @classmethod
    def from_json(cls, records: list[dict]) -> Sheet:
        return cls([(r["selector"], dict(r.get("style") or r.get("css") or {})) for r in records])

    @classmethod
    def from_text(cls, text: str) -> Sheet:
        """``selector { name: value; ... }`` blocks, with ``/* comments */``."""
        text = re.sub(r"/\*.*?\*/", "", text, flags=re.S).strip()
        rules, at = [], 0
        block = re.compile(r"\s*([^{}]+?)\s*\{([^{}]*)\}\s*")
        while at < len(text):
            m = block.match(text, at)
            if not m:
                raise StyleError(f"cannot read the sheet at {text[at:at + 40]!r}")
            props = {}
            for part in filter(None, (p.strip() for p in m[2].split(";"))):
                name, _, value = part.partition(":")
                if not value:
                    raise StyleError(f"cannot read the property {part!r}")
                props[name.strip()] = value.strip()
            rules.append((m[1], props))
            at = m.end()
        return cls(rules)

    def to_json(self) -> list[dict]:
        return [{"selector": s, "style": dict(p)} for s, p in self.rules]


def parse_value(name: str, value: Any) -> Any:
    """A literal in canonical form, a mapper, or None if it isn't valid for the property."""
    if isinstance(value, (Data, MapData, Column)) or callable(value):
        return value
    if isinstance(value, str):
        if m := re.fullmatch(r"\s*data\(\s*([\w.]+)\s*\)\s*", value):
            return Data(m[1])
        if m := re.fullmatch(r"\s*mapData\(\s*([\w.]+)\s*,\s*([-\d.e]+)\s*,\s*([-\d.e]+)\s*,\s*(.+?)\s*,\s*([^,()]+|\w+\([^)]*\))\s*\)\s*", value):
            ends = [parse_value(name, v) if name in NUMBERS else v for v in (m[4], m[5])]
            return MapData(m[1], float(m[2]), float(m[3]), *ends) if None not in ends else None
    if name in ENUMS:
        return value if value in ENUMS[name] else None
    if name in NUMBERS:
        if isinstance(value, str):
            m = re.fullmatch(r"\s*([+-]?[\d.]+(?:e[+-]?\d+)?)\s*([a-z]*)\s*", value)
            if not m or m[2] not in UNITS:
                return None
            value = float(m[1]) * UNITS[m[2]]
        lo, hi = NUMBERS[name]
        ok = isinstance(value, (int, float)) and (lo is None or value >= lo) and (hi is None or value <= hi)
        return float(value) if ok else None
    if name.endswith("color"):
        parsed = colors.parse(value) if isinstance(value, str) else None
        return None if parsed is None else f"rgb({','.join(str(int(v)) for v in parsed[:3])})"
    return None if value is None else str(value)


def cascade(graph: Graph, sheet: Sheet, properties: list[str], bypass: bool = True) -> DataFrame:
    """``id, grp`` and one text column for each property (dashes become underscores): bypass,
    then the last matching rule whose value applies, then the default."""

    def on(df: DataFrame, edges: bool) -> DataFrame:
        conditions, base = [], df
        for i, (text, _) in enumerate(sheet.rules):
            plain = _plain_condition(df, text, edges)
            if plain is None:
                hit = graph.elements(text)
                ids = (hit.edges if edges else hit.nodes).select("id").distinct()
                base = base.join(ids.withColumn(f"__r{i}", F.lit(True)), "id", "left")
                plain = F.coalesce(f"__r{i}", F.lit(False))
            conditions.append(plain)
        out = []
        for p in properties:
            options = []
            if bypass and "style" in df.columns:
                options.append(F.try_element_at("style", F.lit(p)))
            for condition, (_, props) in reversed(list(zip(conditions, sheet.rules, strict=True))):
                if p in props:
                    value = parse_value(p, props[p])
                    col = value.column(df) if isinstance(value, (Data, MapData)) else value(df) if callable(value) and not isinstance(value, Column) else value.cast("string") if isinstance(value, Column) else None if value is None else F.lit(_text(value))
                    if col is not None:
                        options.append(F.when(condition, col.cast("string")))
            default = (EDGE_DEFAULTS if edges else {}).get(p, DEFAULTS.get(p))
            options.append(F.lit(None if default is None else _text(parse_value(p, default))).cast("string"))
            out.append(F.coalesce(*options).alias(p.replace("-", "_")))
        return base.select("id", F.lit("edges" if edges else "nodes").alias("grp"), *out)

    return on(graph.nodes, False).unionByName(on(graph.edges, True))


def _text(value: Any) -> str:
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def _plain_condition(df: DataFrame, text: str, edges: bool) -> Column | None:
    """The rule as a condition on the row itself, if it needs no join."""
    options = []
    for q in sel.parse(text):
        if q.relations or any(c.kind in ("state", "meta") for c in q.terms[0].checks):
            return None
        tests = [F.lit(True)]
        for c in q.terms[0].checks:
            if c.kind == "group":
                tests.append(F.lit(c.name == "*" or (c.name == "edge") == edges))
            elif c.kind == "id":
                tests.append(F.col("id") == c.name)
            elif c.kind == "class":
                tests.append(F.array_contains("classes", c.name))
            elif c.kind == "data":
                tests.append(sel.compare(sel.field(df, c.name), c.op, c.value))
            else:
                found = sel.field(df, c.name)
                there = found[0].isNotNull() if found else F.lit(False)
                true = sel.truthy(*found) if found else F.lit(False)
                tests.append({"exist": there, "undefined": ~there, "truthy": true, "falsy": ~true}[c.kind])
        both = tests[0]
        for t in tests[1:]:
            both = both & t
        options.append(both)
    out = options[0]
    for o in options[1:]:
        out = out | o
    return out


def bypass(graph: Graph, selector: str, values: dict[str, Any]) -> Graph:
    """Sets style values on the elements themselves; None removes one."""
    def on(df: DataFrame, ids: DataFrame) -> DataFrame:
        if "style" not in df.columns:
            df = df.withColumn("style", F.create_map().cast("map<string,string>"))
        new = F.create_map(*[x for k, v in values.items() if v is not None for x in (F.lit(k), F.lit(_text(parse_value(k, v))))]).cast("map<string,string>")
        kept = F.map_filter("style", lambda k, v: ~k.isin(list(values)))
        marked = df.join(ids.distinct().withColumn("__m", F.lit(True)), "id", "left")
        return marked.withColumn("style", F.when(F.col("__m"), F.map_concat(kept, new)).otherwise(F.col("style"))).drop("__m")

    hit = graph.elements(selector)
    return graph.with_(nodes=on(graph.nodes, hit.nodes.select("id")), edges=on(graph.edges, hit.edges.select("id")))


def _own(df: DataFrame) -> DataFrame:
    """``id, takes, shown, opacity`` of the element's own style columns or bypass."""
    has_style = "style" in df.columns

    def read(name: str, default: str) -> Column:
        own = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(F.try_element_at("style", F.lit(name)) if has_style else F.lit(None).cast("string"), own, F.lit(default))

    size = (read("width", "1").try_cast("double") > 0) & (read("height", "1").try_cast("double") > 0) if has_style else F.lit(True)
    return df.select("*", ((read("display", "element") == "element") & F.coalesce(size, F.lit(True))).alias("__takes"), ((read("visibility", "visible") == "visible") & (read("opacity", "1").cast("double") != 0)).alias("__shown"), read("opacity", "1").cast("double").alias("__opacity"))


def visibility(graph: Graph) -> DataFrame:
    """``id, takes_up_space, visible, effective_opacity, transparent`` of all elements.

    A node is visible if it and all its ancestors are; an edge if it is and both of its ends take up
    space with theirs.  The effective opacity is the product up the hierarchy."""
    nodes = _own(graph.nodes).select("id", "__takes", "__shown", "__opacity")
    above = graph.closure().join(nodes.withColumnRenamed("id", "ancestor"), "ancestor")
    above = above.groupBy("id").agg(F.min("__takes").alias("t"), F.min("__shown").alias("s"), F.product("__opacity").alias("o"))
    n = nodes.join(above, "id", "left").select("id", (F.col("__takes") & F.coalesce("t", F.lit(True))).alias("takes_up_space"), (F.col("__takes") & F.col("__shown") & F.coalesce("t", F.lit(True)) & F.coalesce("s", F.lit(True))).alias("visible"), (F.col("__opacity") * F.coalesce("o", F.lit(1.0))).alias("effective_opacity"))
    ends = n.select("id", "takes_up_space")
    e = _own(graph.edges).join(ends.select(F.col("id").alias("source"), F.col("takes_up_space").alias("a")), "source").join(ends.select(F.col("id").alias("target"), F.col("takes_up_space").alias("b")), "target")
    takes = F.col("__takes") & F.col("a") & F.col("b")
    e = e.select("id", takes.alias("takes_up_space"), (takes & F.col("__shown")).alias("visible"), F.col("__opacity").alias("effective_opacity"))
    return n.unionByName(e).withColumn("transparent", F.col("effective_opacity") == 0)
