"""Queries of style, geometry, layouts, scalar functions and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import colors
from graphloom.functions import values as kinds
from graphloom.graph import Graph
from graphloom.operators import geometry as geo
from graphloom.operators import layouts as lay
from graphloom.operators import style as sty
from graphloom.plans import graphs
from graphloom.plans.registry import query
from graphloom.streaming import events as ev

SHEET = sty.Sheet.from_text("""
    node { width: 20px; background-color: red; label: data(name) }
    .customer[acctbal > 5000] { width: mapData(acctbal, 5000, 10000, 20, 60); background-color: mapData(acctbal, 5000, 10000, #000000, rgb(255,255,255)) }
    :selected { opacity: 0.5 }
    #n3 > node { shape: star; opacity: 7 }
    edge { width: 2 } edge[weight > 40] { width: 4 }
""")


@query("y1_cascade", """, s AS (SELECT *, least(greatest((acctbal - 5000) / 5000, 0), 1) AS t FROM gn)
SELECT id, 'nodes' AS grp, CASE WHEN kind = 'customer' AND acctbal > 5000 THEN round(t * 40 + 20, 6) ELSE 20.0 END AS width, CASE WHEN selected THEN 0.5 ELSE 1.0 END AS opacity, CASE WHEN parent = 'n3' THEN 'star' ELSE 'ellipse' END AS shape FROM s
UNION ALL SELECT id, 'edges', CASE WHEN weight > 40 THEN 4.0 ELSE 2.0 END, 1.0, 'ellipse' FROM ge""", on="geo")
def y1(g: Graph) -> DataFrame:
    """Later rules win; invalid values (opacity 7) are left out."""
    r = sty.cascade(g, SHEET, ["width", "opacity", "shape"])
    return r.select("id", "grp", F.round(F.col("width").cast("double"), 6).alias("width"), F.col("opacity").cast("double").alias("opacity"), "shape")


@query("y2_defaults", "SELECT id, CASE WHEN id IN (SELECT parent FROM gn) THEN 'rectangle' ELSE 'ellipse' END AS shape, CASE WHEN id IN (SELECT parent FROM gn) THEN 10.0 ELSE 0.0 END AS padding FROM gn", on="geo")
def y2(g: Graph) -> DataFrame:
    r = sty.cascade(g, sty.Sheet(sty.DEFAULT_SHEET), ["shape", "padding"]).where("grp = 'nodes'")
    return r.select("id", "shape", F.col("padding").cast("double").alias("padding"))


@query("y2_all_defaults", "SELECT id, 0.0 AS outline, 1.0 AS line_opacity, 'contain' AS selection, 'rgb(0,0,0)' AS border, 'rgb(153,153,153)' AS arrow FROM gn", on="geo")
def y2_all(g: Graph) -> DataFrame:
    r = sty.cascade(g.with_(nodes=g.nodes.withColumn("parent", F.lit(None).cast("string"))), sty.Sheet(sty.DEFAULT_SHEET).rule(":selected", **{"target-arrow-color": "#999"}), ["outline-width", "line-opacity", "box-selection", "border-color", "target-arrow-color"]).where("grp = 'nodes'")
    return r.select("id", F.col("outline_width").cast("double").alias("outline"), F.col("line_opacity").cast("double").alias("line_opacity"), F.col("box_selection").alias("selection"), F.col("border_color").alias("border"), F.col("target_arrow_color").alias("arrow"))


@query("y3_data_mapper", "SELECT id, coalesce(name, '') AS label FROM gn", on="geo")
def y3(g: Graph) -> DataFrame:
    return sty.cascade(g, SHEET, ["label"]).where("grp = 'nodes'").select("id", "label")


@query("y4_map_data_color", """, s AS (SELECT id, kind, acctbal, floor(least(greatest((acctbal - 5000) / 5000, 0), 1) * 255 + 0.5)::INTEGER AS c FROM gn)
SELECT id, CASE WHEN kind = 'customer' AND acctbal > 5000 THEN 'rgb(' || c || ',' || c || ',' || c || ')' ELSE 'rgb(255,0,0)' END AS color FROM s""", on="geo")
def y4(g: Graph) -> DataFrame:
    return sty.cascade(g, SHEET, ["background-color"]).where("grp = 'nodes'").select("id", F.col("background_color").alias("color"))


@query("y5_function_mapper", "SELECT id, CASE WHEN kind = 'supplier' THEN length(name)::DOUBLE ELSE 30.0 END AS height FROM gn", on="geo")
def y5(g: Graph) -> DataFrame:
    r = sty.cascade(g, sty.Sheet().rule(".supplier", height=lambda df: F.length("name").cast("double") if "name" in df.columns else None), ["height"])
    return r.where("grp = 'nodes'").select("id", F.col("height").cast("double").alias("height"))


@query("y6_bypass", "SELECT id, CASE WHEN kind = 'supplier' THEN 99.0 ELSE 20.0 END AS width FROM gn WHERE kind <> 'customer'", on="geo")
def y6(g: Graph) -> DataFrame:
    g = sty.bypass(sty.bypass(g, "node", {"width": 5}), ".supplier", {"width": 99})
    g = sty.bypass(g, ".nation, .region, .customer", {"width": None})
    return sty.cascade(g, SHEET, ["width"]).where("grp = 'nodes'").join(g.nodes.where("kind <> 'customer'").select("id"), "id").select("id", F.col("width").cast("double").alias("width"))


@query("y7_parse_values", "SELECT * FROM (VALUES ('width', '16.0'), ('opacity', 'none'), ('shape', 'none'), ('color', 'rgb(255,0,0)'), ('em', '32.0')) v(name, value)")
def y7(spark, sf_dir: str) -> DataFrame:
    cases = [("width", "width", "16px"), ("opacity", "opacity", 7), ("shape", "shape", "blob"), ("color", "line-color", "hsl(0, 100%, 50%)"), ("em", "width", "2em")]
    out = [(name, str(v) if (v := sty.parse_value(prop, value)) is not None else "none") for name, prop, value in cases]
    return spark.createDataFrame(out, "name string, value string")


@query("y8_numeric_style", "SELECT id, CASE WHEN weight > 40 THEN 4.0 ELSE 2.0 END * 3 AS rendered FROM ge", on="geo")
def y8(g: Graph) -> DataFrame:
    return sty.cascade(g, SHEET, ["width"]).where("grp = 'edges'").select("id", (F.col("width").cast("double") * 3.0).alias("rendered"))


HIDDEN = ", h AS (SELECT id FROM gn WHERE id = 'n3' OR acctbal > 9000), v AS (SELECT id FROM gn WHERE id NOT IN (SELECT id FROM h) AND id NOT IN (SELECT gc.id FROM gc JOIN h ON h.id = gc.ancestor))"


@query("y9_visibility", HIDDEN + " SELECT id, id IN (SELECT id FROM v) AS visible FROM gn UNION ALL SELECT id, source IN (SELECT id FROM v) AND target IN (SELECT id FROM v) FROM ge", on="geo")
def y9(g: Graph) -> DataFrame:
    g = sty.bypass(g, "#n3, [acctbal > 9000]", {"display": "none"})
    return sty.visibility(g).select("id", "visible")


@query("y10_effective_opacity", "SELECT g.id, CASE WHEN g.id = 'r1' OR b.id IS NOT NULL THEN 0.5 ELSE 1.0 END * CASE WHEN g.id = 'n3' OR g.parent = 'n3' THEN 0.0 ELSE 1.0 END AS opacity, g.id = 'n3' OR coalesce(g.parent = 'n3', false) AS transparent FROM gn g LEFT JOIN (SELECT id FROM gc WHERE ancestor = 'r1') b USING (id)", on="geo")
def y10(g: Graph) -> DataFrame:
    g = sty.bypass(sty.bypass(g, "#r1", {"opacity": 0.5}), "#n3", {"opacity": 0})
    n = g.nodes.select("id")
    return sty.visibility(g).join(n, "id").select("id", F.col("effective_opacity").alias("opacity"), "transparent")


# geometry


BOX = "SELECT min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM (SELECT x - 1.5 AS x1, y - 1.5 AS y1, x + 1.5 AS x2, y + 1.5 AS y2 FROM gn WHERE {})"


@query("b1_bounding_box", BOX.format("kind = 'nation'"), on="geo")
def b1(g: Graph) -> DataFrame:
    return geo.bounding_box(g.elements(".nation"))


@query("b2_rendered_box", "SELECT x1 * 2 + 5 AS x1, y1 * 2 + 5 AS y1, x2 * 2 + 5 AS x2, y2 * 2 + 5 AS y2, w * 2 AS w, h * 2 AS h FROM (" + BOX.format("kind = 'nation'") + ")", on="geo")
def b2(g: Graph) -> DataFrame:
    return geo.rendered(geo.bounding_box(g.elements(".nation")), 2.0, (5.0, 5.0))


@query("b2_box_at", "SELECT -1.5 AS x1, -1.5 AS y1, 25.5 AS x2, 1.5 AS y2, 27.0 AS w, 3.0 AS h", on="geo")
def b2_at(g: Graph) -> DataFrame:
    return geo.bounding_box_at(g.elements(".nation"), (F.col("ord") - 1000).cast("double"), F.lit(0.0))


@query("b3_compound_bounds", """, k AS (SELECT parent AS id, min(x - 0.5) - 2 AS x1, max(x + 0.5) + 2 AS x2, min(y - 0.5) - 2 AS y1, max(y + 0.5) + 2 AS y2 FROM gn WHERE kind IN ('customer', 'supplier') GROUP BY 1),
q AS (SELECT * FROM k UNION ALL SELECT n.parent, min(x1) - 2, max(x2) + 2, min(y1) - 2, max(y2) + 2 FROM k JOIN gn n USING (id) GROUP BY 1)
SELECT gn.id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x2 - x1 AS w, y2 - y1 AS h FROM gn JOIN q USING (id)""", on="geo")
def b3(g: Graph) -> DataFrame:
    return geo.compound_bounds(g, padding=2.0).join(g.parents(), "id", "left_semi")


@query("b3_compound_minimum", """, k AS (SELECT parent AS id, min(x - 0.5) AS x1, max(x + 0.5) AS x2, min(y - 0.5) AS y1, max(y + 0.5) AS y2 FROM gn WHERE kind IN ('customer', 'supplier') GROUP BY 1)
SELECT k.id, round((x1 + x2) / 2 + greatest(900 - (x2 - x1), 0) / 4, 6) AS x, round((y1 + y2) / 2, 6) AS y, round(greatest(x2 - x1, 900) + 0.2 * least(x2 - x1, y2 - y1), 6) AS w, round(y2 - y1 + 0.2 * least(x2 - x1, y2 - y1), 6) AS h FROM k JOIN gn USING (id) WHERE kind = 'nation'""", on="geo")
def b3_minimum(g: Graph) -> DataFrame:
    """Padding of a tenth of the smaller side, and a least width of which three quarters lie on the right."""
    found = geo.compound_bounds(g.with_(nodes=g.nodes.where("kind <> 'region'")), padding="10%", min_width=900.0, relative_to="min", bias=(1.0, 3.0, 0.0, 0.0))
    return found.join(g.elements(".nation").nodes.select("id"), "id").join(g.parents(), "id", "left_semi").select("id", *[F.round(k, 6).alias(k) for k in "xywh"])


@query("b6_select_elements", """, m AS (SELECT id, x, y, CASE kind WHEN 'supplier' THEN 'overlap' WHEN 'nation' THEN 'none' ELSE 'contain' END AS mode FROM gn),
l AS (SELECT e.id, s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target)
SELECT id, 'nodes' AS grp FROM m WHERE CASE mode WHEN 'contain' THEN x - 1.5 >= 100 AND x + 1.5 <= 300 AND y - 1.5 >= 50 AND y + 1.5 <= 200 WHEN 'overlap' THEN x + 1.5 >= 100 AND x - 1.5 <= 300 AND y + 1.5 >= 50 AND y - 1.5 <= 200 ELSE false END
UNION ALL SELECT id, 'edges' FROM l WHERE sx BETWEEN 100 AND 300 AND tx BETWEEN 100 AND 300 AND sy BETWEEN 50 AND 200 AND ty BETWEEN 50 AND 200""", on="geo")
def b6_select(g: Graph) -> DataFrame:
    """Suppliers by any overlap, nations never, the rest and edges if the box contains them."""
    mode = lambda df: F.when(F.col("kind") == "supplier", "overlap").when(F.col("kind") == "nation", "none").otherwise("contain") if "kind" in df.columns else F.lit("contain")
    return geo.select_in_box(g.elements(), 300, 200, 100, 50, mode)


@query("b4_outer_size", "SELECT p_partkey AS id, p_size + 2 + 2 * 5.0 AS center, p_size + 4 + 2 * 5.0 AS outside, p_size + 2 * 5.0 AS inside FROM part")
def b4(spark, sf_dir: str) -> DataFrame:
    d, b, p = F.col("p_size").cast("double"), F.lit(2.0), F.lit(5.0)
    return graphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[geo.outer_size(d, b, p, k).alias(k) for k in ("center", "outside", "inside")])


@query("b5_box_algebra", "SELECT id, x - 20 <= 300 AND x + 20 >= 100 AND y - 10 <= 400 AND y + 10 >= 200 AS meets, x - 20 >= 100 AND x + 20 <= 300 AND y - 10 >= 200 AND y + 10 <= 400 AS inside, x - 21 AS x1, y + 14 AS y2 FROM gn", on="geo")
def b5(g: Graph) -> DataFrame:
    """Boxes about all nodes against one box."""
    own = {"x1": F.col("x") - 20, "y1": F.col("y") - 10, "x2": F.col("x") + 20, "y2": F.col("y") + 10}
    box = {k: F.lit(v) for k, v in {"x1": 100.0, "y1": 200.0, "x2": 300.0, "y2": 400.0}.items()}
    grown = geo.expand(own, 2, 3, 4, 1)
    return g.nodes.select("id", geo.boxes_intersect(box, own).alias("meets"), geo.box_in_box(box, own).alias("inside"), grown["x1"].alias("x1"), grown["y2"].alias("y2"))


@query("b6_box_selection", "SELECT id FROM gn WHERE x + 0.5 >= 100 AND x - 0.5 <= 300 AND y + 0.5 >= 50 AND y - 0.5 <= 200", on="geo")
def b6(g: Graph) -> DataFrame:
    return geo.in_box(g.elements(), 300, 200, 100, 50)


@query("b6_range_join", "SELECT b.k AS box, id FROM gn JOIN (SELECT k, k * 100.0 AS x1, k * 70.0 AS y1, k * 100.0 + 150 AS x2, k * 70.0 + 120 AS y2 FROM range(8) t(k)) b ON x + 0.5 >= x1 AND x - 0.5 <= x2 AND y + 0.5 >= y1 AND y - 0.5 <= y2", on="geo")
def b6_join(g: Graph) -> DataFrame:
    k = F.col("id")
    boxes = g.nodes.sparkSession.range(8).select(k.alias("box"), (k * 100.0).alias("x1"), (k * 70.0).alias("y1"), (k * 100.0 + 150).alias("x2"), (k * 70.0 + 120).alias("y2"))
    return geo.in_boxes(g.elements(), boxes, cell=64.0)


@query("b7_nearest", "SELECT 'node' AS kind, id FROM gn WHERE abs(x - 340.2) <= 0.5 AND abs(y - 30.1) <= 0.5 ORDER BY ord DESC LIMIT 1", on="geo")
def b7(g: Graph) -> DataFrame:
    """The topmost of the nodes where c7 is."""
    return geo.nearest(g.elements("node"), 340.2, 30.1)


SEGMENTS = """, l AS (SELECT e.id, s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target),
q AS (SELECT *, least(greatest(coalesce(((500 - sx) * (tx - sx) + (400 - sy) * (ty - sy)) / nullif((tx - sx) ^ 2 + (ty - sy) ^ 2, 0), 0), 0), 1) AS t, (400.0 - 100) * (tx - sx) - (500.0 - 100) * (ty - sy) AS c FROM l)
SELECT id, round((500 - sx - t * (tx - sx)) ^ 2 + (400 - sy - t * (ty - sy)) ^ 2, 6) AS d,
    coalesce((((500.0 - 100) * (sy - 100) - (400.0 - 100) * (sx - 100)) / nullif(c, 0)) BETWEEN 0 AND 1 AND (((tx - sx) * (sy - 100) - (ty - sy) * (sx - 100)) / nullif(c, 0)) BETWEEN 0 AND 1, false) AS crossing,
    ((sx - 400) / 300) ^ 2 + ((sy - 300) / 200) ^ 2 <= 1 AS ellipse, sx >= 0 AND sy >= 0 AND sx + sy < 605 AS polygon FROM q"""


@query("b8_segment_maths", SEGMENTS, on="geo")
def b8(g: Graph) -> DataFrame:
    """All edges against a point, a segment, an ellipse and a triangle."""
    L = lambda *v: [F.lit(float(x)) for x in v]
    at = [F.col(k) for k in ("sx", "sy", "tx", "ty")]
    corner = geo.in_polygon(F.col("sx"), F.col("sy"), [(-1.0, -1.0), (607.0, -1.0), (-1.0, 607.0)])
    return geo.edge_ends(g.elements()).select("id", F.round(geo.segment_sqdist(*L(500, 400), *at), 6).alias("d"), geo.segments_cross(at, L(100, 100, 500, 400)).alias("crossing"), geo.in_ellipse(F.col("sx"), F.col("sy"), *L(600, 400, 400, 300)).alias("ellipse"), corner.alias("polygon"))


@query("b9_fit", "SELECT round(least(780 / w, 580 / h), 9) AS zoom, round((800 - least(780 / w, 580 / h) * (x1 + x2)) / 2, 6) AS px FROM (" + BOX.format("true") + ")", on="geo")
def b9(g: Graph) -> DataFrame:
    f = geo.fit(g.with_(edges=g.edges.limit(0)), 800, 600, 10)
    return g.nodes.sparkSession.createDataFrame([(round(f.zoom, 9), round(f.pan[0], 6))], "zoom double, px double")


@query("b10_midpoints", "SELECT e.id, (s.x + t.x) / 2 AS x, (s.y + t.y) / 2 AS y FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target", on="geo")
def b10(g: Graph) -> DataFrame:
    return geo.midpoints(g.elements())


# layouts


@query("l1_null", "SELECT id, 0.0 AS x, 0.0 AS y FROM gn", on="geo")
def l1(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "null")


@query("l2_preset", "SELECT id, CASE WHEN kind = 'nation' THEN ord::DOUBLE ELSE x END AS x, CASE WHEN kind = 'nation' THEN 1.0 ELSE y END AS y FROM gn", on="geo")
def l2(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "preset", positions=g.nodes.where("kind = 'nation'").select("id", F.col("ord").cast("double").alias("x"), F.lit(1.0).alias("y")))


RANDOM = "floor(('0x' || substr(md5('3:{}:' || id), 1, 7))::BIGINT / 268435456.0 * 1000 + 0.5)"


@query("l3_random", f"SELECT id, {RANDOM.format(1)} AS x, {RANDOM.format(2)} AS y FROM gn", on="geo")
def l3(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "random", seed=3)


LEAVES = ", k AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS n FROM gn WHERE kind IN ('customer', 'supplier'))"


@query("l4_grid", LEAVES + " SELECT id, round((i % 40) * 25 + 12.5, 6) AS x, round((i // 40) * (1000.0 / ceil(n / 40.0)) + 500.0 / ceil(n / 40.0), 6) AS y FROM k", on="geo")
def l4(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "grid", cols=40).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("l4_grid_square", ", k AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS i FROM tn) SELECT id, (i % 5) * 200.0 + 100 AS x, (i // 5) * 200.0 + 100 AS y FROM k", on="trade")
def l4_square(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "grid")


CHOSEN = LEAVES + """, own AS (SELECT id, 1 AS r, 2 AS c FROM gn WHERE id = 'c1' UNION ALL SELECT id, 0, 1 FROM gn WHERE id = 's1'),
cell AS (SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS j FROM range(100000) a(p), LATERAL (SELECT p // 40 AS r, p % 40 AS c) WHERE p < (SELECT max(n) FROM k) + 80 AND (r, c) NOT IN (SELECT r, c FROM own)),
rest AS (SELECT k.id, row_number() OVER (ORDER BY i) - 1 AS j FROM k JOIN gn USING (id) WHERE NOT locked AND k.id NOT IN (SELECT id FROM own)),
put AS (SELECT id, r, c FROM rest JOIN cell USING (j) UNION ALL SELECT own.id, r, c FROM own JOIN gn USING (id) WHERE NOT locked)
SELECT id, c * 12.0 + 6 AS x, r * 13.0 + 6.5 AS y FROM put UNION ALL SELECT gn.id, x, y FROM gn JOIN k USING (id) WHERE locked"""


@query("l4_grid_positions", CHOSEN, on="geo")
def l4_positions(g: Graph) -> DataFrame:
    """Cells as large as the nodes need; two nodes choose theirs, locked ones stay."""
    pick = lambda c, s: F.when(F.col("id") == "c1", c).when(F.col("id") == "s1", s)
    return lay.run(g.elements(), "grid", cols=40, condense=True, avoid_overlap=True, padding=2.0, size=(F.lit(10.0), F.lit(11.0)), position=(pick(1, 0), pick(2, 1)), skip_locked=True)


@query("l5_circle", f", k AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS n FROM tn) SELECT id, round(500 + 500 * cos({1.5 * math.pi} + i * 2 * pi() / n), 6) AS x, round(500 + 500 * sin({1.5 * math.pi} + i * 2 * pi() / n), 6) AS y FROM k", on="trade")
def l5(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "circle").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


RINGS = f""", deg AS (SELECT tn.id, ord, (SELECT count(*) FROM te WHERE source = tn.id) + (SELECT count(*) FROM te WHERE target = tn.id) AS v FROM tn),
lv AS MATERIALIZED (SELECT v, count(*) AS n, row_number() OVER (ORDER BY v DESC) AS k, (SELECT max(v) / 4.0 FROM deg) AS wide FROM deg GROUP BY v),
sq(k, v, first, ring) AS (SELECT k, v, v, 0 FROM lv WHERE k = 1 UNION ALL
    SELECT lv.k, lv.v, CASE WHEN first - lv.v >= wide THEN lv.v ELSE first END, ring + CASE WHEN first - lv.v >= wide THEN 1 ELSE 0 END FROM sq JOIN lv ON lv.k = sq.k + 1),
rg AS MATERIALIZED (SELECT ring, sum(n) AS n FROM sq JOIN lv USING (k) GROUP BY ring),
rad(ring, r) AS (SELECT -1, -11.0::DOUBLE UNION ALL
    SELECT rg.ring, CASE WHEN n > 1 THEN greatest(r + 11, 11 / sqrt(pow(cos(2 * pi() / n) - 1, 2) + pow(sin(2 * pi() / n), 2))) ELSE r + 11 END FROM rad JOIN rg ON rg.ring = rad.ring + 1),
spot AS (SELECT id, ring, r, n, row_number() OVER (PARTITION BY ring ORDER BY v DESC, ord) - 1 AS i FROM deg JOIN sq USING (v) JOIN rad USING (ring) JOIN rg USING (ring))
SELECT id, ring::INTEGER AS ring, round(500 + r * cos({1.5 * math.pi} + i * 2 * pi() / n), 6) AS x, round(500 + r * sin({1.5 * math.pi} + i * 2 * pi() / n), 6) AS y FROM spot"""


@query("l6_concentric", RINGS, on="trade", recursive=True)
def l6(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "concentric").select("id", "ring", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _layers() -> str:
    from graphloom.plans.q_algorithms import relax

    return relax("tb", "1", "n3", 12) + " SELECT tn.id, coalesce(d, (SELECT max(d) FROM d12))::INTEGER AS depth FROM tn LEFT JOIN d12 USING (id)"


@query("l7_breadthfirst", _layers(), on="trade")
def l7(g: Graph) -> DataFrame:
    return lay.run(g.elements(), "breadthfirst", roots=g.get("n3").nodes.select("id")).select("id", "depth")


@query("l8_cose", on="trade")
def l8(g: Graph) -> DataFrame:
    """No SQL; a test holds the distances of a known graph."""
    return lay.run(g.elements(), "cose")


# scalar functions


@query("x_text_functions", "SELECT id, kind || '-' || lower(segment) AS dash, upper(substr(kind, 1, 1)) || substr(kind, 2) AS cap FROM gn WHERE kind = 'customer'", on="geo")
def x_text(g: Graph) -> DataFrame:
    """Kinds and segments to camel case and back, and with one capital."""
    plain = F.concat_ws("-", "kind", F.lower("segment"))
    return g.elements(".customer").nodes.select("id", colors.camel_to_dash(colors.dash_to_camel(plain)).alias("dash"), colors.capitalize(F.col("kind")).alias("cap"))


@query("x_math_functions", "SELECT id, CASE WHEN x < y THEN [x, y] ELSE [y, x] END::DOUBLE[] AS roots, round(0.25 * 0.25 * x + 2 * 0.25 * 0.75 * y + 0.75 * 0.75 * 100, 6) AS bezier, least(greatest(200, x), 600)::DOUBLE AS clamped FROM gn", on="geo")
def x_math(g: Graph) -> DataFrame:
    """The roots x and y of (t - x)(t - y), a point of a curve, and a bounded x."""
    L = lambda v: F.lit(float(v))
    x, y = F.col("x"), F.col("y")
    return g.nodes.select("id", colors.quadratic_roots(L(1), -(x + y), x * y).alias("roots"), F.round(colors.bezier_at(x, y, L(100), L(0.75)), 6).alias("bezier"), colors.clamp(L(200), x, L(600)).alias("clamped"))


@query("x_kinds", "SELECT id, acctbal IS NOT NULL AS number, coalesce(floor(acctbal) = acctbal, false) AS whole, segment IS NULL AS empty, segment IS NOT NULL AS nonempty FROM gn", on="geo")
def x_kinds(g: Graph) -> DataFrame:
    return g.nodes.select("id", kinds.is_number(F.col("acctbal")).alias("number"), kinds.is_integer(F.col("acctbal")).alias("whole"), kinds.is_empty_string(F.col("segment")).alias("empty"), kinds.is_nonempty_string(F.col("segment")).alias("nonempty"))


@query("x_hashes", ", h AS (SELECT id, ord, 9261 * 65599::HUGEINT + ord AS a, (5381 * 32 + 5381)::HUGEINT + ord AS b FROM gn) SELECT id, CASE WHEN a % 4294967296 >= 2147483648 THEN a % 4294967296 - 4294967296 ELSE a % 4294967296 END::BIGINT AS sdbm, CASE WHEN b % 4294967296 >= 2147483648 THEN b % 4294967296 - 4294967296 ELSE b % 4294967296 END::BIGINT AS djb2 FROM h", on="geo")
def x_hashes(g: Graph) -> DataFrame:
    return g.nodes.select("id", kinds.hash_number(F.col("ord")).alias("sdbm"), kinds.hash_number_alt(F.col("ord")).alias("djb2"))


@query("x_plane", "SELECT id, round(x * cos(radians(30)) - y * sin(radians(30)), 6) AS rx, round(x * sin(radians(30)) + y * cos(radians(30)), 6) AS ry, abs(x - 300) <= 250 AND abs(y - 300) <= 150 AS meets FROM gn", on="geo")
def x_plane(g: Graph) -> DataFrame:
    """Turned points, and the squares about nodes that meet a rectangle."""
    zero = F.lit(0.0)
    turned = kinds.rotated(F.col("x"), F.col("y"), zero, zero, F.lit(30.0))
    square, box = [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)], [(100.0, 200.0), (500.0, 200.0), (500.0, 400.0), (100.0, 400.0)]
    return g.nodes.select("id", F.round(turned["x"], 6).alias("rx"), F.round(turned["y"], 6).alias("ry"), kinds.polygons_overlap(box, square, F.col("x"), F.col("y")).alias("meets"))


@query("s15_sheets", "SELECT id, CASE WHEN kind = 'nation' THEN 7.0 ELSE 5.0 END AS width FROM gn", on="geo")
def s15(g: Graph) -> DataFrame:
    """A sheet from text, written as JSON and read again."""
    import json

    sheet = sty.Sheet.from_json(json.loads(json.dumps(sty.Sheet.from_text("node { width: 5 } /* more */ .nation { width: 7px }").to_json())))
    return sty.cascade(g, sheet, ["width"]).where("grp = 'nodes'").select("id", F.col("width").cast("double").alias("width"))


# events


@query("e1_on", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def e1(spark, sf_dir: str) -> DataFrame:
    return ev.on(graphs.flow(spark, sf_dir), "click view").select("event_id")


@query("e1_once", "SELECT event_type AS type, user_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def e1_once(spark, sf_dir: str) -> DataFrame:
    log = graphs.flow(spark, sf_dir)
    types = " ".join(sorted(r["type"] for r in log.select("type").distinct().collect()))
    return ev.once(log, types).select("type", F.substring("target", 2, 20).cast("long").alias("user_id"), "ts")


TARGET = "'c' || (1 + user_id % 20)"


@query("e2_bubble", f"SELECT {TARGET} AS target, 0 AS level, {TARGET} AS reached FROM events UNION ALL SELECT {TARGET}, depth, ancestor FROM events JOIN gc ON gc.id = {TARGET} UNION ALL SELECT {TARGET}, 3, NULL FROM events".join(["WITH " + graphs.GEO.strip() + " ", ""]))
def e2(spark, sf_dir: str) -> DataFrame:
    """Bubbling of the whole table of events."""
    return ev.bubble(_targeted(spark, sf_dir), graphs.geo(spark, sf_dir)).select("target", "level", F.col("at").alias("reached"))


def _targeted(spark, sf_dir: str) -> DataFrame:
    return graphs.table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.concat(F.lit("c"), (1 + F.col("user_id") % 20).cast("string")).alias("target"), "ts")


@query("e1_stopped", f"SELECT {TARGET} AS target, 0 AS level, {TARGET} AS reached FROM events UNION ALL SELECT {TARGET}, depth, ancestor FROM events JOIN gc ON gc.id = {TARGET} WHERE depth = 1 OR event_type <> 'click' UNION ALL SELECT {TARGET}, 3, NULL FROM events WHERE event_type <> 'click'".join(["WITH " + graphs.GEO.strip() + " ", ""]))
def e1_stopped(spark, sf_dir: str) -> DataFrame:
    """Listeners of nations end the way of clicks."""
    g = graphs.geo(spark, sf_dir)
    stops = g.elements(".nation").nodes.select(F.lit("click").alias("type"), F.col("id").alias("at"))
    return ev.bubble(_targeted(spark, sf_dir), g, stops).select("target", "level", F.col("at").alias("reached"))


@query("e1_promise", "SELECT event_type AS type, 'u' || user_id AS target, ts FROM events WHERE event_type IN ('click', 'view') ORDER BY ts, 1, 2 LIMIT 1")
def e1_promise(spark, sf_dir: str) -> DataFrame:
    return ev.promised(graphs.flow(spark, sf_dir), "click view").select("type", "target", "ts")


@query("e3_replay", "SELECT 'u' || user_id AS target, event_type AS type, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def e3(spark, sf_dir: str) -> DataFrame:
    return ev.replay(graphs.flow(spark, sf_dir))


@query("e4_batches", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def e4(spark, sf_dir: str) -> DataFrame:
    return ev.batched(graphs.flow(spark, sf_dir), "1 hour").groupBy("start", "type").agg(F.count(F.lit(1)).alias("n"))


@query("e5_clicks", ", m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT 'u' || user_id AS target, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, k".replace(", m", "WITH m", 1))
def e5(spark, sf_dir: str) -> DataFrame:
    return ev.clicks(graphs.flow(spark, sf_dir), "6 hours")


@query("e6_degree_stream", "SELECT id, count(*) AS degree FROM (SELECT 'p' || l_partkey AS id FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY 1")
def e6(spark, sf_dir: str) -> DataFrame:
    """Degrees kept over a stream of line items, run to its end; what a batch would give."""
    import uuid

    from graphloom.operators.iterate import cut, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    name = uuid.uuid4().hex
    li = graphs.table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(li.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem.parquet*")
    edges = stream.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    out = f"{base.rstrip('/')}/degrees-{name}"
    save = lambda df, n: df.write.mode("overwrite").parquet(out)  # noqa: E731  the last batch holds the complete result
    q = ev.degree_stream(edges).writeStream.outputMode("complete").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    result = cut(spark.read.parquet(out))
    for folder in (out, f"{out}-log"):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result
