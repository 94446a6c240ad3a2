"""Selector queries: text, and the conditions that it means for nodes and edges in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.registry import query, register

NO = "false"
#: name: (selector, condition on gn n, condition on ge e)
SELECTORS: dict[str, tuple[str, str, str]] = {
    "p1_group_node": ("node", "true", NO),
    "p1_group_edge": ("edge", NO, "true"),
    "p2_id": ("#c7, #o33", "n.id = 'c7'", "e.id = 'o33'"),
    "p3_class": (".customer.building", "list_contains(classes, 'customer') AND list_contains(classes, 'building')", NO),
    "p4_defined": ("[acctbal]", "acctbal IS NOT NULL", NO),
    "p5_undefined": ("node[^segment]", "segment IS NULL", NO),
    "p6_truthy": ("node[?acctbal]", "coalesce(acctbal <> 0, false)", NO),
    "p6_falsy": ("[!segment]", "coalesce(segment, '') = ''", "true"),
    "p7_equal_text": ('[segment = "BUILDING"]', "coalesce(segment = 'BUILDING', false)", NO),
    "p7_equal_number": ("edge[weight = 5]", NO, "weight = 5"),
    "p7_not_equal": ('node[segment != "BUILDING"]', "coalesce(segment <> 'BUILDING', true)", NO),
    "p7_type_mismatch": ('node[acctbal = "5"], node[acctbal != "5"][name != 7]', "acctbal IS NOT NULL OR acctbal IS NULL", NO),
    "p8_greater": ("[acctbal > 7500.5]", "coalesce(acctbal > 7500.5, false)", NO),
    "p8_range": ("edge[weight >= 10][weight < 12]", NO, "weight >= 10 AND weight < 12"),
    "p8_text_order": ('[segment > "FURNITURE"]', "coalesce(segment > 'FURNITURE', false)", NO),
    "p9_contains": ('[name *= "000001"]', "contains(name, '000001')", NO),
    "p9_prefix": ('[segment ^= "AUTO"]', "coalesce(starts_with(segment, 'AUTO'), false)", NO),
    "p9_suffix": ('[segment $= "ING"]', "coalesce(suffix(segment, 'ING'), false)", NO),
    "p9_number_text": ('edge[weight ^= "4"]', NO, "starts_with(weight::BIGINT::VARCHAR, '4')"),
    "p10_ignore_case": ('[segment @= "building"]', "coalesce(lower(segment) = 'building', false)", NO),
    "p10_ignore_case_part": ('[segment @*= "mach"]', "coalesce(contains(lower(segment), 'mach'), false)", NO),
    "p11_not_less": ("[acctbal !< 9000]", "coalesce(acctbal >= 9000, false)", NO),
    "p11_not_prefix": ('node[segment !^= "B"]', "coalesce(NOT starts_with(segment, 'B'), true)", NO),
    "p12_degree": ("node[[degree > 12]]", "n.id IN (SELECT id FROM gd WHERE degree > 12)", NO),
    "p12_indegree_zero": ("[[indegree = 0]]", "n.id NOT IN (SELECT id FROM gd WHERE indegree > 0)", NO),
    "p14_selected": (":selected", "selected", NO),
    "p14_unselected": (":unselected", "NOT selected", "true"),
    "p14_selectable": ("node:selectable", "selectable", NO),
    "p14_locked": (":locked", "locked", NO),
    "p14_unlocked": ("node:unlocked", "NOT locked", NO),
    "p14_free_inside": ("node:free:inside:inactive:unanimated", "true", NO),
    "p14_removed": (":removed", NO, NO),
    "p14_parent": (":parent", "n.id IN (SELECT parent FROM gn)", NO),
    "p14_childless": (":childless", "n.id NOT IN (SELECT parent FROM gn WHERE parent IS NOT NULL)", NO),
    "p14_child": (":child", "parent IS NOT NULL", NO),
    "p14_orphan": (":orphan", "parent IS NULL", NO),
    "p14_nonorphan": (":nonorphan", "parent IS NOT NULL", NO),
    "p14_compound": (":compound", "n.id IN (SELECT parent FROM gn)", NO),
    "p14_simple": (":simple", NO, "source <> target"),
    "p14_visible": ("node:visible", "true", NO),
    "p15_directed": (".building -> [acctbal > 5000]", NO, "source IN (SELECT id FROM gn WHERE list_contains(classes, 'building')) AND target IN (SELECT id FROM gn WHERE acctbal > 5000)"),
    "p16_undirected": (".supplier <-> .machinery", NO, "source IN (SELECT id FROM gn WHERE list_contains(classes, 'machinery')) AND target IN (SELECT id FROM gn WHERE kind = 'supplier')"),
    "p17_source_subject": ("$node -> #s3", "n.id IN (SELECT source FROM ge WHERE target = 's3')", NO),
    "p17_target_subject": ("#c7 -> $node", "n.id IN (SELECT target FROM ge WHERE source = 'c7')", NO),
    "p18_neighbour_subject": ("$.customer <-> #s5", "kind = 'customer' AND n.id IN (SELECT source FROM ge WHERE target = 's5')", NO),
    "p19_child_of": ("#n3 > .customer", "kind = 'customer' AND parent = 'n3'", NO),
    "p20_descendant_of": ("#r1 .supplier", "kind = 'supplier' AND n.id IN (SELECT id FROM gc WHERE ancestor = 'r1')", NO),
    "p21_parent_with": ("$node > [acctbal > 9900]", "n.id IN (SELECT parent FROM gn WHERE acctbal > 9900)", NO),
    "p21_ancestor_with": ("$node [acctbal > 9900]", "n.id IN (SELECT ancestor FROM gc JOIN gn m ON m.id = gc.id WHERE m.acctbal > 9900)", NO),
    "p22_middle": ("#r2 > $node > [acctbal < 0]", "parent = 'r2' AND n.id IN (SELECT parent FROM gn WHERE acctbal < 0)", NO),
    "p22_middle_deep": ("#r2 $node [acctbal < 0]", "n.id IN (SELECT id FROM gc WHERE ancestor = 'r2') AND n.id IN (SELECT ancestor FROM gc JOIN gn m ON m.id = gc.id WHERE m.acctbal < 0)", NO),
    "p23_chain": ("#r0 > node > .household", "list_contains(classes, 'household') AND parent IN (SELECT id FROM gn WHERE parent = 'r0')", NO),
    "p24_or": (".region, .nation, edge[weight > 49]", "kind IN ('region', 'nation')", "weight > 49"),
}


def _selected(text: str):
    def run(g: Graph) -> DataFrame:
        return g.elements(text).table().select("id", "grp")

    return run


for _name, (_text, _nodes, _edges) in SELECTORS.items():
    register(_name, _selected(_text), f"SELECT id, 'nodes' AS grp FROM gn n WHERE {_nodes} UNION ALL SELECT id, 'edges' FROM ge e WHERE {_edges}", on="geo")


@query("p12_degree_selector", ", d AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree FROM (SELECT source AS id, 0 AS i, 1 AS o FROM pe UNION ALL SELECT target, 1, 0 FROM pe) GROUP BY id) SELECT pn.id, degree, indegree, outdegree FROM pn JOIN d USING (id) WHERE kind = 'part' AND degree > 40", on="supply")
def p12_degree_selector(g: Graph) -> DataFrame:
    """Parts with many line items: the flagship query, a filter on a degree aggregate."""
    found = g.elements(".part[[degree > 40]]")
    return found.nodes.select("id").join(g.degrees, "id").select("id", "degree", "indegree", "outdegree")


@query("p13_paths", "SELECT 'u' || user_id AS target, count(*) AS n FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50 GROUP BY 1")
def p13_paths(spark, sf_dir: str) -> DataFrame:
    """A dotted path into a struct: users with events whose ``props.k`` is over 50."""
    from graphloom.plans.graphs import table

    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_id").alias("ord"), F.concat(F.lit("u"), "user_id").alias("user"), F.from_json("props", "k long").alias("props"))
    g = Graph.of(rows, rows.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target")))
    return g.elements("node[props.k > 50]").nodes.groupBy(F.col("user").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("p26_canonical_text", "SELECT * FROM (VALUES ('node.a[w > 2]:selected', 1), ('#a -> $.b', 1), ('x1', 0)) v(text, queries)")
def p26_canonical_text(spark, sf_dir: str) -> DataFrame:
    """Canonical texts of some selectors and their numbers of queries; 0 for one that doesn't parse."""
    from graphloom.plans import selector as sel

    rows = [(sel.to_text(q), len(q)) for q in (sel.parse("node.a[w>2]:selected"), sel.parse("#a  ->  $.b"))]
    try:
        sel.parse("x1")
    except sel.SelectorError:
        rows.append(("x1", 0))
    return spark.createDataFrame(rows, "text string, queries int")
