"""Queries of collections: sources and sinks, filters and folds, sets, traversals, degrees, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import aggregate as agg
from graphloom.operators import mutate as mut
from graphloom.operators import traverse as tr
from graphloom.plans.registry import query
from graphloom.sources import elements as el


def ids(c) -> DataFrame:
    return c.table().select("id", "grp")


def both(n: str, e: str) -> str:
    return f"SELECT id, 'nodes' AS grp FROM gn WHERE {n} UNION ALL SELECT id, 'edges' FROM ge WHERE {e}"


def values(spark, **columns) -> DataFrame:
    names = list(columns)
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {kinds[type(columns[n])]}" for n in names))


RICH, POOR = "[acctbal > 8000]", "[acctbal < 9000]"

# sources, sinks, lookups


@query("s1_graph", "SELECT (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM ge) AS edges", on="geo")
def s1(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row


def _records(g: Graph) -> DataFrame:
    """The first customers' part of the graph as element records in one table."""
    n = g.nodes.where("kind <> 'supplier'").select("ord", F.lit(None).cast("string").alias("group"), F.struct("id", "parent", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), "name").alias("data"), F.array_join("classes", " ").alias("classes"))
    e = g.nodes.where("kind = 'customer'").select((F.col("ord") + (1 << 40)).alias("ord"), F.lit(None).cast("string").alias("group"), F.struct(F.concat(F.lit("in-"), "id").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("id").alias("source"), F.col("parent").alias("target"), "name").alias("data"), F.lit("").alias("classes"))
    return n.unionByName(e)


LOADED = "SELECT id, 'nodes' AS grp FROM gn WHERE kind <> 'supplier' UNION ALL SELECT 'in-' || id, 'edges' FROM gn WHERE kind = 'customer'"


@query("s2_flat_elements", LOADED, on="geo")
def s2(g: Graph) -> DataFrame:
    return ids(el.from_elements(_records(g)).elements())


@query("s3_grouped_elements", "SELECT id, 'nodes' AS grp FROM gn WHERE kind IN ('region', 'nation') UNION ALL SELECT 'in-' || id, 'edges' FROM gn WHERE kind = 'nation'", on="geo")
def s3(g: Graph) -> DataFrame:
    """Regions and nations as one document of two lists."""
    n = g.elements(".region, .nation").nodes.agg(F.collect_list(F.struct(F.struct("id").alias("data"))).alias("nodes"))
    e = g.elements(".nation").nodes.agg(F.collect_list(F.struct(F.struct(F.concat(F.lit("in-"), "id").alias("id"), F.col("id").alias("source"), F.col("parent").alias("target")).alias("data"))).alias("edges"))
    text = n.join(F.broadcast(e)).select(F.to_json(F.struct("nodes", "edges")).alias("j"))  # one row
    kind = "nodes array<struct<data:struct<id:string>>>, edges array<struct<data:struct<id:string,source:string,target:string>>>"
    return ids(el.from_grouped(text.select(F.from_json("j", kind).alias("e")).select("e.*")).elements())


@query("s5_add", both("kind <> 'customer'", "false") + " UNION ALL SELECT id, 'nodes' FROM gn WHERE kind = 'customer' AND acctbal > 0 UNION ALL SELECT id, 'edges' FROM ge WHERE source IN (SELECT id FROM gn WHERE acctbal > 0)", on="geo")
def s5(g: Graph) -> DataFrame:
    small = Graph.of(g.nodes.where("kind <> 'customer'"), g.edges.limit(0))
    more = g.nodes.where("kind = 'customer' and acctbal > 0")
    e = g.edges.join(more.select(F.col("id").alias("source")), "source", "left_semi")
    return ids(mut.add(small, more.select(*g.nodes.columns), e.select(*g.edges.columns)).elements())


@query("s6_restore", both("true", "true"), on="geo")
def s6(g: Graph) -> DataFrame:
    gone = g.elements(".supplier").union(tr.connected_edges(g.elements(".supplier")))
    return ids(mut.restore(mut.remove(g.elements(".supplier")), gone).elements())


GONE = "(SELECT id FROM gn WHERE id = 'r1' UNION SELECT id FROM gc WHERE ancestor = 'r1')"


@query("s7_remove_cascade", both(f"id NOT IN {GONE}", f"source NOT IN {GONE} AND target NOT IN {GONE}"), on="geo")
def s7(g: Graph) -> DataFrame:
    return ids(mut.remove(g.elements("#r1")).elements())


@query("s8_move_edges", "SELECT id, CASE WHEN weight > 40 THEN 'c1' ELSE source END AS source, target FROM ge", on="geo")
def s8(g: Graph) -> DataFrame:
    return mut.move(g.elements("edge[weight > 40]"), source="c1", target="nowhere").edges.select("id", "source", "target")


@query("s8_move_parent", "SELECT id, CASE WHEN kind = 'supplier' THEN 'r4' ELSE parent END AS parent FROM gn", on="geo")
def s8_parent(g: Graph) -> DataFrame:
    return mut.move(g.elements(".supplier"), parent="r4").nodes.select("id", "parent")


@query("s9_json", "SELECT id, name, selected FROM gn WHERE kind = 'nation'", on="geo")
def s9(g: Graph) -> DataFrame:
    j = F.from_json("json", "data struct<id:string,name:string>, selected boolean")
    return el.jsons(g.elements(".nation")).select(j.alias("j")).select("j.data.id", "j.data.name", "j.selected")


@query("s10_json_set", "SELECT id, CASE WHEN kind = 'nation' THEN lower(name) ELSE name END AS name FROM gn", on="geo")
def s10(g: Graph) -> DataFrame:
    patch = g.elements(".nation").nodes.select("id", F.lower("name").alias("name"))
    return mut.batch_data(g, patch).nodes.select("id", "name")


@query("s11_export", "SELECT grp, count(*) AS n FROM (SELECT 'nodes' AS grp FROM gn UNION ALL SELECT 'edges' FROM ge) GROUP BY 1", on="geo")
def s11(g: Graph) -> DataFrame:
    return el.jsons(g.elements()).select(F.get_json_object("json", "$.group").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("s12_sync", "SELECT id, CASE WHEN kind = 'supplier' THEN NULL ELSE parent END AS parent, upper(coalesce(name, '')) AS name FROM gn WHERE kind IN ('customer', 'nation', 'supplier') AND (kind <> 'nation' OR id <> 'n3')", on="geo")
def s12(g: Graph) -> DataFrame:
    keep = g.nodes.where("kind in ('customer', 'nation') and id <> 'n3'").select("id", F.when(F.col("parent") != "n3", F.col("parent")).alias("parent"), F.upper("name").alias("name"), F.lit(True).alias("kept"))
    supp = g.nodes.where("kind = 'supplier'").select("id", F.lit("gone").alias("parent"), F.upper("name").alias("name"), F.lit(True).alias("kept"))
    synced = mut.sync(g, keep.unionByName(supp), g.edges.limit(0).select("id", "source", "target")).nodes
    # the old parent stands where the new table gives none; the oracle looks at parents that still exist
    old = g.nodes.select("id", F.col("parent").alias("was"))
    return synced.join(old, "id").select("id", F.when(F.col("id").startswith("s"), F.col("parent")).otherwise(F.col("was")).alias("parent"), "name")


@query("s16_lookup", "SELECT id, name FROM gn WHERE id = 'c12'", on="geo")
def s16(g: Graph) -> DataFrame:
    return g.get("c12").nodes.select("id", "name")


@query("s17_scans", "SELECT count(*) AS n, (SELECT count(*) FROM ge) AS e FROM gn", on="geo")
def s17(g: Graph) -> DataFrame:
    c = g.elements()
    return c.only_nodes().nodes.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(c.only_edges().edges.agg(F.count(F.lit(1)).alias("e"))))  # one row


# filters, projections, folds


@query("f1_nodes_edges", both("coalesce(acctbal > 8000, false)", "false"), on="geo")
def f1(g: Graph) -> DataFrame:
    return ids(g.elements().only_nodes(RICH))


@query("f3_filter_condition", both("coalesce(acctbal * 2 > 15000, false)", "weight % 7 = 0"), on="geo")
def f3(g: Graph) -> DataFrame:
    return ids(g.elements().filter(lambda df: F.col("acctbal") * 2 > 15000 if "acctbal" in df.columns else F.col("weight") % 7 == 0))


@query("f4_map", "SELECT id, length(name) AS value FROM gn", on="geo")
def f4(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.length("name").cast("long").alias("value"))


@query("f5_reduce", "SELECT string_agg(id, ',' ORDER BY ord) AS result FROM gn WHERE kind IN ('region', 'nation')", on="geo")
def f5(g: Graph) -> DataFrame:
    folded = g.elements(".region, .nation").reduce(F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(","), x)), F.col("id"))
    return folded


@query("f5_reduce_merged", "SELECT sum((ord % 89) * length(name))::BIGINT AS result FROM gn", on="geo")
def f5_merged(g: Graph) -> DataFrame:
    """All nodes, folded in parts."""
    add = lambda a, x: a + x
    return g.elements().reduce(F.lit(0).cast("long"), add, F.col("ord") % 89 * F.length("name").cast("long"), merge=add)


@query("f6_max", "SELECT id, acctbal AS value FROM gn WHERE acctbal IS NOT NULL ORDER BY acctbal DESC, ord LIMIT 1", on="geo")
def f6_max(g: Graph) -> DataFrame:
    return g.elements().extreme(F.col("acctbal"))


@query("f6_min", "SELECT id, acctbal AS value FROM gn WHERE acctbal IS NOT NULL ORDER BY acctbal, ord LIMIT 1", on="geo")
def f6_min(g: Graph) -> DataFrame:
    return g.elements().extreme(F.col("acctbal"), largest=False)


@query("f7_some_every", "SELECT bool_or(coalesce(acctbal > 9990, false)) AS some, bool_and(coalesce(acctbal > 9990, false)) AS every FROM gn", on="geo")
def f7(g: Graph) -> DataFrame:
    c = g.elements().only_nodes()
    test = lambda df: F.col("acctbal") > 9990 if "acctbal" in df.columns else F.lit(False)
    return values(g.nodes.sparkSession, some=c.some(test), every=c.every(test))


@query("f8_is_all_are", "SELECT bool_or(kind = 'nation') AS one, bool_and(kind = 'nation') AS every FROM gn", on="geo")
def f8(g: Graph) -> DataFrame:
    c = g.elements("node")
    return values(g.nodes.sparkSession, one=c.is_(".nation"), every=c.all_are(".nation"))


@query("f9_same", ", p AS (SELECT DISTINCT parent AS id FROM gn WHERE kind IN ('customer', 'supplier')), n AS (SELECT id FROM gn WHERE kind = 'nation'), r AS (SELECT id FROM gn WHERE kind = 'region') SELECT (SELECT count(*) FROM (FROM p EXCEPT FROM n)) + (SELECT count(*) FROM (FROM n EXCEPT FROM p)) = 0 AS same, (SELECT count(*) FROM (FROM r EXCEPT FROM n)) = 0 AS other", on="geo")
def f9(g: Graph) -> DataFrame:
    return values(g.nodes.sparkSession, same=g.elements(".nation").same(tr.parents_of(g.elements(".customer, .supplier"))), other=g.elements(".nation").same(g.elements(".region")))


@query("f10_any_same", "SELECT count(*) > 0 AS shared FROM gn WHERE acctbal > 8000 AND acctbal < 9000", on="geo")
def f10(g: Graph) -> DataFrame:
    return values(g.nodes.sparkSession, shared=g.elements(RICH).any_same(g.elements(POOR)))


@query("f11_contains", "SELECT count(*) FILTER (kind = 'nation' AND id NOT IN (SELECT id FROM gn)) = 0 AS inside, count(*) FILTER (kind <> 'nation') = 0 AS outside FROM gn", on="geo")
def f11(g: Graph) -> DataFrame:
    n = g.elements("node")
    return values(g.nodes.sparkSession, inside=n.contains(g.elements(".nation")), outside=g.elements(".nation").contains(n))


@query("f12_all_are_neighbors", "SELECT count(*) = 0 AS near FROM gn WHERE kind = 'supplier' AND id NOT IN (SELECT target FROM ge)", on="geo")
def f12(g: Graph) -> DataFrame:
    return values(g.nodes.sparkSession, near=g.elements(".customer").all_are_neighbors(g.elements(".supplier")))


PLACED = ", p AS (SELECT id, grp, row_number() OVER (ORDER BY grp DESC, ord) - 1 AS i, count(*) OVER () AS n FROM (SELECT id, 'nodes' AS grp, ord FROM gn UNION ALL SELECT id, 'edges', ord FROM ge))"


@query("f14_slice", f"{PLACED} SELECT id, grp FROM p WHERE i >= 10 AND i < 25", on="geo")
def f14(g: Graph) -> DataFrame:
    return ids(g.elements().slice(10, 25))


@query("f14_slice_negative", f"{PLACED} SELECT id, grp FROM p WHERE i >= n - 7 AND i < n - 2", on="geo")
def f14_negative(g: Graph) -> DataFrame:
    return ids(g.elements().slice(-7, -2))


@query("f15_size", "SELECT count(*) AS size, count(*) = 0 AS empty FROM gn WHERE acctbal > 8000", on="geo")
def f15(g: Graph) -> DataFrame:
    c = g.elements(RICH)
    return values(g.nodes.sparkSession, size=c.size(), empty=c.is_empty())


@query("f16_eq_first_last", f"{PLACED} SELECT id, grp FROM p WHERE i IN (0, 3) OR i = n - 1", on="geo")
def f16(g: Graph) -> DataFrame:
    c = g.elements()
    return ids(c.first()).union(ids(c.eq(3))).union(ids(c.last()))


@query("f17_sort", "SELECT id, row_number() OVER (ORDER BY segment, acctbal DESC, ord)::INTEGER AS place FROM gn WHERE kind = 'customer'", on="geo")
def f17(g: Graph) -> DataFrame:
    from graphloom.operators.iterate import global_index

    rows = global_index(g.elements(".customer").nodes, ["segment", F.col("acctbal").desc(), "ord"], "i")
    return rows.select("id", (F.col("i") + 1).cast("int").alias("place"))


TOPMOST = ", z AS (SELECT g.id, CASE WHEN g.id NOT IN (SELECT parent FROM gn WHERE parent IS NOT NULL) THEN 9007199254740990 ELSE coalesce(max(depth), 0) END::BIGINT AS depth FROM gn g LEFT JOIN gc USING (id) GROUP BY g.id)"


@query("f18_z_depth", TOPMOST + " SELECT id, 'nodes' AS grp, depth FROM z UNION ALL SELECT ge.id, 'edges', greatest(s.depth, t.depth) FROM ge JOIN z s ON s.id = source JOIN z t ON t.id = target", on="geo")
def f18(g: Graph) -> DataFrame:
    """Depth in the hierarchy; nodes without children stand on top of everything, edges with the higher end."""
    return tr.z_depth(g.elements())


@query("f19_unique_index", f"{PLACED} SELECT id, i::BIGINT AS index FROM p WHERE grp = 'nodes'", on="geo")
def f19(g: Graph) -> DataFrame:
    return g.elements().indexed().where("grp = 'nodes'").select("id", "index")


@query("f20_kinds", "SELECT id, source = target AS loop, source <> target AS simple FROM ge", on="geo")
def f20(g: Graph) -> DataFrame:
    return g.edges.select("id", (F.col("source") == F.col("target")).alias("loop"), (F.col("source") != F.col("target")).alias("simple"))


@query("f21_data_get", "SELECT id, name, acctbal FROM gn WHERE kind = 'supplier'", on="geo")
def f21(g: Graph) -> DataFrame:
    return g.elements(".supplier").nodes.select("id", "name", "acctbal")


@query("f22_data_set", "SELECT id, CASE WHEN kind = 'nation' THEN 'N' ELSE segment END AS segment FROM gn", on="geo")
def f22(g: Graph) -> DataFrame:
    return mut.set_data(g.elements(".nation"), {"segment": "N", "id": "x"}).nodes.select("id", "segment")


@query("f23_data_remove", "SELECT id, CASE WHEN kind = 'customer' THEN NULL ELSE acctbal END AS acctbal FROM gn", on="geo")
def f23(g: Graph) -> DataFrame:
    return mut.remove_data(g.elements(".customer"), ["acctbal", "id"]).nodes.select("id", "acctbal")


@query("f26_top_k", "SELECT id, acctbal FROM gn WHERE acctbal IS NOT NULL ORDER BY acctbal DESC, ord LIMIT 10", on="geo")
def f26(g: Graph) -> DataFrame:
    return g.elements("[acctbal]").top(10, F.col("acctbal").desc()).select("id", "acctbal")


@query("f2_by_group", both("acctbal > 8000", "weight > 45"), on="geo")
def f2(g: Graph) -> DataFrame:
    parts = g.elements("[acctbal > 8000], edge[weight > 45]").by_group()
    return reduce(DataFrame.union, [df.select("id", F.lit(k).alias("grp")) for k, df in parts.items()])


@query("f13_to_rows", "SELECT count(*) AS n, min(id) AS least, max(id) AS most FROM gn WHERE kind = 'nation'", on="geo")
def f13(g: Graph) -> DataFrame:
    """What passes the driver one by one."""
    seen = [r["id"] for r in g.elements(".nation").to_rows()]
    return values(g.nodes.sparkSession, n=len(seen), least=min(seen), most=max(seen))


@query("f24_scratch", "SELECT id, name AS value FROM gn WHERE kind = 'nation' AND id <> 'n3'", on="geo")
def f24(g: Graph) -> DataFrame:
    g = mut.set_scratch(g.elements(".nation"), {"seen": lambda df: F.col("name") if "name" in df.columns else None})
    return mut.scratch(mut.remove_scratch(g.elements("#n3"), ["seen"]).elements(), "seen")


@query("f25_core_data", "SELECT count(*) AS nodes, min(name) AS first FROM gn WHERE kind = 'nation'", on="geo")
def f25(g: Graph) -> DataFrame:
    """Fields of the graph itself go with it through changes, and those that are removed don't."""
    row = g.nodes.where("kind = 'nation'").agg(F.count(F.lit(1)).alias("nodes"), F.min("name").alias("first")).first()
    g = mut.remove(g.set_data(nodes=row["nodes"], first=row["first"], gone=1).remove_data("gone").elements("#n3"))
    return values(g.nodes.sparkSession, **g.data)


@query("s13_clone", both("kind = 'nation'", "false"), on="geo")
def s13(g: Graph) -> DataFrame:
    """A copy of a collection stays as it is when the graph goes on."""
    copy = g.elements(".nation")
    mut.remove(copy)
    return ids(copy)


@query("x3_extension", "SELECT count(*) AS n FROM gn WHERE kind = 'nation'", on="geo")
def x3(g: Graph) -> DataFrame:
    from graphloom import extensions

    if extensions.extension("collection", "count_of_class") is None:
        extensions.register("collection", "count_of_class", lambda c, name: c.filter(f".{name}").size())
    return values(g.nodes.sparkSession, n=g.elements().count_of_class("nation"))


# sets


A, B = "acctbal > 8000", "acctbal < 9000"


@query("o1_union", both(f"coalesce({A}, false) OR kind = 'nation'", "weight > 45"), on="geo")
def o1(g: Graph) -> DataFrame:
    return ids(g.elements(RICH).union(g.elements(".nation, edge[weight > 45]")))


@query("o2_difference", both(f"{A} AND NOT {B}", "false"), on="geo")
def o2(g: Graph) -> DataFrame:
    return ids(g.elements(RICH).difference(g.elements(POOR)))


@query("o3_intersection", both(f"{A} AND {B}", "false"), on="geo")
def o3(g: Graph) -> DataFrame:
    return ids(g.elements(RICH).intersection(g.elements(POOR)))


@query("o4_symmetric_difference", both(f"({A}) <> ({B})", "false"), on="geo")
def o4(g: Graph) -> DataFrame:
    return ids(g.elements(RICH) ^ g.elements(POOR))


@query("o5_diff", f"SELECT id, CASE WHEN {A} AND {B} THEN 'both' WHEN {A} THEN 'left' ELSE 'right' END AS side FROM gn WHERE {A} OR {B}", on="geo")
def o5(g: Graph) -> DataFrame:
    parts = g.elements(RICH).diff(g.elements(POOR))
    return reduce(DataFrame.union, [c.nodes.select("id", F.lit(k).alias("side")) for k, c in parts.items()])


@query("o6_complement", both(f"NOT coalesce({A}, false)", "true"), on="geo")
def o6(g: Graph) -> DataFrame:
    return ids(g.elements(RICH).absolute_complement())


@query("o7_merge_unmerge", both("kind IN ('region')", "false"), on="geo")
def o7(g: Graph) -> DataFrame:
    return ids(g.elements(".region").merge(g.elements(".nation")).unmerge(g.elements(".nation")))


# traversals

N3 = "(SELECT id FROM gn WHERE parent = 'n3')"


@query("j1_connected_edges", both("false", f"source IN {N3} OR target IN {N3}"), on="geo")
def j1(g: Graph) -> DataFrame:
    return ids(tr.connected_edges(g.elements("#n3 > node")))


@query("j2_connected_nodes", both("id IN (SELECT unnest([source, target]) FROM ge WHERE weight > 48)", "false"), on="geo")
def j2(g: Graph) -> DataFrame:
    return ids(tr.connected_nodes(g.elements("edge[weight > 48]")))


@query("j3_sources_targets", "SELECT id, 's' AS side FROM gn WHERE id IN (SELECT source FROM ge WHERE weight > 48) UNION ALL SELECT id, 't' FROM gn WHERE id IN (SELECT target FROM ge WHERE weight > 48)", on="geo")
def j3(g: Graph) -> DataFrame:
    c = g.elements("edge[weight > 48]")
    return tr.sources(c).nodes.select("id", F.lit("s").alias("side")).union(tr.targets(c).nodes.select("id", F.lit("t")))


@query("j3_source_of_first", "SELECT source AS id FROM ge ORDER BY ord LIMIT 1", on="geo")
def j3_first(g: Graph) -> DataFrame:
    return tr.source(g.elements("edge")).nodes.select("id")


NEAR = both(f"id IN (SELECT b FROM gb WHERE a IN {N3})", f"source IN {N3} OR target IN {N3}")


@query("j4_neighborhood", NEAR, on="geo")
def j4(g: Graph) -> DataFrame:
    return ids(tr.neighborhood(g.elements("#n3 > node")))


@query("j5_closed_neighborhood", both(f"id IN (SELECT b FROM gb WHERE a IN {N3}) OR parent = 'n3'", f"source IN {N3} OR target IN {N3}"), on="geo")
def j5(g: Graph) -> DataFrame:
    return ids(tr.closed_neighborhood(g.elements("#n3 > node")))


@query("j6_outgoers", both("id IN (SELECT target FROM ge WHERE source = 'c7')", "source = 'c7'"), on="geo")
def j6(g: Graph) -> DataFrame:
    return ids(tr.outgoers(g.elements("#c7")))


@query("j6_incomers", both("id IN (SELECT source FROM ge WHERE target = 's7')", "target = 's7'"), on="geo")
def j6_incomers(g: Graph) -> DataFrame:
    return ids(tr.incomers(g.elements("#s7")))


def reach(a: str, b: str) -> str:
    return f", r(id) AS (SELECT {b} FROM te WHERE {a} = 'n3' UNION SELECT te.{b} FROM r JOIN te ON te.{a} = r.id) SELECT id, 'nodes' AS grp FROM r UNION ALL SELECT id, 'edges' FROM te WHERE {a} = 'n3' OR {a} IN (SELECT id FROM r)"


@query("j7_successors", reach("source", "target"), on="trade", recursive=True)
def j7(g: Graph) -> DataFrame:
    return ids(tr.successors(g.elements("#n3")))


@query("j7_predecessors", reach("target", "source").replace("'n3'", "(SELECT min(target) FROM te WHERE source <> target)"), on="trade", recursive=True)
def j7_predecessors(g: Graph) -> DataFrame:
    """Of the first node that others lead to."""
    first = g.edges.where("source <> target").agg(F.min("target").alias("id"))
    return ids(tr.predecessors(g.elements().only_nodes().within(first)))


@query("j8_roots", "SELECT id FROM tn WHERE id NOT IN (SELECT target FROM te WHERE source <> target)", on="trade")
def j8(g: Graph) -> DataFrame:
    return tr.roots(g.elements()).nodes.select("id")


@query("j8_leaves", both("id NOT IN (SELECT source FROM ge)", "false"), on="geo")
def j8_leaves(g: Graph) -> DataFrame:
    return ids(tr.leaves(g.elements()))


@query("j9_edges_with", both("false", "source IN (SELECT id FROM gn WHERE list_contains(classes, 'building')) AND target IN (SELECT id FROM gn WHERE acctbal > 5000)"), on="geo")
def j9(g: Graph) -> DataFrame:
    return ids(tr.edges_with(g.elements(".supplier[acctbal > 5000]"), g.elements(".building")))


@query("j10_edges_to", both("false", "source IN (SELECT id FROM gn WHERE list_contains(classes, 'building')) AND target IN (SELECT id FROM gn WHERE acctbal > 5000)"), on="geo")
def j10(g: Graph) -> DataFrame:
    return ids(tr.edges_to(g.elements(".building"), g.elements(".supplier[acctbal > 5000]")))


@query("j11_parallel_edges", ", m AS (SELECT DISTINCT least(source, target) AS x, greatest(source, target) AS y FROM pe WHERE weight = 50) SELECT id FROM pe JOIN m ON least(source, target) = x AND greatest(source, target) = y", on="supply")
def j11(g: Graph) -> DataFrame:
    return tr.parallel_edges(g.elements("edge[weight = 50]")).edges.select("id")


@query("j12_codirected_edges", ", m AS (SELECT DISTINCT source, target FROM pe WHERE weight = 1) SELECT id FROM pe JOIN m USING (source, target)", on="supply")
def j12(g: Graph) -> DataFrame:
    return tr.codirected_edges(g.elements("edge[weight = 1]")).edges.select("id")


@query("j15_parents", both("id IN (SELECT parent FROM gn WHERE acctbal > 9900)", "false"), on="geo")
def j15(g: Graph) -> DataFrame:
    return ids(tr.parents_of(g.elements("[acctbal > 9900]")))


@query("j16_ancestors", both("id IN (SELECT ancestor FROM gc JOIN gn m ON m.id = gc.id WHERE m.acctbal > 9900)", "false"), on="geo")
def j16(g: Graph) -> DataFrame:
    return ids(tr.ancestors(g.elements("[acctbal > 9900]")))


@query("j17_common_ancestors", ", k AS (SELECT id FROM gn WHERE parent = 'n3' OR id = 'n3') SELECT ancestor AS id FROM gc WHERE id IN (SELECT id FROM k) GROUP BY ancestor HAVING count(*) = (SELECT count(*) FROM k)", on="geo")
def j17(g: Graph) -> DataFrame:
    return tr.common_ancestors(g.elements("#n3 > node, #n3")).nodes.select("id")


@query("j18_children", both("parent IN ('r1', 'n3')", "false"), on="geo")
def j18(g: Graph) -> DataFrame:
    return ids(tr.children(g.elements("#r1, #n3")))


@query("j19_descendants", both("id IN (SELECT id FROM gc WHERE ancestor = 'r1')", "false"), on="geo")
def j19(g: Graph) -> DataFrame:
    return ids(tr.descendants(g.elements("#r1")))


@query("j20_siblings", both("parent = (SELECT parent FROM gn WHERE id = 'c7') AND id <> 'c7'", "false"), on="geo")
def j20(g: Graph) -> DataFrame:
    return ids(tr.siblings(g.elements("#c7")))


@query("j21_hierarchy_tests", "SELECT id, id IN (SELECT parent FROM gn WHERE parent IS NOT NULL) AS is_parent, id NOT IN (SELECT parent FROM gn WHERE parent IS NOT NULL) AS is_childless, parent IS NOT NULL AS is_child, parent IS NULL AS is_orphan FROM gn", on="geo")
def j21(g: Graph) -> DataFrame:
    return tr.is_parent(g.elements())


@query("j22_levels", "SELECT ancestor AS id, depth, count(*) AS below FROM gc GROUP BY 1, 2", on="geo")
def j22(g: Graph) -> DataFrame:
    """How many nodes each node has at each level below it, walking down."""
    return g.closure().groupBy(F.col("ancestor").alias("id"), "depth").agg(F.count(F.lit(1)).alias("below"))


# degrees


@query("a1_degree", ", d AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree FROM (SELECT source AS id, 0 AS i, 1 AS o FROM pe UNION ALL SELECT target, 1, 0 FROM pe) GROUP BY id) SELECT pn.id, coalesce(degree, 0) AS degree, coalesce(indegree, 0) AS indegree, coalesce(outdegree, 0) AS outdegree FROM pn LEFT JOIN d USING (id)", on="supply")
def a1(g: Graph) -> DataFrame:
    return agg.degrees(g.elements())


@query("a1_degree_without_loops", "SELECT tn.id, count(e.id) AS degree FROM tn LEFT JOIN (SELECT source AS n, id FROM te WHERE source <> target UNION ALL SELECT target, id FROM te WHERE source <> target) e ON e.n = tn.id GROUP BY 1", on="trade")
def a1_loops(g: Graph) -> DataFrame:
    return agg.degrees(g.elements(), include_loops=False).select("id", "degree")


@query("a3_degree_summary", ", d AS (SELECT gn.id, coalesce(degree, 0) AS degree, coalesce(indegree, 0) AS indegree, coalesce(outdegree, 0) AS outdegree FROM gn LEFT JOIN gd USING (id) WHERE kind = 'supplier') SELECT min(degree) AS min_degree, max(degree) AS max_degree, min(indegree) AS min_indegree, max(indegree) AS max_indegree, min(outdegree) AS min_outdegree, max(outdegree) AS max_outdegree, sum(degree)::BIGINT AS total_degree FROM d", on="geo")
def a3(g: Graph) -> DataFrame:
    return agg.degree_summary(g.elements(".supplier"))


CENTRAL = ", s AS (SELECT source AS id, weight AS w FROM te UNION ALL SELECT target, weight FROM te WHERE source <> target), d AS (SELECT tn.id, pow(count(w), 0.5) * pow(coalesce(sum(w), 0), 0.5) AS degree FROM tn LEFT JOIN s USING (id) GROUP BY 1)"


@query("a5_degree_centrality", f"{CENTRAL} SELECT id, round(degree, 6) AS degree FROM d", on="trade")
def a5(g: Graph) -> DataFrame:
    return agg.degree_centrality(g.elements(), F.col("weight"), alpha=0.5).select("id", F.round("degree", 6).alias("degree"))


@query("a5_degree_centrality_directed", "SELECT tn.id, (SELECT count(*) FROM te WHERE target = tn.id)::DOUBLE AS indegree, (SELECT count(*) FROM te WHERE source = tn.id)::DOUBLE AS outdegree FROM tn", on="trade")
def a5_directed(g: Graph) -> DataFrame:
    return agg.degree_centrality(g.elements(), directed=True)


@query("a6_degree_centrality_normalized", f"{CENTRAL} SELECT id, round(degree / max(degree) OVER (), 6) AS degree FROM d", on="trade")
def a6(g: Graph) -> DataFrame:
    return agg.degree_centrality_normalized(g.elements(), F.col("weight"), alpha=0.5).select("id", F.round("degree", 6).alias("degree"))


@query("a7_number_summary", "SELECT min(acctbal) AS min, max(acctbal) AS max, round(avg(acctbal), 6) AS mean, median(acctbal) AS median FROM gn", on="geo")
def a7(g: Graph) -> DataFrame:
    return agg.number_summary(g.nodes, F.col("acctbal")).withColumn("mean", F.round("mean", 6))


@query("a8_normalize", "SELECT id, round(weight / sum(weight) OVER (), 12) AS share FROM ge", on="geo")
def a8(g: Graph) -> DataFrame:
    return agg.sum_normalize(g.edges, "weight", "share").select("id", F.round("share", 12).alias("share"))


# changes


@query("u1_classes", "SELECT id, list_sort(CASE WHEN kind = 'nation' THEN ['big', 'state'] WHEN list_contains(classes, 'building') THEN ['building', 'customer', 'new'] WHEN kind = 'region' THEN [] ELSE classes END)::VARCHAR[] AS classes FROM gn", on="geo")
def u1(g: Graph) -> DataFrame:
    g = mut.set_classes(g.elements(".nation"), "big state big")
    g = mut.add_class(g.elements(".building"), "new customer")
    g = mut.remove_class(g.elements(".region"), "region x")
    g = mut.toggle_class(mut.toggle_class(g.elements(".supplier"), "t supplier").elements(".t"), "t supplier")
    return g.nodes.select("id", F.array_sort("classes").alias("classes"))


@query("u2_switches", "SELECT id, kind = 'nation' OR locked AS locked, CASE WHEN kind = 'customer' AND selectable THEN true ELSE selected END AS selected, kind <> 'region' AS grabbable FROM gn", on="geo")
def u2(g: Graph) -> DataFrame:
    g = mut.switch(g.elements(".nation"), "lock")
    g = mut.switch(g.elements(".customer"), "select")
    g = mut.switch(g.elements(".region"), "ungrabify")
    return g.nodes.select("id", "locked", "selected", "grabbable")


@query("u3_overrides", "SELECT id, true AS locked, false AS grabbable, false AS selectable FROM (SELECT id FROM gn UNION ALL SELECT id FROM ge)", on="geo")
def u3(g: Graph) -> DataFrame:
    return mut.flags(g.with_(autolock=True, autoungrabify=True, autounselectify=True)).select("id", "locked", "grabbable", "selectable")


@query("u4_shift", ", s AS (SELECT id FROM gn WHERE id IN ('r1', 'n3', 'c7') AND NOT locked), m AS (SELECT id FROM s UNION SELECT id FROM gc WHERE ancestor IN (SELECT id FROM s)) SELECT id, CASE WHEN id IN (SELECT id FROM m) THEN x + 5 ELSE x END AS x, CASE WHEN id IN (SELECT id FROM m) THEN y - 3 ELSE y END AS y FROM gn", on="geo")
def u4(g: Graph) -> DataFrame:
    return mut.shift(g.elements("#r1, #n3, #c7"), 5, -3).nodes.select("id", "x", "y")


@query("u4_positions", "SELECT id, CASE WHEN kind = 'supplier' AND NOT locked THEN 1.5 ELSE x END AS x, CASE WHEN kind = 'supplier' AND NOT locked THEN 2.5 ELSE y END AS y FROM gn", on="geo")
def u4_positions(g: Graph) -> DataFrame:
    return mut.set_positions(g.elements(".supplier"), F.lit(1.5), F.lit(2.5)).nodes.select("id", "x", "y")


@query("u5_rendered_position", "SELECT id, x * 2 + 10 AS x, y * 2 - 20 AS y FROM gn", on="geo")
def u5(g: Graph) -> DataFrame:
    return mut.rendered_position(g.with_(zoom=2.0, pan=(10.0, -20.0)))


@query("u5_relative_position", "SELECT a.id, a.x - coalesce(p.x, 0) AS x, a.y - coalesce(p.y, 0) AS y FROM gn a LEFT JOIN gn p ON p.id = a.parent", on="geo")
def u5_relative(g: Graph) -> DataFrame:
    return mut.relative_position(g)


@query("u6_batch_data", "SELECT id, CASE WHEN kind = 'supplier' THEN acctbal + 1 ELSE acctbal END AS acctbal FROM gn", on="geo")
def u6(g: Graph) -> DataFrame:
    return mut.batch_data(g, g.elements(".supplier").nodes.select("id", (F.col("acctbal") + 1).alias("acctbal"))).nodes.select("id", "acctbal")
