"""Queries of graph algorithms and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import centrality as cen
from graphloom.operators import clustering as clu
from graphloom.operators import kernels as ker
from graphloom.operators import paths as pa
from graphloom.plans import graphs
from graphloom.plans.registry import query

ROUNDS = 9
W = "weight"


def finite(name: str):
    """-1 for what can't be reached."""
    return F.when(F.col(name) == float("inf"), -1.0).otherwise(F.round(name, 6)).alias(name)


def relax(arcs: str, weight: str, start: str = "n3", rounds: int = 25) -> str:
    """Unrolled relaxation over a table of arcs (a, b, w): the tables d0 ... as CTEs."""
    out = [f", d0 AS (SELECT '{start}' AS id, 0.0::DOUBLE AS d)"]
    for k in range(1, rounds + 1):
        out.append(f", d{k} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT b, d + {weight} FROM d{k - 1} x JOIN {arcs} y ON y.a = x.id) GROUP BY id)")
    return "".join(out)


# searches


def layers(nodes: str, edges: str, start: str, rounds: int = ROUNDS) -> str:
    return relax(edges, "1", start, rounds) + f" SELECT id, d::INTEGER AS depth FROM d{rounds}"


@query("g1_bfs_undirected", layers("tn", "tb", "n3"), on="trade")
def g1(g: Graph) -> DataFrame:
    c = g.elements()
    return pa.bfs(c, c.filter("#n3").nodes.select("id")).select("id", "depth")


@query("g1_bfs_directed", layers("tn", "ta", "n3"), on="trade")
def g1_directed(g: Graph) -> DataFrame:
    c = g.elements()
    return pa.bfs(c, c.filter("#n3").nodes.select("id"), directed=True).select("id", "depth")


@query("g1_bfs_geo", layers("gn", "gb", "c7", 12), on="geo")
def g1_geo(g: Graph) -> DataFrame:
    return pa.bfs(g.elements(), g.get("c7").nodes.select("id")).select("id", "depth")


@query("g1_bfs_depth_limit", relax("gb", "1", "c7", 2) + " SELECT id, d::INTEGER AS depth FROM d2", on="geo")
def g1_limit(g: Graph) -> DataFrame:
    return pa.bfs(g.elements(), g.get("c7").nodes.select("id"), max_depth=2).select("id", "depth")


@query("g2_dfs_reach", relax("ta", "1", "n3", ROUNDS) + f" SELECT id FROM d{ROUNDS}", on="trade")
def g2(g: Graph) -> DataFrame:
    return ker.dfs(g.elements(), "n3", directed=True).select("id")


STACK = """, adj AS (SELECT a, list(b ORDER BY ord) AS bs FROM ta GROUP BY a),
w(step, stack, seen, cur) AS (SELECT 0, ['n3'], []::VARCHAR[], NULL::VARCHAR
    UNION ALL SELECT step + 1, CASE WHEN list_contains(seen, stack[-1]) THEN stack[:-2] ELSE list_concat(stack[:-2], coalesce(list_filter(bs, lambda x: NOT list_contains(seen, x)), [])) END,
        CASE WHEN list_contains(seen, stack[-1]) THEN seen ELSE list_append(seen, stack[-1]) END, CASE WHEN list_contains(seen, stack[-1]) THEN NULL ELSE stack[-1] END
    FROM w LEFT JOIN adj ON adj.a = w.stack[-1] WHERE len(stack) > 0)
SELECT cur AS id, (row_number() OVER (ORDER BY step) - 1)::INTEGER AS place FROM w WHERE cur IS NOT NULL"""


@query("g2_dfs", STACK, on="trade", recursive=True)
def g2_order(g: Graph) -> DataFrame:
    """The order of visits, by a stack."""
    return ker.dfs(g.elements(), "n3", directed=True).select("id", "place")


@query("g1_visits", relax("tb", "1", "n3", ROUNDS) + f", v AS (SELECT tn.id, ord, (row_number() OVER (ORDER BY d, ord) - 1)::BIGINT AS place FROM d{ROUNDS} JOIN tn USING (id)) SELECT place, id, id = 'n17' AS found FROM v WHERE place <= coalesce((SELECT place FROM v WHERE id = 'n17'), 99)", on="trade")
def g1_visits(g: Graph) -> DataFrame:
    """Visits up to the one that finds."""
    return pa.visits(g.elements(), g.get("n3").nodes.select("id"), found=F.col("id") == "n17").select("place", "id", "found")


@query("g1_bfs_deals", relax("db", "1", "c7", 8) + " SELECT id, d::INTEGER AS depth FROM d8", on="deals")
def g1_deals(g: Graph) -> DataFrame:
    return pa.bfs(g.elements(), g.get("c7").nodes.select("id")).select("id", "depth")


DISTANCES = " SELECT tn.id, coalesce(round(d, 6), -1.0) AS distance FROM tn LEFT JOIN d25 USING (id)"


@query("g3_dijkstra", relax("tb", "w") + DISTANCES, on="trade")
def g3(g: Graph) -> DataFrame:
    return pa.dijkstra(g.elements(), "n3", F.col(W)).select("id", finite("distance"))


@query("g3_dijkstra_directed", relax("ta", "w") + DISTANCES, on="trade")
def g3_directed(g: Graph) -> DataFrame:
    return pa.dijkstra(g.elements(), "n3", F.col(W), directed=True).select("id", finite("distance"))


@query("g3_dijkstra_deals", relax("db", "w", "c7", 16) + " SELECT dn.id, coalesce(round(d, 6), -1.0) AS distance FROM dn LEFT JOIN d16 USING (id)", on="deals")
def g3_deals(g: Graph) -> DataFrame:
    return pa.dijkstra(g.elements(), "c7", F.col(W)).select("id", finite("distance"))


@query("g3_dijkstra_flows", relax("ta", "w") + DISTANCES, on="flows")
def g3_flows(g: Graph) -> DataFrame:
    return pa.dijkstra(g.elements(), "n3", F.col(W), directed=True).select("id", finite("distance"))


@query("g3_path_length", relax("tb", "w") + " SELECT round(d, 6) AS length FROM d25 WHERE id = 'n17'", on="trade")
def g3_path(g: Graph) -> DataFrame:
    """The weights along the path that the predecessors give add up to the distance."""
    c = g.elements()
    found = pa.dijkstra(c, "n3", F.col(W))
    steps = pa.path_to(found, "n17")[1::2]
    return g.edges.where(F.col("id").isin(steps)).agg(F.round(F.sum(W), 6).alias("length")).where("length is not null")


@query("g4_a_star", relax("tb", "w") + " SELECT true AS found, round(d, 6) AS distance FROM d25 WHERE id = 'n17'", on="trade")
def g4(g: Graph) -> DataFrame:
    r = pa.a_star(g.elements(), "n3", "n17", F.col(W))
    rows = [(r["found"], None if r["distance"] is None else round(r["distance"], 6))]
    return g.nodes.sparkSession.createDataFrame([x for x in rows if x[0]], "found boolean, distance double")


@query("g4_a_star_heuristic", relax("tb", "w") + " SELECT true AS found, round(d, 6) AS distance FROM d25 WHERE id = 'n17'", on="trade")
def g4_heuristic(g: Graph) -> DataFrame:
    """Every step but to the goal itself costs at least 1."""
    r = pa.a_star(g.elements(), "n3", "n17", F.col(W), heuristic=F.when(F.col("id") == "n17", 0.0).otherwise(1.0))
    rows = [(True, round(r["distance"], 6))] if r["found"] else []
    return g.nodes.sparkSession.createDataFrame(rows, "found boolean, distance double")


POTENTIAL = ", h AS (SELECT id, (ord * 7 % 11) / 2.0 AS h FROM tn)"


@query("g5_bellman_ford", relax("ta", "w") + POTENTIAL + " SELECT tn.id, coalesce(round(d + (SELECT h FROM h WHERE id = 'n3') - h.h, 6), -99.0) AS distance FROM tn JOIN h USING (id) LEFT JOIN d25 USING (id)", on="flows")
def g5(g: Graph) -> DataFrame:
    """Weights shifted by a potential of their ends: many are negative, no cycle is, and distances shift alike."""
    high = lambda end: F.substring(end, 2, 9).cast("long") * 7 % 11 / 2.0
    found, _ = pa.bellman_ford(g.elements(), "n3", F.col(W) + high("source") - high("target"), directed=True)
    return found.select("id", F.when(F.col("distance") == float("inf"), -99.0).otherwise(F.round("distance", 6)).alias("distance"))


def negative_sql(levels: list[float]) -> str:
    parts, out = [], []
    for k, less in enumerate(levels):
        parts.append(f", n{k}_0 AS (SELECT 'n3' AS id, 0.0::DOUBLE AS d)")
        for i in range(1, 27):
            parts.append(f", n{k}_{i} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM n{k}_{i - 1} UNION ALL SELECT b, d + (w - {less}::DOUBLE) FROM n{k}_{i - 1} x JOIN ta y ON y.a = x.id) GROUP BY id)")
        out.append(f"SELECT {less}::DOUBLE AS less, (SELECT count(*) > 0 FROM n{k}_26 JOIN n{k}_25 p USING (id) WHERE n{k}_26.d < p.d - 1e-9) AS negative")
    return "".join(parts) + " " + " UNION ALL ".join(out)


LOWERED = [1.0, 1.5, 2.5]


@query("g5_negative_cycle", negative_sql(LOWERED), on="trade")
def g5_cycle(g: Graph) -> DataFrame:
    """Is there a negative cycle when all weights are lowered by so much?"""
    rows = [(less, pa.bellman_ford(g.elements(), "n3", F.col(W) - less, directed=True)[1]) for less in LOWERED]
    return g.nodes.sparkSession.createDataFrame(rows, "less double, negative boolean")


@query("g5_negative_cycles", on="trade")
def g5_cycles(g: Graph) -> DataFrame:
    """The cycles themselves; which of several are found is the relaxation's choice, so a test adds them up."""
    return pa.negative_cycles(g.elements(), "n3", F.col(W) - 2.5, directed=True)


ALL_PAIRS = ", f0 AS (SELECT id AS a, id AS b, 0.0::DOUBLE AS d FROM tn UNION ALL SELECT a, b, w FROM {arcs})" + "".join(
    f", f{k} AS MATERIALIZED (SELECT a, b, min(d) AS d FROM (SELECT * FROM f{k - 1} UNION ALL SELECT x.a, y.b, x.d + y.d FROM f{k - 1} x JOIN f{k - 1} y ON x.b = y.a) GROUP BY a, b)" for k in range(1, 6)
)


@query("g6_floyd_warshall", ALL_PAIRS.format(arcs="tb") + " SELECT a, b, round(d, 6) AS distance FROM f5", on="trade")
def g6(g: Graph) -> DataFrame:
    return pa.all_pairs(g.elements(), F.col(W)).select("a", "b", F.round("distance", 6).alias("distance"))


@query("g6_floyd_warshall_directed", ALL_PAIRS.format(arcs="ta") + " SELECT a, b, round(d, 6) AS distance FROM f5", on="trade")
def g6_directed(g: Graph) -> DataFrame:
    return pa.all_pairs(g.elements(), F.col(W), directed=True).select("a", "b", F.round("distance", 6).alias("distance"))


@query("g6_path", relax("ta", "w") + " SELECT round(d, 6) AS length FROM d25 WHERE id = 'n17'", on="flows")
def g6_path(g: Graph) -> DataFrame:
    """The weights along a path that is read off all distances."""
    c = g.elements()
    steps = pa.pair_path(c, pa.all_pairs(c, F.col(W), directed=True), "n3", "n17", F.col(W), directed=True)[1::2]
    return g.edges.where(F.col("id").isin(steps)).agg(F.round(F.sum(W), 6).alias("length")).where("length is not null")


# an edge is in the forest iff its ends aren't connected by edges before it in (weight, order)
FOREST = """, o AS MATERIALIZED (SELECT id, a, b, w, row_number() OVER (ORDER BY w, ord) AS k FROM ta),
r(k, n, m) AS (SELECT o.k, o.a, o.a FROM o UNION SELECT r.k, r.n, CASE WHEN e.a = r.m THEN e.b ELSE e.a END FROM r JOIN o e ON e.k < r.k AND (e.a = r.m OR e.b = r.m))
SELECT id AS edge, w FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.m = o.b)"""


@query("g7_kruskal", FOREST, on="trade", recursive=True)
def g7(g: Graph) -> DataFrame:
    return pa.minimum_spanning_forest(g.elements(), F.col(W)).select("edge", "w")


REGIONS = """, m AS (SELECT 'n' || n_nationkey AS id, n_regionkey AS r FROM nation), x AS (SELECT s.r AS s, t.r AS t FROM te JOIN m s ON s.id = source JOIN m t ON t.id = target WHERE s.r <> t.r),
side AS (SELECT k, r, (k >> r) & 1 AS side FROM range(1, 16) a(k), range(5) b(r))
SELECT min(n) AS size FROM (SELECT k, count(*) AS n FROM x JOIN side p ON p.r = x.s JOIN side q USING (k) WHERE q.r = x.t AND p.side <> q.side GROUP BY k)"""


@query("g8_karger_stein", "WITH " + graphs.FLOWS.strip() + REGIONS)
def g8(spark, sf_dir: str) -> DataFrame:
    """The least cut between the regions; the SQL tries every way to part them."""
    of = graphs.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("r"))
    e = graphs.flows(spark, sf_dir).edges.join(of.withColumnsRenamed({"id": "source", "r": "s"}), "source").join(of.withColumnsRenamed({"id": "target", "r": "t"}), "target")
    n = graphs.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("ord"))
    g = Graph.of(n, e.select("id", F.col("s").alias("source"), F.col("t").alias("target"), "ord"))
    return spark.createDataFrame([(len(ker.min_cut(g.elements(), seed=3, trials=40)["cut"]),)], "size long")


# components


def spread(nodes: str, arcs: str, rounds: int) -> str:
    out = [f", l0 AS (SELECT id, id AS l FROM {nodes})"]
    for k in range(1, rounds + 1):
        out.append(f", l{k} AS MATERIALIZED (SELECT id, min(l) AS l FROM (SELECT * FROM l{k - 1} UNION ALL SELECT b, l FROM l{k - 1} x JOIN {arcs} y ON y.a = x.id) GROUP BY id)")
    return "".join(out)


@query("j13_components", spread("gn", "gb", 12) + " SELECT id, l AS component FROM l12", on="geo")
def j13(g: Graph) -> DataFrame:
    return pa.components(g.elements())


@query("j13_components_of_part", ", pb AS (SELECT a, b FROM gb WHERE id IN (SELECT id FROM ge WHERE weight > 47))" + spread("gn", "pb", 25) + " SELECT id, l AS component FROM l25", on="geo")
def j13_part(g: Graph) -> DataFrame:
    return pa.components(g.elements("node, edge[weight > 47]"))


@query("j13_components_web", ", wb AS (SELECT source AS a, target AS b FROM we UNION ALL SELECT target, source FROM we)" + spread("wn", "wb", 25) + " SELECT id, l AS component FROM l25", on="web")
def j13_web(g: Graph) -> DataFrame:
    return pa.components(g.elements())


@query("j14_component", spread("gn", "gb", 12) + " SELECT id FROM l12 WHERE l = (SELECT l FROM l12 WHERE id = 'c7')", on="geo")
def j14(g: Graph) -> DataFrame:
    return pa.component_of(g.elements(), "c7").nodes.select("id")


@query("g14_strongly_connected", ", r(a, b) AS (SELECT id, id FROM tn UNION SELECT r.a, ta.b FROM r JOIN ta ON ta.a = r.b) SELECT r.a AS id, min(r.b) AS component FROM r JOIN r s ON s.a = r.b AND s.b = r.a GROUP BY 1", on="trade", recursive=True)
def g14(g: Graph) -> DataFrame:
    """Components named by their smallest node."""
    found = pa.strongly_connected(g.elements())
    name = found.groupBy("component").agg(F.min("id").alias("name"))
    return found.join(name, "component").select("id", F.col("name").alias("component"))


SCC = ", r(a, b) AS (SELECT id, id FROM tn UNION SELECT r.a, ta.b FROM r JOIN ta ON ta.a = r.b), m AS MATERIALIZED (SELECT r.a AS id, min(r.b) AS component FROM r JOIN r s ON s.a = r.b AND s.b = r.a GROUP BY 1)"


@query("g14_between_components", SCC + " SELECT te.id FROM te JOIN m x ON x.id = source JOIN m y ON y.id = target WHERE x.component <> y.component", on="trade", recursive=True)
def g14_cut(g: Graph) -> DataFrame:
    c = g.elements()
    return pa.between_components(c, pa.strongly_connected(c))


@query("g14_strongly_connected_deals", "SELECT id, id AS component FROM dn", on="deals")
def g14_deals(g: Graph) -> DataFrame:
    """Goods only go one way, so each node is its own component."""
    return pa.strongly_connected(g.elements()).select("id", "component")


CUT_VERTICES = """, r(x, a, b) AS (SELECT t.id, n.id, n.id FROM tn t JOIN tn n ON n.id <> t.id UNION SELECT r.x, r.a, tb.b FROM r JOIN tb ON tb.a = r.b AND tb.b <> r.x),
parts AS (SELECT x, count(DISTINCT l) AS n FROM (SELECT x, a, min(b) AS l FROM r GROUP BY x, a) GROUP BY x),
z(a, b) AS (SELECT id, id FROM tn UNION SELECT z.a, tb.b FROM z JOIN tb ON tb.a = z.b),
base AS (SELECT count(DISTINCT l) AS n FROM (SELECT a, min(b) AS l FROM z GROUP BY a))
SELECT x AS id FROM parts, base WHERE parts.n > base.n"""


LIGHT = ", ta2 AS (SELECT * FROM ta WHERE w < 1.8), tb2 AS (SELECT * FROM tb WHERE w < 1.8)"


def light(g: Graph):
    return g.elements("node, edge[weight < 1.8]")


@query("g13_cut_vertices", LIGHT + CUT_VERTICES.replace("tb", "tb2"), on="trade", recursive=True)
def g13(g: Graph) -> DataFrame:
    return ker.biconnected(light(g)).where("cut").select("id").distinct()


# edges at a node belong together iff their other ends are connected without it
BLOCKS = """, r(x, a, b) AS (SELECT t.id, n.id, n.id FROM tn t JOIN tn n ON n.id <> t.id UNION SELECT r.x, r.a, tb2.b FROM r JOIN tb2 ON tb2.a = r.b AND tb2.b <> r.x),
part AS MATERIALIZED (SELECT x, a, min(b) AS l FROM r GROUP BY x, a),
inc AS (SELECT id AS e, a AS v, b AS o FROM ta2 UNION ALL SELECT id, b, a FROM ta2),
adj AS MATERIALIZED (SELECT DISTINCT i.e AS e, j.e AS f FROM inc i JOIN inc j ON i.v = j.v AND i.e <> j.e JOIN part p ON p.x = i.v AND p.a = i.o JOIN part q ON q.x = j.v AND q.a = j.o WHERE p.l = q.l),
z(e, f) AS (SELECT id, id FROM ta2 UNION SELECT z.e, adj.f FROM z JOIN adj ON adj.e = z.f)
SELECT e AS id, min(f) AS part FROM z GROUP BY e"""


@query("g13_biconnected", LIGHT + BLOCKS, on="trade", recursive=True)
def g13_parts(g: Graph) -> DataFrame:
    """Edges (but loops) and the smallest edge of their component."""
    found = ker.biconnected(light(g)).where("kind = 'e'").select("id", "part")
    return found.join(g.edges.where("source <> target").select("id"), "id", "left_semi")


EULER = """, d AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM te UNION ALL SELECT target FROM te) GROUP BY id)""" + spread("tn", "tb", 25) + """
SELECT (SELECT count(*) FROM d WHERE n % 2 = 1) IN (0, 2) AND (SELECT count(DISTINCT l) FROM l25 WHERE id IN (SELECT id FROM d)) <= 1 AS exists"""


@query("g15_euler_exists", EULER, on="trade")
def g15(g: Graph) -> DataFrame:
    return pa.euler_check(g.elements())


@query("g15_euler_trail", spread("tn", "tb", 25) + ", p AS (SELECT id FROM l25 WHERE l = (SELECT l FROM l25 WHERE id = 'n3')) SELECT 2 * (SELECT count(*) FROM te WHERE source IN (SELECT id FROM p)) AS edges, (SELECT count(*) FROM p) AS nodes, true AS walked", on="trade")
def g15_trail(g: Graph) -> DataFrame:
    """A round trip over all edges there and back, of the component of n3; every step leaves where the last one came."""
    part = pa.component_of(g.elements(), "n3")
    back = part.edges.select(F.concat(F.lit("back-"), "id").alias("id"), F.col("target").alias("source"), F.col("source").alias("target"), F.col("ord") + 10_000)
    both = Graph.of(part.nodes.select("id", "ord"), part.edges.select("id", "source", "target", "ord").union(back))
    trail = ker.euler_trail(both.elements(), directed=True)
    step = trail.where("place % 2 = 1").join(both.edges.select("id", "source", "target"), "id")
    ends = step.join(trail.select((F.col("place") + 1).alias("place"), F.col("id").alias("at")), "place").join(trail.select((F.col("place") - 1).alias("place"), F.col("id").alias("to")), "place")
    walked = ends.agg(F.every((F.col("at") == F.col("source")) & (F.col("to") == F.col("target"))).alias("walked"), F.count_distinct("id").alias("edges"))
    return walked.join(F.broadcast(trail.where("place % 2 = 0").agg(F.count_distinct("id").alias("nodes")))).select("edges", "nodes", "walked")  # one row


# centrality

E = 1 / (2 - 0.8)


def ranks(nodes: str, edges: str, n: int) -> str:
    """Unrolled rank iterations over edges (source, target, weight)."""
    out = [
        f", lk AS MATERIALIZED (SELECT source AS a, target AS b, sum(weight) AS w FROM {edges} WHERE source <> target GROUP BY 1, 2)",
        ", tot AS MATERIALIZED (SELECT a, sum(w) AS t FROM lk GROUP BY 1)",
        f", cnt AS (SELECT count(*)::DOUBLE AS n FROM {nodes}), k0 AS (SELECT id, 1 / n AS r FROM {nodes}, cnt)",
    ]
    for k in range(1, n + 1):
        p = f"k{k - 1}"
        out.append(
            f", k{k} AS MATERIALIZED (SELECT {p}.id, {E} * (coalesce(g.v, 0) + (SELECT coalesce(sum(r), 0) FROM {p} WHERE id NOT IN (SELECT a FROM tot)) / n) + {1 - E} / n AS r"
            f" FROM {p} CROSS JOIN cnt LEFT JOIN (SELECT b AS id, sum(w / t * r) AS v FROM lk JOIN tot USING (a) JOIN {p} ON {p}.id = lk.a GROUP BY 1) g ON g.id = {p}.id)"
        )
    return "".join(out)


@query("g9_page_rank", ranks("tn", "te", 50) + " SELECT id, round(r, 6) AS rank FROM k50", on="flows")
def g9(g: Graph) -> DataFrame:
    """To convergence."""
    return cen.page_rank(g.elements(), precision=1e-18, weight=F.col(W)).select("id", F.round("rank", 6).alias("rank"))


@query("g9_page_rank_supply", ranks("pn", "pe", 12) + " SELECT id, round(r, 8) AS rank FROM k12", on="supply")
def g9_supply(g: Graph) -> DataFrame:
    """After twelve rounds, as the SQL has it; a round leaves up to 0.8 of the distance to the end."""
    return cen.page_rank(g.elements(), precision=0.0, iterations=12, weight=F.col(W)).select("id", F.round("rank", 8).alias("rank"))


@query("g9_page_rank_supply_settled", ranks("pn", "pe", 130) + " SELECT id, round(r, 8) AS rank FROM k130", on="supply")
def g9_supply_settled(g: Graph) -> DataFrame:
    """To convergence."""
    return cen.page_rank(g.elements(), precision=1e-24, weight=F.col(W)).select("id", F.round("rank", 8).alias("rank"))


@query("g10_closeness_deals", relax("db", "w", "c7", 16) + " SELECT round(sum(1 / d), 6) AS closeness FROM d16 WHERE id <> 'c7'", on="deals")
def g10_deals(g: Graph) -> DataFrame:
    return cen.closeness(g.elements(), "c7", F.col(W)).select(F.round("closeness", 6).alias("closeness"))


@query("g10_closeness", relax("tb", "w") + " SELECT round(sum(1 / d), 6) AS closeness FROM d25 WHERE id <> 'n3'", on="trade")
def g10(g: Graph) -> DataFrame:
    return cen.closeness(g.elements(), "n3", F.col(W)).select(F.round("closeness", 6).alias("closeness"))


CLOSE = ", c AS (SELECT tn.id, coalesce(sum(1 / d), 0) AS c FROM tn LEFT JOIN f5 ON a = id AND b <> id GROUP BY 1) SELECT id, round(c / max(c) OVER (), 6) AS closeness FROM c"


@query("g11_closeness_normalized", ALL_PAIRS.format(arcs="tb") + CLOSE, on="trade")
def g11(g: Graph) -> DataFrame:
    return cen.closeness_all(g.elements(), F.col(W)).select("id", F.round("closeness", 6).alias("closeness"))


@query("g11_closeness_normalized_directed", ALL_PAIRS.format(arcs="ta") + CLOSE, on="trade")
def g11_directed(g: Graph) -> DataFrame:
    return cen.closeness_all(g.elements(), F.col(W), directed=True).select("id", F.round("closeness", 6).alias("closeness"))


def between(arcs: str, rounds: int = 12) -> str:
    """Shortest path counts by layers; v lies between s and t if the distances add up."""
    out = [f", q AS MATERIALIZED (SELECT DISTINCT a, b FROM {arcs}), h0 AS (SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS n FROM tn)"]
    for k in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT s, t FROM h{i}" for i in range(k))
        out.append(f", h{k} AS MATERIALIZED (SELECT s, b AS t, {k} AS d, sum(n) AS n FROM h{k - 1} JOIN q ON a = t WHERE (s, b) NOT IN ({seen}) GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(rounds + 1))
    return "".join(out) + f", hh AS MATERIALIZED ({union}), bt AS (SELECT x.t AS id, sum(x.n * y.n / z.n) AS b FROM hh x JOIN hh y ON y.s = x.t JOIN hh z ON z.s = x.s AND z.t = y.t WHERE x.d + y.d = z.d AND x.t <> x.s AND x.t <> y.t GROUP BY 1)"


BETWEEN = " SELECT tn.id, round(coalesce(b, 0), 6) AS betweenness, round(coalesce(b / (SELECT max(b) FROM bt), 0), 6) AS normalized FROM tn LEFT JOIN bt USING (id)"


@query("g12_betweenness", between("tb") + BETWEEN, on="trade")
def g12(g: Graph) -> DataFrame:
    return cen.betweenness(g.elements()).select("id", *[F.round(k, 6).alias(k) for k in ("betweenness", "normalized")])


@query("g12_betweenness_directed", between("ta") + BETWEEN, on="trade")
def g12_directed(g: Graph) -> DataFrame:
    return cen.betweenness(g.elements(), directed=True).select("id", *[F.round(k, 6).alias(k) for k in ("betweenness", "normalized")])


# clustering


def uv():
    return [F.col("u"), F.col("v")]


def lloyd(table: str, x: str, y: str, centres: list[tuple[float, float]], dist: str, rounds: int) -> str:
    """Unrolled k-means from given centroids."""
    rows = ", ".join(f"({j}, {a}::DOUBLE, {b}::DOUBLE)" for j, (a, b) in enumerate(centres))
    out = [f", c0 AS (SELECT * FROM (VALUES {rows}) v(j, cx, cy))"]
    for k in range(1, rounds + 1):
        out.append(f", m{k} AS MATERIALIZED (SELECT id, {x} AS px, {y} AS py, (SELECT j FROM c{k - 1} ORDER BY {dist}, j LIMIT 1) AS j FROM {table})")
        out.append(f", c{k} AS MATERIALIZED (SELECT c.j, coalesce(avg(px), any_value(cx)) AS cx, coalesce(avg(py), any_value(cy)) AS cy FROM c{k - 1} c LEFT JOIN m{k} USING (j) GROUP BY c.j)")
    return "".join(out) + f" SELECT id, j AS cluster FROM m{rounds}"


CENTRES = [(0.0, 0.0), (3.0, 8.0), (6.0, 2.0)]


@query("k1_k_means", lloyd("tn", "u", "v", CENTRES, "sqrt((u - cx) ^ 2 + (v - cy) ^ 2)", 4), on="trade")
def k1(g: Graph) -> DataFrame:
    return clu.k_means(g.elements(), uv(), k=3, centroids=[list(p) for p in CENTRES], max_iterations=4, sensitivity=0.0)


@query("k1_k_means_vectors", lloyd("vn", "a0", "a1", [(-0.1, 0.0), (0.1, 0.05)], "abs(a0 - cx) + abs(a1 - cy)", 3), on="vectors")
def k1_vectors(g: Graph) -> DataFrame:
    return clu.k_means(g.elements(), [F.col("a0"), F.col("a1")], k=2, name="manhattan", centroids=[[-0.1, 0.0], [0.1, 0.05]], max_iterations=3, sensitivity=0.0)


@query("k1_k_means_deals", lloyd("dn", "acctbal", "place", [(0.0, 0.0), (5000.0, 100.0), (9000.0, 200.0)], "sqrt((acctbal - cx) ^ 2 + (place - cy) ^ 2)", 6).replace("SELECT id, j", "SELECT id, j"), on="deals")
def k1_deals(g: Graph) -> DataFrame:
    """All customers and suppliers by what they own and where they are."""
    return clu.k_means(g.elements(), [F.col("acctbal"), F.col("place")], k=3, centroids=[[0.0, 0.0], [5000.0, 100.0], [9000.0, 200.0]], max_iterations=6, sensitivity=0.0)


@query("k1_k_means_distance", lloyd("tn", "u", "v", CENTRES, "abs(u - cx) + 3 * abs(v - cy)", 4), on="trade")
def k1_distance(g: Graph) -> DataFrame:
    """A distance of one's own."""
    own = lambda a, b: F.abs(a[0] - b[0]) + 3 * F.abs(a[1] - b[1])
    return clu.k_means(g.elements(), uv(), k=3, name=own, centroids=[list(p) for p in CENTRES], max_iterations=4, sensitivity=0.0)


@query("k1_k_means_embeddings")
def k1_embeddings(spark, sf_dir: str) -> DataFrame:
    """All 64 components, from the vectors of the two smallest ids, until no centroid moves; no SQL."""
    g = graphs.vectors(spark, sf_dir, dims=64)
    columns = [f"a{i}" for i in range(64)]
    first = [list(r) for r in g.nodes.orderBy("ord").limit(2).select(*columns).collect()]
    return clu.k_means(g.elements(), [F.col(a) for a in columns], k=2, centroids=first, max_iterations=10**9, sensitivity=1e-9)


def medoids(rounds: int) -> str:
    out = [", e0 AS (SELECT * FROM (VALUES (0, 'n0'), (1, 'n11'), (2, 'n22')) v(j, id))"]
    for k in range(1, rounds + 1):
        out.append(f", a{k} AS MATERIALIZED (SELECT tn.*, (SELECT e.j FROM e{k - 1} e JOIN tn c ON c.id = e.id ORDER BY sqrt((tn.u - c.u) ^ 2 + (tn.v - c.v) ^ 2), e.j LIMIT 1) AS j FROM tn)")
        out.append(f", e{k} AS MATERIALIZED (SELECT j, arg_min(id, struct_pack(c := cost, o := ord)) AS id FROM (SELECT x.j, x.id, x.ord, sum(abs(x.u - y.u) + abs(x.v - y.v)) AS cost FROM a{k} x JOIN a{k} y USING (j) GROUP BY ALL) GROUP BY j)")
    return "".join(out) + f" SELECT a.id, a.j AS cluster, e.id AS medoid FROM a{rounds} a JOIN e{rounds} e USING (j)"


@query("k2_k_medoids", medoids(8), on="trade")
def k2(g: Graph) -> DataFrame:
    return clu.k_medoids(g.elements(), uv(), k=3, medoids=["n0", "n11", "n22"])


FUZZY = [(0.3, 0.4), (3.2, 7.7), (5.6, 2.3)]


def fuzzy(rounds: int) -> str:
    """Unrolled memberships and centres, exponent 2."""
    out = [", c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {x}::DOUBLE, {y}::DOUBLE)" for j, (x, y) in enumerate(FUZZY)) + ") v(j, cx, cy))"]
    for k in range(1, rounds + 1):
        out.append(f", u{k} AS MATERIALIZED (SELECT id, j, u, v, s / sum(s) OVER (PARTITION BY id) AS m FROM (SELECT id, j, u, v, 1 / ((u - cx) ^ 2 + (v - cy) ^ 2) AS s FROM tn, c{k - 1}))")
        out.append(f", c{k} AS MATERIALIZED (SELECT j, sum(m * m * u) / sum(m * m) AS cx, sum(m * m * v) / sum(m * m) AS cy FROM u{k} GROUP BY j)")
    return "".join(out) + f" SELECT id, arg_max(j, m)::INTEGER AS cluster, " + ", ".join(f"round(max(m) FILTER (j = {j}), 6) AS m{j}" for j in range(3)) + f" FROM u{rounds} GROUP BY id"


@query("k3_fuzzy_c_means", fuzzy(5), on="trade")
def k3(g: Graph) -> DataFrame:
    r = clu.fuzzy_c_means(g.elements(), uv(), k=3, centroids=[list(p) for p in FUZZY], max_iterations=5, sensitivity=0.0)
    return r.select("id", "cluster", *[F.round(F.get("membership", F.lit(j)), 6).alias(f"m{j}") for j in range(3)])


SINGLE = ", nb AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM tn x JOIN tn y ON x.id <> y.id WHERE sqrt((x.u - y.u) ^ 2 + (x.v - y.v) ^ 2) < 2.2)" + spread("tn", "nb", 20) + " SELECT id, l AS cluster FROM l20"


@query("k4_single_linkage", SINGLE, on="trade")
def k4(g: Graph) -> DataFrame:
    return clu.hierarchical(g.elements(), uv(), linkage="single", threshold=2.2)


@query("k4_complete_linkage", on="trade")
def k4_complete(g: Graph) -> DataFrame:
    return clu.hierarchical(g.elements(), uv(), linkage="complete", threshold=4.0)


@query("k4_dendrogram", on="trade")
def k4_dendrogram(g: Graph) -> DataFrame:
    return clu.hierarchical(g.elements(), uv(), linkage="mean", mode="dendrogram", depth=2)


def flow_sql(rounds: int, inflate: float) -> str:
    """Unrolled expansion and inflation of a symmetric matrix with 1 on its diagonal."""
    norm = "SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM"
    out = [f", m0 AS MATERIALIZED ({norm} (SELECT i, j, sum(v) AS v FROM (SELECT a AS i, b AS j, w AS v FROM ta UNION ALL SELECT b, a, w FROM ta) GROUP BY i, j UNION ALL SELECT id, id, 1.0 FROM tn))"]
    for k in range(1, rounds + 1):
        out.append(f", m{k} AS MATERIALIZED ({norm} (SELECT x.i, y.j, pow(sum(x.v * y.v), {inflate}) AS v FROM m{k - 1} x JOIN m{k - 1} y ON x.j = y.i GROUP BY x.i, y.j))")
    return "".join(out) + f", s AS (SELECT i, j FROM m{rounds} WHERE round(v, 3) > 0), n AS (SELECT i, min(j) AS cluster FROM s GROUP BY i) SELECT j AS id, cluster FROM (SELECT j, min(i) AS i FROM s GROUP BY j) JOIN n USING (i)"


@query("k5_markov", flow_sql(20, 1.8), on="trade")
def k5(g: Graph) -> DataFrame:
    return clu.markov(g.elements(), F.col(W), inflate=1.8)


@query("k6_affinity", on="trade")
def k6(g: Graph) -> DataFrame:
    return clu.affinity(g.elements(), uv(), preference="median", damping=0.8)
