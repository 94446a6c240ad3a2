"""Golden values on small graphs, selectors on a compound graph, integrity rules."""

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import aggregate, centrality, clustering, kernels, layouts, mutate, paths, traverse
from graphloom.plans import selector
from graphloom.sources import elements


# A graph of six nodes with known results, and seven points with two known clusters (test_k_means_golden).
@pytest.fixture(scope="module")
def six(spark):
    ends = [("ae", 1), ("ab", 3), ("be", 4), ("bc", 5), ("ce", 6), ("cd", 2), ("cf", 1), ("de", 7), ("df", 8)]
    n = spark.createDataFrame([(v, i) for i, v in enumerate("abcdef")], "id string, ord long")
    e = spark.createDataFrame([(x, x[0], x[1], float(w), i) for i, (x, w) in enumerate(ends)], "id string, source string, target string, weight double, ord long")
    return Graph.of(n, e)


def values(df, name, digits=2):
    return {r["id"]: round(r[name], digits) for r in df.collect()}


def part(g, nodes):
    c = g.elements()
    return c.within(c.nodes.where(F.col("id").isin(list(nodes))).select("id").union(c.edges.select("id")))




def test_searches(six):
    c = six.elements()
    root = six.get("a").nodes.select("id")
    assert values(paths.bfs(c, root), "depth") == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2, "f": 3}
    assert values(paths.bfs(c, root, directed=True), "depth") == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 3, "f": 3}
    assert [r["id"] for r in kernels.dfs(c, "a", directed=True).collect()][0] == "a"


def test_shortest_paths(six):
    c, w = part(six, "abcde"), F.col("weight")
    found = paths.dijkstra(c, "a", w)
    assert values(found, "distance") == {"a": 0, "b": 3, "e": 1, "c": 7, "d": 8}
    assert paths.path_to(found, "d") == ["a", "ae", "e", "de", "d"]
    found = paths.dijkstra(c, "a", w, directed=True)
    assert values(found, "distance") == {"a": 0, "b": 3, "e": 1, "c": 8, "d": 10}
    assert paths.path_to(found, "d") == ["a", "ab", "b", "bc", "c", "cd", "d"]
    assert not paths.a_star(c, "c", "a", directed=True)["found"]
    found, negative = paths.bellman_ford(c, "b", w, directed=True)
    assert values(found, "distance") == {"a": float("inf"), "b": 0, "c": 5, "d": 7, "e": 4} and not negative


def test_centrality(six):
    c, w = part(six, "abcde"), F.col("weight")
    near = lambda **o: [round(centrality.closeness(c, v, **o).first()[0], 2) for v in "abcde"]
    assert near() == [3.0, 3.5, 3.5, 3.0, 4.0]
    whole = centrality.closeness_all(six.elements(), normalized=False)
    assert values(whole, "closeness")["a"] == 3.33 and values(whole, "closeness")["c"] == 4.5
    assert values(centrality.betweenness(six.elements()), "betweenness")["c"] == 5.33
    directed = values(centrality.betweenness(six.elements(), directed=True), "betweenness")
    assert [directed[v] for v in "abcde"] == [0, 3, 4, 0, 0]
    weighted = values(centrality.betweenness(six.elements(), w), "betweenness")
    assert [weighted[v] for v in "abcde"] == [1, 0, 10, 0, 6]
    assert values(aggregate.degree_centrality(six.elements()), "degree") == {"a": 2, "b": 3, "c": 4, "d": 3, "e": 4, "f": 2}
    rank = values(centrality.page_rank(six.elements()), "rank", 6)
    assert rank == {"a": 0.09488, "b": 0.134365, "c": 0.150937, "d": 0.136741, "e": 0.28931, "f": 0.193768}


def test_trees_and_cuts(six):
    forest = {r["edge"] for r in paths.minimum_spanning_forest(six.elements(), F.col("weight")).collect()}
    assert forest == {"ae", "cf", "cd", "ab", "bc"}
    r = kernels.min_cut(six.elements())
    assert 2 <= len(r["cut"]) <= 4 and sorted(r["partition1"] + r["partition2"]) == list("abcdef")
    assert {r["component"] for r in paths.components(six.elements()).collect()} == {"a"}
    assert paths.strongly_connected(six.elements()).select("component").distinct().count() == 6


def test_k_means_golden(spark):
    points = {1: (1, 1), 2: (1.5, 2), 3: (3, 4), 4: (5, 7), 5: (3.5, 5), 6: (4.5, 5), 7: (3.5, 4.5)}
    n = spark.createDataFrame([(str(i), i, float(a), float(b)) for i, (a, b) in points.items()], "id string, ord long, attrA double, attrB double")
    g = Graph.of(n, n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target")))
    got = dict(clustering.k_means(g.elements(), [F.col("attrA"), F.col("attrB")], centroids=[[1, 1], [5, 7]]).collect())
    assert {k for k, v in got.items() if v == 0} == {"1", "2"}


def test_affinity_and_hierarchy(spark):
    n = spark.createDataFrame([(f"n{i}", i, float(10 * (i % 3)) + i / 100) for i in range(12)], "id string, ord long, a double")
    g = Graph.of(n, n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target")))
    want = {frozenset(f"n{i}" for i in range(12) if i % 3 == k) for k in range(3)}

    def sets(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["cluster"], set()).add(r["id"])
        return {frozenset(v) for v in out.values()}

    assert sets(clustering.affinity(g.elements(), [F.col("a")])) == want
    for linkage in ("single", "complete", "mean"):
        assert sets(clustering.hierarchical(g.elements(), [F.col("a")], linkage=linkage, threshold=3.0)) == want
    with pytest.raises(ValueError, match="Damping"):
        clustering.affinity(g.elements(), [F.col("a")], damping=0.2)


def test_components_take_few_rounds(spark, monkeypatch):
    """Long chains in an order of their own, a ring, loops, parallel edges and lonely nodes; each round would write twice."""
    frame, write, written = type(spark.range(1)), type(spark.range(1)).checkpoint, []
    monkeypatch.setattr(frame, "checkpoint", lambda *a, **o: written.append(1) or write(*a, **o))
    name = lambda i: f"v{i * 389 % 1000:03d}"
    chains = [(name(i), name(i + 1)) for i in range(899) if i % 300 != 299]
    ends = chains + chains[:5] + [(b, a) for a, b in chains[5:9]] + [(name(900), name(901)), (name(901), name(902)), (name(902), name(900)), (name(950), name(950))]
    n = spark.createDataFrame([(name(i),) for i in range(1000)], "id string")
    e = spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(ends)], "id string, source string, target string")
    got = {r["id"]: r["component"] for r in paths.components(Graph.of(n, e).elements()).collect()}
    groups = [range(k, k + 300) for k in (0, 300, 600)] + [range(900, 903)] + [[i] for i in range(903, 1000)]
    assert got == {name(i): min(map(name, g)) for g in groups for i in g}
    assert len(written) <= 4


@pytest.fixture(scope="module")
def compound(spark):
    """A house with a room in which Bo is, Ada outside, and a column with a dot in its name."""
    nodes = [
        {"data": {"id": "ada", "tag": "red", "size": 1, "odd.name": 1, "blank": "", "list": ["p", "q"]}, "classes": "k1 k2", "selected": True},
        {"data": {"id": "bo", "tag": "tan", "parent": "room", "size": 2, "box": {"lid": "oak"}}, "classes": "k1", "selectable": False},
        {"data": {"id": "room", "parent": "house", "size": 3}, "classes": "k2", "locked": True},
        {"data": {"id": "house"}},
        {"data": {"id": "x.y"}},
    ]
    edges = [{"data": {"id": "meet", "source": "ada", "target": "bo", "size": 1, "tag": ""}, "classes": "k2"}, {"data": {"id": "self", "source": "room", "target": "room"}}]
    return elements.from_records(spark, nodes, edges)


CASES = {
    "node": "ada bo room house x.y", "edge": "meet self", "#ada, #bo": "ada bo", ".k1.k2": "ada", "#x.y": "x.y", ":visible": "ada bo room house x.y meet self",
    "[size]": "ada bo room meet", "[?tag]": "ada bo", "node[!tag]": "room house x.y", "[^tag]": "room house x.y self",
    '[tag = "red"]': "ada", '[tag != "red"]': "bo room house x.y meet self", '[tag > "red"]': "bo", '[tag @= "RED"]': "ada",
    "[size !< 2]": "bo room", '[blank = ""]': "ada", '[list.0 = "p"]': "ada", '[box.lid = "oak"]': "bo", "[odd\\.name = 1]": "ada",
    "[[degree = 1]]": "ada bo", "[[indegree = 1]]": "bo room", ":selected": "ada", ":unselectable": "bo", ":locked": "room", ":parent": "room house",
    ":childless": "ada bo x.y", ":child": "bo room", ":orphan": "ada house x.y", ":compound": "room house self", "#room > node": "bo", "$node node": "room house",
    "node > $node > node": "room", "$node > node > node": "house", "node node node": "bo", ":loop": "self", ":simple": "meet",
    "node -> node": "meet self", "[size = 1] -> node": "meet", "node <-> #ada": "meet", "#bo <-> $node": "ada", "$node -> #bo": "ada", "#ada -> $node": "bo",
}


def test_selectors(compound):
    found = {text: {r["id"] for r in compound.elements(text).ids().collect()} for text in CASES}
    assert found == {text: set(ids.split()) for text, ids in CASES.items()}


def test_selector_errors_and_text():
    for bad in ("nod e[", "a -> b -> c", "node > a -> b", "$node > $node", "[", "node["):
        with pytest.raises(selector.SelectorError):
            selector.parse(bad)
    assert selector.to_text(selector.parse("node.a[w>2] , $node > edge")) == "node.a[w > 2], $node > edge"


def test_integrity(spark):
    one = [{"id": "a"}, {"id": "b", "parent": "gone"}, {"id": "a", "parent": "b"}]
    g = elements.from_records(spark, one, [{"id": "e", "source": "a", "target": "b"}])
    assert [tuple(r) for r in g.nodes.select("id", "parent").orderBy("id").collect()] == [("a", None), ("b", None)]
    with pytest.raises(elements.IntegrityError):
        elements.from_records(spark, [{"id": "a"}], [{"id": "e", "source": "a", "target": "nowhere"}])
    ring = [{"id": "x", "parent": "y"}, {"id": "y", "parent": "z"}, {"id": "z", "parent": "x"}, {"id": "w", "parent": "x"}]
    g = elements.from_records(spark, ring, [{"id": "e", "source": "x", "target": "y"}])
    assert {r["id"]: r["parent"] for r in g.nodes.collect()} == {"x": "y", "y": "z", "z": None, "w": "x"}


def test_changes(compound):
    gone = mutate.remove(compound.elements("#house"))
    assert {r["id"] for r in gone.elements().ids().collect()} == {"ada", "x.y"}
    moved = mutate.move(compound.elements("#house"), parent="bo")
    assert moved.nodes.where("id = 'house'").first()["parent"] is None  # it would be its own ancestor
    assert {r["id"] for r in traverse.descendants(compound.elements("#house")).nodes.collect()} == {"room", "bo"}
    chosen = mutate.switch(compound.elements("node"), "select")
    assert {r["id"] for r in chosen.elements(":selected").ids().collect()} == {"ada", "room", "house", "x.y"}


def weighted(spark, nodes, edges):
    n = spark.createDataFrame([(v, i) for i, v in enumerate(nodes)], "id string, ord long")
    e = spark.createDataFrame([(f"{s}{t}{i}", s, t, float(w), i) for i, (s, t, w) in enumerate(edges)], "id string, source string, target string, weight double, ord long")
    return Graph.of(n, e).elements()


def test_negative_cycles(spark):
    """One cycle of weight -1 and its tail, one that adds up to 0, one that isn't reached."""
    edges = [("a", "b", 1), ("b", "c", 2), ("c", "d", -5), ("d", "b", 2), ("d", "e", 1), ("e", "f", 3), ("f", "e", -3), ("x", "y", -1), ("y", "x", -1)]
    c = weighted(spark, "abcdefxy", edges)
    rows = sorted(tuple(r) for r in paths.negative_cycles(c, "a", F.col("weight"), directed=True).collect())
    assert rows == [("b", 0, "b", "bc1"), ("b", 1, "c", "cd2"), ("b", 2, "d", "db3")]
    assert paths.bellman_ford(c, "a", F.col("weight"), directed=True)[1] and not paths.bellman_ford(c, "e", F.col("weight"), directed=True)[1]
    assert paths.negative_cycles(c, "e", F.col("weight"), directed=True).count() == 0
    # there and back over one edge is no cycle
    two = weighted(spark, "ab", [("a", "b", -1)])
    assert not paths.bellman_ford(two, "a", F.col("weight"))[1]


def test_negative_cycles_add_up(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        edges = [(*rng.sample("abcdefgh", 2), rng.randrange(-3, 6)) for _ in range(20)]
        c, of = weighted(spark, "abcdefgh", edges), {f"{s}{t}{i}": (s, t, w) for i, (s, t, w) in enumerate(edges)}
        best = {v: float("inf") for v in "abcdefgh"} | {"a": 0}
        for _ in range(8):
            for s, t, w in edges:
                best[t] = min(best[t], best[s] + w)
        negative = any(best[s] + w < best[t] for s, t, w in edges)
        rows = paths.negative_cycles(c, "a", F.col("weight"), directed=True).collect()
        assert bool(rows) == negative
        for name in {r["cycle"] for r in rows}:
            ring = sorted((r for r in rows if r["cycle"] == name), key=lambda r: r["place"])
            assert [r["place"] for r in ring] == list(range(len(ring))) and ring[0]["id"] == name == min(r["id"] for r in ring)
            assert all(of[r["edge"]][:2] == (r["id"], n["id"]) for r, n in zip(ring, [*ring[1:], ring[0]], strict=True))
            assert sum(of[r["edge"]][2] for r in ring) < 0


def test_all_pairs_and_their_paths(spark):
    import random

    rng = random.Random(4)
    edges = [(*rng.choices("abcdefgh", k=2), rng.randrange(0, 9)) for _ in range(18)]
    c, inf = weighted(spark, "abcdefgh", edges), float("inf")
    d = {(a, b): 0 if a == b else inf for a in "abcdefgh" for b in "abcdefgh"}
    for s, t, w in edges:
        if s != t:
            d[s, t] = min(d[s, t], w)
    for k in "abcdefgh":
        for a, b in d:
            d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    pairs = paths.all_pairs(c, F.col("weight"), directed=True, batch=3)
    assert {(r["a"], r["b"]): r["distance"] for r in pairs.collect()} == {k: v for k, v in d.items() if v < inf}
    weights = {f"{s}{t}{i}": w for i, (s, t, w) in enumerate(edges)}
    for a, b in [("a", "b"), ("c", "h"), ("e", "e"), ("h", "a")]:
        way = paths.pair_path(c, pairs, a, b, F.col("weight"), directed=True)
        assert (way == []) == (d[a, b] == inf)
        if way:
            assert way[0] == a and way[-1] == b and sum(weights[e] for e in way[1::2]) == d[a, b]
    assert paths.a_star(c, "a", "a", F.col("weight"))["distance"] == 0


def test_grid_shapes():
    # fixed values: rows and columns for so many cells in boxes of these sides
    golden = {(1, 100, 100): (1, 1), (2, 100, 100): (2, 1), (3, 100, 100): (2, 2), (5, 100, 100): (3, 2), (6, 100, 100): (3, 2), (7, 100, 100): (3, 3), (8, 100, 100): (3, 3), (9, 100, 100): (3, 3), (10, 100, 100): (4, 3), (12, 100, 100): (4, 3), (13, 100, 100): (4, 4), (20, 100, 100): (5, 4), (6, 200, 100): (2, 3), (8, 200, 100): (2, 4), (10, 300, 100): (2, 5), (25, 1000, 1000): (5, 5), (30, 1000, 1000): (6, 5)}
    found = {k: layouts.grid_shape(*k) for k in golden}
    assert found == golden and all(r * k >= n for (n, _, _), (r, k) in found.items())
    assert layouts.grid_shape(10, 1, 1, rows=3) == (3, 4) and layouts.grid_shape(10, 1, 1, cols=3) == (4, 3) and layouts.grid_shape(10, 1, 1, 2, 2) == (2, 2)


def test_concentric_without_values(spark):
    n = spark.createDataFrame([(str(i), i, None if i % 3 == 0 else float(i % 3)) for i in range(9)], "id string, ord long, score double")
    g = Graph.of(n, n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"), "ord"))
    rows = layouts.run(g.elements(), "concentric", value=F.col("score"), width=1.0, equidistant=True).collect()
    assert {r["id"]: r["ring"] for r in rows} == {str(i): {2: 0, 1: 1, 0: 2}[i % 3] for i in range(9)}
    far = [max(((r["x"] - 500) ** 2 + (r["y"] - 500) ** 2) ** 0.5 for r in rows if r["ring"] == k) for k in range(3)]
    assert far[2] - far[1] == pytest.approx(far[1] - far[0])


def test_cose_keeps_neighbours_near(spark):
    c = weighted(spark, "abcdxyz", [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("x", "y", 1), ("y", "z", 1)])
    at = {r["id"]: (r["x"], r["y"]) for r in layouts.run(c, "cose", seed=2).collect()}
    gap = lambda s, t: ((at[s][0] - at[t][0]) ** 2 + (at[s][1] - at[t][1]) ** 2) ** 0.5
    assert all(10 < gap(s, t) < 400 for s, t in ("ab", "bc", "cd", "xy", "yz"))
    assert gap("a", "d") > max(gap("a", "b"), gap("b", "c"), gap("c", "d")) and gap("x", "z") > gap("x", "y")


def test_markov_equals_dense_matrices(spark):
    import random

    import numpy as np

    rng = random.Random(8)
    names = [f"v{i:02d}" for i in range(14)]
    edges = [(names[i], names[j], rng.randrange(1, 9) / 4) for i in range(14) for j in range(i) if i // 5 == j // 5 or rng.random() < 0.05]
    c = weighted(spark, names, edges)
    m = np.eye(14)
    for s, t, w in edges:
        i, j = names.index(s), names.index(t)
        m[i, j] += w
        m[j, i] += w
    m /= m.sum(axis=0)
    for _ in range(20):
        p = m @ m
        m = p**1.8 / (p**1.8).sum(axis=0)
        if (m.round(4) == p.round(4)).all():
            break
    rows = {frozenset(names[j] for j in np.flatnonzero(r.round(3) > 0)) for r in m if (r.round(3) > 0).any()}
    got = {}
    for r in clustering.markov(c, attributes=[F.col("weight") / 2, F.col("weight") / 2], inflate=1.8).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(v) for v in got.values()} == rows and len(rows) > 1


def test_hierarchical_equals_plain_merging(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(20, 2)).round(3)
    n = spark.createDataFrame([(f"n{i:02d}", i, *map(float, p)) for i, p in enumerate(x)], "id string, ord long, a double, b double")
    c = Graph.of(n, n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"))).elements()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for linkage, join in (("complete", np.max), ("mean", np.mean)):
        parts = [[i] for i in range(20)]
        while len(parts) > 1:
            gap, i, j = min((join(d[np.ix_(p, q)]), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
            if gap >= 1.2:
                break
            parts[i] += parts.pop(j)
        got = {}
        for r in clustering.hierarchical(c, [F.col("a"), F.col("b")], linkage=linkage, threshold=1.2).collect():
            got.setdefault(r["cluster"], set()).add(int(r["id"][1:]))
        assert {frozenset(v) for v in got.values()} == {frozenset(p) for p in parts}
    top = {r["cluster"] for r in clustering.hierarchical(c, [F.col("a"), F.col("b")], linkage="mean", mode="dendrogram", depth=1).collect()}
    assert len(top) == 2


def test_affinity_equals_plain_messages(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(15, 2)).round(2) + np.repeat([[0, 0], [9, 0], [0, 9]], 5, axis=0)
    n = spark.createDataFrame([(f"n{i:02d}", i, *map(float, p)) for i, p in enumerate(x)], "id string, ord long, a double, b double")
    c = Graph.of(n, n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"))).elements()
    s = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(s, np.median(s[~np.eye(15, dtype=bool)]))
    r, a = np.zeros((15, 15)), np.zeros((15, 15))
    for _ in range(300):
        new = np.array([[s[i, k] - max(a[i, j] + s[i, j] for j in range(15) if j != k) for k in range(15)] for i in range(15)])
        r = 0.8 * r + 0.2 * new
        new = np.array([[sum(max(0, r[j, k]) for j in range(15) if j != k) if i == k else min(0, r[k, k] + sum(max(0, r[j, k]) for j in range(15) if j not in (i, k))) for k in range(15)] for i in range(15)])
        a = 0.8 * a + 0.2 * new
    centres = [i for i in range(15) if r[i, i] + a[i, i] > 0]
    parts = {}
    for i in range(15):
        parts.setdefault(i if i in centres else max(centres, key=lambda e: s[i, e]), set()).add(i)
    got = {}
    for row in clustering.affinity(c, [F.col("a"), F.col("b")]).collect():
        got.setdefault(row["cluster"], set()).add(int(row["id"][1:]))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in parts.values()} and len(parts) == 3


def test_medoid_sums_equal_pairs(spark):
    import random

    rng = random.Random(6)
    rows = [(f"m{i}", i, i % 3, float(rng.randrange(6)), float(rng.randrange(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, ord long, cluster int, a0 double, a1 double")
    got = {r["id"]: r["cost"] for r in clustering._manhattan_sums(df, 2).collect()}
    assert got == {i: sum(abs(x - p) + abs(y - q) for *_, d, p, q in rows if d == c) for i, _, c, x, y in rows}


def test_rounds_and_folds(spark, monkeypatch):
    import graphloom.graph as module

    c = weighted(spark, [f"c{i:03d}" for i in range(60)], [(f"c{i:03d}", f"c{i + 1:03d}", 1) for i in range(59)])
    depth = {r["id"]: r["depth"] for r in paths.bfs(c, c.nodes.where("id = 'c000'").select("id")).collect()}
    assert depth == {f"c{i:03d}": i for i in range(60)}  # more rounds than tables are kept
    monkeypatch.setattr(module, "FOLD", 7)
    whole = c.reduce(F.lit(""), lambda a, x: F.concat(a, x), F.substring("id", 4, 1), merge=lambda a, x: F.concat(a, x)).first()["result"]
    assert whole == "0123456789" * 6
    monkeypatch.setattr(module, "ONE_ROW", 10)
    with pytest.raises(ValueError, match="merge"):
        c.reduce(F.lit(""), lambda a, x: F.concat(a, x), F.col("id"))


def test_values_and_extensions(spark):
    from graphloom import extensions
    from graphloom.functions import values as v

    row = spark.createDataFrame([("a", 1.5, 2, True, [1], {"k": 1}, None, float("nan"), " \t")], "s string, d double, i int, b boolean, l array<int>, m map<string,int>, n string, x double, e string")
    tests = {"s": v.is_string, "d": v.is_number, "i": v.is_integer, "b": v.is_bool, "l": v.is_array, "m": v.is_plain_object}
    found = row.select(*[f(F.col(c)).alias(f"{name}_{c}") for name, f in tests.items() for c in row.columns]).first().asDict()
    assert {k for k, x in found.items() if x} == {"s_s", "s_e", "d_d", "d_i", "i_i", "b_b", "l_l", "m_m"}
    assert row.select(v.is_empty_string(F.col("n")) & v.is_empty_string(F.col("e")) & v.is_nonempty_string(F.col("s")) & v.is_object(F.col("l"))).first()[0]
    hashes = row.select(v.hash_numbers(F.array(F.lit(97), F.lit(98))), v.combine_hashes(F.lit(3), F.lit(4)), v.hash_pairs(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).first()
    wrap = lambda h: (h + 2**31) % 2**32 - 2**31
    assert hashes[0] == wrap(wrap(9261 * 65599 + 97) * 65599 + 98) and hashes[1] == 3 * 0x200000 + 4 and hashes[2] == [65599 + 3, 2 * 33 + 4]
    assert v.real_cubic_roots(1, -6, 11, -6) == pytest.approx([1, 2, 3]) and v.real_cubic_roots(1, 0, 0, -8) == pytest.approx([2])
    L = lambda *xs: [F.lit(float(x)) for x in xs]
    assert row.select(v.line_meets_circle(*L(-2, 0, 2, 0, 0, 0, 1))).first()[0] == pytest.approx([0.25, 0.75])
    with pytest.raises(ValueError, match="already"):
        extensions.register("collection", "union", lambda c: c)
    with pytest.raises(ValueError):
        extensions.register("core", "__init__", lambda g: g)
    with pytest.raises(ValueError, match="kind"):
        extensions.register("renderer", "x", lambda g: g)


def test_listeners_and_degree_changes(spark, tmp_path):
    from graphloom.streaming import events

    log = spark.createDataFrame([("tap", "a", 1), ("tap", "b", 2), ("drag", "a", 3)], "type string, target string, ts long")
    seen = []
    e = events.Emitter().add_listener("tap", lambda df: seen.append(df.count())).add_listener("tap drag", lambda df: seen.append(-df.count()), one=True)
    e.emit(log).emit(log).remove_listener("tap").emit(log)
    assert seen == [2, -1, 2]
    assert events.promised(log, "drag tap").first()["target"] == "a" and sorted(r["target"] for r in events.live_ids(spark.createDataFrame([("add", "a", 1), ("remove", "a", 2), ("add", "b", 1)], "type string, target string, ts long")).collect()) == ["b"]
    spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string").write.parquet(str(tmp_path / "in"))
    stream = events.degree_changes(spark.readStream.schema("source string, target string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("degrees_now").outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["id"], r["degree"], r["batch_new"]) for r in spark.table("degrees_now").collect()} == {("a", 1, 1), ("b", 2, 2), ("c", 1, 1)}


def test_deep_hierarchy(spark):
    n = spark.range(70).select(F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("d"), F.col("id") - 1)).alias("parent"), F.col("id").alias("ord"))
    e = n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"), "ord")
    found = {(r["id"], r["ancestor"], r["depth"]) for r in Graph.of(n, e).closure().collect()}
    assert found == {(f"d{i}", f"d{j}", i - j) for i in range(70) for j in range(i)}
    ring = n.withColumn("parent", F.coalesce("parent", F.lit("d69")))
    with pytest.raises(ValueError, match="own ancestor"):
        Graph.of(ring, e).closure()


def test_concentric_rings(spark):
    """A million and more of distinct values: every node is placed, in the ring that a plain loop gives."""
    many = 1_000_500
    n = spark.range(many).select(F.col("id").cast("string"), F.lit(None).cast("string").alias("parent"), F.col("id").alias("ord"), F.col("id").cast("double").alias("score"))
    g = Graph.of(n, n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"), "ord"))
    placed = layouts.run(g.elements(), "concentric", value=F.col("score"), width=100_000.0)
    assert {r["ring"]: r["count"] for r in placed.groupBy("ring").count().collect()} == {**dict.fromkeys(range(10), 100_000), 10: 500}
    assert placed.where((F.col("id").cast("long") <= many - 1 - 100_000) != (F.col("ring") > 0)).isEmpty()


def test_euler_and_biconnected(spark):
    e = [("x", "a", "b"), ("y", "b", "c"), ("z", "c", "a"), ("u", "c", "d")]
    n = spark.createDataFrame([(v, i) for i, v in enumerate("abcdq")], "id string, ord long")
    g = Graph.of(n, spark.createDataFrame([(*x, i) for i, x in enumerate(e)], "id string, source string, target string, ord long"))
    trail = [r["id"] for r in kernels.euler_trail(g.elements()).orderBy("place").collect()]
    assert sorted(trail[1::2]) == list("uxyz") and {trail[0], trail[-1]} == {"c", "d"}
    rows = kernels.biconnected(g.elements()).collect()
    assert {r["id"] for r in rows if r["cut"]} == {"c"} and len({r["part"] for r in rows}) == 3
