"""A spread of registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import catalog, graphs

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["p8_range", "p12_degree_selector", "p21_ancestor_with", "s7_remove_cascade", "s15_sheets", "f2_by_group", "f6_max", "f14_slice", "f24_scratch", "o4_symmetric_difference", "j4_neighborhood", "j7_predecessors", "a1_degree", "g1_visits", "g2_dfs", "g3_dijkstra_deals", "g5_bellman_ford", "g7_kruskal", "g8_karger_stein", "g13_biconnected", "k1_k_means_deals", "k3_fuzzy_c_means", "y1_cascade", "b6_range_join", "b7_nearest", "l3_random", "l4_grid_positions", "l5_circle", "e1_stopped", "e2_bubble", "e4_batches", "e6_degree_stream", "u4_shift", "x_hashes", "x_plane"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(v):
    return round(float(v), 8) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["g9_page_rank_supply", "g9_page_rank_supply_settled"])
def test_page_rank_equals_sql(spark, name):
    test_query_equals_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
def test_components_go_to_their_ends(spark):
    """Some nodes lie up to 38 links from the smallest of their component; rounds that stop before, as those of the SQL do, name them wrongly."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    near = {r[0]: [] for r in con.execute(f"WITH {graphs.GEO} SELECT id FROM gn").fetchall()}
    for a, b in con.execute(f"WITH {graphs.GEO} SELECT source, target FROM ge WHERE weight > 47").fetchall():
        near[a].append(b)
        near[b].append(a)
    name, links = {}, {}
    for first in sorted(near):
        layer, n = [first] * (first not in name), 0
        while layer:
            name |= dict.fromkeys(layer, first)
            links |= dict.fromkeys(layer, n)
            layer, n = list({y for x in layer for y in near[x] if y not in name}), n + 1
    assert max(links.values()) == 38
    rows = catalog.queries()["j13_components_of_part"](spark, LARGER).collect()
    assert len(rows) == len(name) and {r["id"]: r["component"] for r in rows} == name
    sql = dict(con.execute(f"SELECT id, component FROM ({catalog.oracle_sql()['j13_components_of_part']})").fetchall())
    assert all(links[x] > 25 for x in name if sql[x] != name[x])


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_every_event_bubbles(spark):
    """Each event gives a row at its target, at two ancestors and at the core, as its SQL says."""
    rows = catalog.queries()["e2_bubble"](spark, DIR)
    assert rows.count() == 4 * spark.read.parquet(f"{DIR}/events.parquet").count()


def test_k_means_of_whole_embeddings(spark):
    import numpy as np

    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    centres, old = x[:2], None
    while old is None or np.abs(centres - old).max() > 1e-9:
        best = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2)).argmin(axis=1)
        old, centres = centres, np.stack([x[best == j].mean(axis=0) for j in range(2)])
    got = {r["id"]: r["cluster"] for r in catalog.queries()["k1_k_means_embeddings"](spark, DIR).collect()}
    assert x.shape[1] == 64 and got == {f"v{r['vec_id']}": j for r, j in zip(rows, best.tolist(), strict=True)}
