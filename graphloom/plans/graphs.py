"""Graphs over the driver's tables, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions hold nations, nations hold customers and suppliers; an order links its customer with the
    supplier of its first line."""
    none, text = F.lit(None).cast("string"), "string"
    t = lambda n: table(spark, sf_dir, n)
    no_money, no_text = F.lit(None).cast("double"), none.cast(text)

    def part(df: DataFrame, key: str, prefix: str, parent, kind: str, name: str, money, segment, base: int) -> DataFrame:
        return df.select(_id(prefix, key).alias("id"), parent.alias("parent"), F.lit(kind).alias("kind"), F.col(name).alias("name"), money.alias("acctbal"), segment.alias("segment"), (F.col(key).cast("long") + base).alias("ord"))

    n = part(t("region"), "r_regionkey", "r", no_text, "region", "r_name", no_money, no_text, 0)
    n = n.unionByName(part(t("nation"), "n_nationkey", "n", _id("r", "n_regionkey"), "nation", "n_name", no_money, no_text, 1000))
    n = n.unionByName(part(t("customer"), "c_custkey", "c", _id("n", "c_nationkey"), "customer", "c_name", F.col("c_acctbal"), F.col("c_mktsegment"), 1_000_000))
    n = n.unionByName(part(t("supplier"), "s_suppkey", "s", _id("n", "s_nationkey"), "supplier", "s_name", F.col("s_acctbal"), no_text, 1_000_000_000))
    n = n.withColumns({
        "classes": F.when(F.col("segment").isNull(), F.array("kind")).otherwise(F.array("kind", F.lower("segment"))),
        "selected": F.coalesce(F.col("acctbal") > 5000, F.lit(False)),
        "locked": F.coalesce(F.col("acctbal") < 0, F.lit(False)),
        "selectable": F.coalesce(F.col("segment") != "BUILDING", F.lit(True)),
        "x": (F.col("ord") % 97) * 10.0,
        "y": (F.col("ord") % 89) * 10.0,
    })
    first = t("lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))
    e = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    e = e.select(_id("o", "o_orderkey").alias("id"), _id("c", "o_custkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.col("l_quantity").cast("double").alias("weight"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"))
    return Graph.of(n, e)


GEO = """
gn AS (SELECT *, CASE WHEN segment IS NULL THEN [kind] ELSE [kind, lower(segment)] END AS classes, coalesce(acctbal > 5000, false) AS selected,
        coalesce(acctbal < 0, false) AS locked, coalesce(segment <> 'BUILDING', true) AS selectable, (ord % 97) * 10.0::DOUBLE AS x, (ord % 89) * 10.0::DOUBLE AS y
    FROM (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 'region' AS kind, r_name AS name, NULL::DOUBLE AS acctbal, NULL::VARCHAR AS segment, r_regionkey::BIGINT AS ord FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', n_name, NULL, NULL, 1000 + n_nationkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', c_name, c_acctbal, c_mktsegment, 1000000 + c_custkey FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier', s_name, s_acctbal, NULL, 1000000000 + s_suppkey FROM supplier)),
ge AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS source, 's' || l_suppkey AS target, l_quantity::DOUBLE AS weight, o_orderpriority AS priority, o_orderkey AS ord
    FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_orderkey),
gc AS (SELECT id, parent AS ancestor, 1 AS depth FROM gn WHERE parent IS NOT NULL
    UNION ALL SELECT a.id, b.parent, 2 FROM gn a JOIN gn b ON a.parent = b.id WHERE b.parent IS NOT NULL),
gb AS (SELECT source AS a, target AS b, id, ord FROM ge UNION ALL SELECT target, source, id, ord FROM ge WHERE source <> target),
gd AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree FROM (SELECT source AS id, 0 AS i, 1 AS o FROM ge UNION ALL SELECT target, 1, 0 FROM ge) GROUP BY id)
"""


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers; every line item is an edge, so there are parallel ones."""
    t = lambda n: table(spark, sf_dir, n)
    p = t("part").select(_id("p", "p_partkey").alias("id"), F.array(F.lit("part")).alias("classes"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_partkey").cast("long").alias("ord"))
    s = t("supplier").select(_id("s", "s_suppkey").alias("id"), F.array(F.lit("supplier")).alias("classes"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("price"), (F.col("s_suppkey").cast("long") + 1_000_000_000).alias("ord"))
    li = t("lineitem")
    e = li.select(F.concat_ws("-", _id("l", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").alias("id"), _id("p", "l_partkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.col("l_quantity").cast("double").alias("weight"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"))
    return Graph.of(p.unionByName(s), e)


SUPPLY = """
pn AS (SELECT 'p' || p_partkey AS id, 'part' AS kind, p_size::DOUBLE AS size, p_retailprice AS price, p_partkey::BIGINT AS ord FROM part
    UNION ALL SELECT 's' || s_suppkey, 'supplier', NULL, NULL, s_suppkey + 1000000000 FROM supplier),
pe AS (SELECT concat_ws('-', 'l' || l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_quantity::DOUBLE AS weight, l_orderkey * 16 + l_linenumber AS ord FROM lineitem)
"""


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; each has edges to its three main partners, the nations whose suppliers sell most to its customers."""
    return _nations(spark, sf_dir, F.col("rk") <= 3)


def flows(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; each has an edge to every nation whose suppliers sell to its customers."""
    return _nations(spark, sf_dir, F.lit(True))


def _nations(spark: SparkSession, sf_dir: str, which: Column) -> Graph:
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("s")), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("t")), F.col("l_suppkey") == F.col("s_suppkey"))
    flows = sold.groupBy("s", "t").agg(F.sum("l_extendedprice").alias("revenue"))
    top = flows.withColumn("rk", F.row_number().over(Window.partitionBy("s").orderBy(F.col("revenue").desc(), "t"))).where(which)
    weight = F.col("rk") + (F.col("s") * 7 + F.col("t") * 3) % 5 / 4.0
    e = top.select(F.concat(_id("t", "s"), F.lit("-"), F.col("rk").cast("string")).alias("id"), _id("n", "s").alias("source"), _id("n", "t").alias("target"), weight.cast("double").alias("weight"), (F.col("s") * 100 + F.col("rk")).cast("long").alias("ord"))
    n = t("nation").select(_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"), (F.col("n_nationkey") % 7).cast("double").alias("u"), (F.col("n_nationkey") % 5 * 2).cast("double").alias("v"))
    return Graph.of(n, e)


TRADE = """
tn AS (SELECT 'n' || n_nationkey AS id, n_name AS name, n_nationkey::BIGINT AS ord, (n_nationkey % 7)::DOUBLE AS u, (n_nationkey % 5 * 2)::DOUBLE AS v FROM nation),
te AS MATERIALIZED (SELECT 't' || s || '-' || rk AS id, 'n' || s AS source, 'n' || t AS target, (rk + ((s * 7 + t * 3) % 5) / 4.0)::DOUBLE AS weight, s * 100 + rk AS ord
    FROM (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY revenue DESC, t) AS rk
        FROM (SELECT c_nationkey AS s, s_nationkey AS t, sum(l_extendedprice) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2))
    WHERE rk <= 3),
ta AS MATERIALIZED (SELECT source AS a, target AS b, id, ord, weight AS w FROM te WHERE source <> target),
tb AS MATERIALIZED (SELECT * FROM ta UNION ALL SELECT b, a, id, ord, w FROM ta)
"""


FLOWS = TRADE.replace("    WHERE rk <= 3", "    ")


def deals(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers; every line item of an order is an edge from its customer to its supplier."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").select(_id("c", "c_custkey").alias("id"), F.array(F.lit("customer")).alias("classes"), F.col("c_acctbal").alias("acctbal"), (F.col("c_nationkey") * 10.0).alias("place"), F.col("c_custkey").cast("long").alias("ord"))
    s = t("supplier").select(_id("s", "s_suppkey").alias("id"), F.array(F.lit("supplier")).alias("classes"), F.col("s_acctbal").alias("acctbal"), (F.col("s_nationkey") * 10.0).alias("place"), (F.col("s_suppkey").cast("long") + 1_000_000_000).alias("ord"))
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = li.select(F.concat_ws("-", _id("d", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").alias("id"), _id("c", "o_custkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.col("l_quantity").cast("double").alias("weight"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"))
    return Graph.of(c.unionByName(s), e)


DEALS = """
dn AS MATERIALIZED (SELECT 'c' || c_custkey AS id, 'customer' AS kind, c_acctbal AS acctbal, c_nationkey * 10.0::DOUBLE AS place, c_custkey::BIGINT AS ord FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'supplier', s_acctbal, s_nationkey * 10.0::DOUBLE, s_suppkey + 1000000000 FROM supplier),
de AS MATERIALIZED (SELECT concat_ws('-', 'd' || l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 'c' || o_custkey AS source, 's' || l_suppkey AS target, l_quantity::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
db AS MATERIALIZED (SELECT a, b, min(w) AS w FROM (SELECT source AS a, target AS b, weight AS w FROM de UNION ALL SELECT target, source, weight FROM de) GROUP BY 1, 2)
"""


def web(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and the paths that they link to."""
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "path"))
    n = links.select(_id("page", "page_id").alias("id")).union(links.select(F.concat(F.lit("path:"), "path"))).distinct()
    e = links.select(F.concat(_id("a", "page_id"), F.lit("-"), F.col("pos").cast("string")).alias("id"), _id("page", "page_id").alias("source"), F.concat(F.lit("path:"), "path").alias("target"), (F.col("page_id") * 10_000 + F.col("pos")).alias("ord"))
    return Graph.of(n.withColumn("ord", F.xxhash64("id")), e)


WEB = """
wl AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS path, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
we AS MATERIALIZED (SELECT 'a' || page_id || '-' || pos AS id, 'page' || page_id AS source, 'path:' || path AS target FROM wl),
wn AS MATERIALIZED (SELECT DISTINCT unnest([source, target]) AS id FROM we)
"""


def vectors(spark: SparkSession, sf_dir: str, dims: int = 2) -> Graph:
    """Embeddings as nodes with their first coordinates; no edges."""
    n = table(spark, sf_dir, "embeddings").select(_id("v", "vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"a{i}") for i in range(dims)])
    e = n.limit(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"), "ord")
    return Graph.of(n, e)


VECTORS = "vn AS (SELECT 'v' || vec_id AS id, vec_id AS ord, embedding[1]::DOUBLE AS a0, embedding[2]::DOUBLE AS a1 FROM embeddings)"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of events for the event operators: ``type, target, ts, value``."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), _id("u", "user_id").alias("target"), "ts", "value", "event_id")
