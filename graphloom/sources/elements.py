"""Loading and writing elements: JSON records (flat or grouped), tables, integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Collection, Graph, _semi, normalise
from graphloom.operators.iterate import cut


class IntegrityError(ValueError):
    pass


def _first_of_id(df: DataFrame) -> DataFrame:
    """The first row by ``ord`` of each id."""
    order = Window.partitionBy("id").orderBy("ord")
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def checked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Integrity rules: an empty id raises; later elements with a known id are skipped (nodes
    before edges); an edge without an existing source or target raises; a parent that doesn't
    exist, or that closes a cycle, is dropped."""
    nodes = nodes.withColumn("id", F.when(F.col("id") == "", F.raise_error(F.lit("an id must not be empty"))).otherwise(F.coalesce("id", F.uuid())))
    edges = edges.withColumn("id", F.when(F.col("id") == "", F.raise_error(F.lit("an id must not be empty"))).otherwise(F.coalesce("id", F.uuid())))
    nodes = cut(_first_of_id(nodes))
    edges = cut(_semi(_first_of_id(edges), nodes.select("id"), how="left_anti"))
    ids = nodes.select("id")
    bad = edges.where("source is null or target is null").select("id").union(_semi(edges, ids, "source", "left_anti").select("id")).union(_semi(edges, ids, "target", "left_anti").select("id"))
    first = bad.first()
    if first is not None:
        raise IntegrityError(f"Can not create edge {first['id']} with a missing source or target")
    known = ids.select(F.col("id").alias("parent"), F.lit(True).alias("__known"))
    nodes = nodes.join(known, "parent", "left").withColumn("parent", F.when(F.col("__known"), F.col("parent"))).drop("__known")
    return _without_cycles(nodes), edges


def _without_cycles(nodes: DataFrame) -> DataFrame:
    """Drops the parent of the last inserted node of each cycle: in order of insertion, that is
    the assignment that would have closed it.  A node with one parent lies on at most one cycle, so
    pointer doubling finds the cycles in logarithmic rounds."""
    links = nodes.where("parent is not null").select("id", "parent", "ord")
    if links.isEmpty():
        return nodes
    # a node is on or below a cycle iff it never reaches a root; roots drop out as jumps double
    jump = cut(links.select("id", F.col("parent").alias("to"), F.col("ord").alias("last")))
    for _ in range(64):
        step = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("last").alias("l2"))
        new = cut(jump.join(step, "to").select("id", F.col("next").alias("to"), F.greatest("last", "l2").alias("last")))
        before, after = jump.count(), new.count()
        jump = new
        if after == 0 or (after == before and _ > 0 and 2**_ > after):
            break
    if jump.isEmpty():
        return nodes
    on_cycle = jump.select(F.col("to").alias("id")).distinct()
    looped = links.join(on_cycle, "id", "left_semi").join(jump.select("id", "last"), "id")
    closing = looped.where("ord = last").select("id").withColumn("__drop", F.lit(True))
    return nodes.join(closing, "id", "left").withColumn("parent", F.when(F.col("__drop").isNull(), F.col("parent"))).drop("__drop")


def _flatten(df: DataFrame) -> DataFrame:
    """Element records to columns: data fields, position and classes (text or array)."""
    kinds = dict((f.name, f.dataType) for f in df.schema.fields)
    data = kinds["data"].names
    cols = [F.col("data").getField(n).alias(n) for n in data]
    if "position" in kinds:
        cols += [F.col("position").getField(a).alias(a) for a in ("x", "y") if a in kinds["position"].names]
    if "classes" in kinds:
        text = isinstance(kinds["classes"], T.StringType)
        split = F.filter(F.split(F.coalesce("classes", F.lit("")), r"\s+"), lambda x: x != "") if text else F.coalesce("classes", F.array().cast("array<string>"))
        cols.append(F.array_distinct(split).alias("classes"))
    from graphloom.graph import FLAGS

    cols += [F.col(f) for f in FLAGS if f in kinds]
    return df.select("ord", *cols)


def from_elements(df: DataFrame) -> Graph:
    """A graph of element records ``{group?, data{id, source?, target?, parent?, ...}, position?,
    classes?, flags?}`` in the order of the rows.  The group is inferred from the ends where it is missing."""
    if "ord" not in df.columns:
        df = df.withColumn("ord", F.monotonically_increasing_id())
    names = df.schema["data"].dataType.names
    end = lambda n: F.col("data").getField(n).isNotNull() if n in names else F.lit(False)
    inferred = F.when(end("source") & end("target"), "edges").otherwise("nodes")
    group = F.coalesce("group", inferred) if "group" in df.columns else inferred
    df = df.withColumn("group", F.when(group.isin("nodes", "edges"), group).otherwise(F.raise_error(F.lit("an element is a node or an edge"))))
    nodes = _flatten(df.where("group = 'nodes'"))
    edges = _flatten(df.where("group = 'edges'"))
    nodes = nodes.drop("source", "target")
    edges = (edges if "source" in edges.columns else edges.withColumns({"source": F.lit(None).cast("string"), "target": F.lit(None).cast("string")})).drop("parent", "x", "y")
    return Graph(*checked(normalise(nodes, False), normalise(edges, True)))


def read_json(spark: SparkSession, path: str) -> Graph:
    """Elements from JSON: an array of records, or one object ``{nodes: [...], edges: [...]}``."""
    raw = spark.read.json(path, multiLine=True)
    if "data" in raw.columns:
        return from_elements(raw)
    return from_grouped(raw)


def from_grouped(raw: DataFrame) -> Graph:
    def part(name: str, is_edges: bool) -> DataFrame:
        rows = raw.select(F.posexplode(name).alias("ord", "e")).select("ord", "e.*")
        return normalise(_flatten(rows), is_edges)

    nodes, edges = part("nodes", False), part("edges", True).drop("parent")
    return Graph(*checked(nodes, edges))


def from_records(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """Small graphs from Python records, for tests and examples."""
    import json

    elements = [json.dumps({"group": "nodes", "data": n.get("data", n), **{k: v for k, v in n.items() if k != "data" and "data" in n}}) for n in nodes]
    elements += [json.dumps({"group": "edges", "data": e.get("data", e), **{k: v for k, v in e.items() if k != "data" and "data" in e}}) for e in edges]
    rows = spark.createDataFrame(list(enumerate(elements)), "ord long, j string")
    return from_elements(rows.select("ord", F.from_json("j", _json_schema(elements)).alias("e")).select("ord", "e.*"))


def _json_schema(texts: list[str]) -> T.StructType:
    """The common schema of some JSON texts."""
    import io

    import pyarrow.json
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(pyarrow.json.read_json(io.BytesIO("\n".join(texts).encode())).schema)


def jsons(c: Collection) -> DataFrame:
    """``id, json``: each element in the wire form."""
    from graphloom.graph import FLAGS

    def on(df: DataFrame, group: str) -> DataFrame:
        fixed = {"ord", "classes", "x", "y", *FLAGS}
        data = F.struct(*[F.col(f"`{k}`") for k in df.columns if k not in fixed and not k.startswith("scratch:")])
        parts = [data.alias("data"), F.lit(group).alias("group")]
        if group == "nodes":
            parts.insert(1, F.struct("x", "y").alias("position"))
        parts += [F.col(f) for f in ("removed", "selected", "selectable", "locked", "grabbable", "pannable")]
        return df.select("id", F.to_json(F.struct(*parts, F.array_join("classes", " ").alias("classes"))).alias("json"))

    return on(c.nodes, "nodes").union(on(c.edges, "edges"))


def write_json(g: Graph, path: str) -> None:
    """One element a line, in files that many executors write."""
    jsons(g.elements()).select(F.col("json").alias("value")).write.text(path)


def write_tables(g: Graph, path: str) -> None:
    g.nodes.write.parquet(f"{path}/nodes")
    g.edges.write.parquet(f"{path}/edges")


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
