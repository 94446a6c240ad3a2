"""Events as a change log: bubbling, delegation, batching, replay, and incremental degrees.

A log has rows ``type, target, ts`` and any payload.  Every function takes a batch or a streaming
DataFrame unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph

# The model's event types.
TYPES = """add remove move moveout data scratch select unselect lock unlock grabify ungrabify selectify unselectify position class style
layoutstart layoutready layoutstop ready load done destroy pan zoom viewport mount unmount bounds""".split()


def on(log: DataFrame, types: str, graph: Graph | None = None, selector: str | None = None) -> DataFrame:
    """Events of the blank-separated types (``type`` or ``type.namespace``; a log with namespaces has the column
    ``namespace``), of elements that match the selector, if there is one."""
    test: Column | None = None
    for t in types.split():
        name, _, space = t.partition(".")
        one = F.col("type") == name
        if space:
            one = one & (F.col("namespace") == space)
        test = one if test is None else test | one
    out = log.where(test) if test is not None else log.limit(0)
    if graph is not None and selector is not None:
        ids = graph.elements(selector).ids().distinct().withColumnRenamed("id", "target")
        out = out.join(ids, "target", "left_semi")
    return out


def once(log: DataFrame, types: str, per_target: bool = True) -> DataFrame:
    """The first event of each type (and target): as a stream, duplicates of what was passed on are dropped."""
    keys = ["type", "target"] if per_target else ["type"]
    if log.isStreaming:
        return on(log, types).dropDuplicates(keys)
    first = on(log, types).groupBy(*keys).agg(F.min_by(F.struct(*log.columns), "ts").alias("e"))
    return first.select("e.*")


def promised(log: DataFrame, types: str) -> DataFrame:
    """The one event that a promise on the types resolves with: the first of all."""
    first = on(log, types)
    return first.dropDuplicates(["type"]).limit(1) if log.isStreaming else first.orderBy("ts", "type", "target").limit(1)


def bubble(log: DataFrame, graph: Graph, stops: DataFrame | None = None) -> DataFrame:
    """Each event at its target (level 0), at each ancestor, and at last at the core (null).  ``stops`` (``type, at``) are
    elements whose listeners end the way of such events: they are the last that it reaches."""
    from graphloom.operators.iterate import cut

    closure = cut(graph.closure())
    closure = closure.select(F.col("id").alias("target"), F.struct(F.col("depth").alias("level"), F.col("ancestor").alias("at")).alias("s"))
    up = closure.groupBy("target").agg(F.array_sort(F.collect_list("s")).alias("up"))
    joined = log.join(up, "target", "left")
    above = F.coalesce("up", F.array().cast("array<struct<level:int,at:string>>"))
    steps = F.concat(F.array(F.struct(F.lit(0).alias("level"), F.col("target").alias("at"))), above, F.array(F.struct((F.size(above) + 1).alias("level"), F.lit(None).cast("string").alias("at"))))
    if stops is not None:
        at = graph.nodes.select(F.col("id").alias("target"), F.lit(0).alias("level"), F.col("id").alias("at")).unionByName(closure.select("target", "s.*"))
        ends = at.join(stops.select("type", "at").distinct(), "at").groupBy("target", "type").agg(F.min("level").alias("__end"))
        joined = joined.join(ends, ["target", "type"], "left")
        steps = F.filter(steps, lambda s: F.col("__end").isNull() | (s["level"] <= F.col("__end")))
    return joined.withColumn("s", F.explode(steps)).select(*log.columns, "s.level", "s.at")


def batched(log: DataFrame, span: str = "1 second") -> DataFrame:
    """``start, type, target``: of each type and span the distinct targets, as a batch of changes notifies once; a row for
    each, so that no batch has to fit one row."""
    return log.select(F.window("ts", span).alias("w"), "type", "target").select(F.col("w.start").alias("start"), "type", "target").distinct()


def clicks(log: DataFrame, gap: str = "250 milliseconds") -> DataFrame:
    """Runs of events on a target that follow each other within the gap: ``target, start, n``."""
    return log.groupBy(F.session_window("ts", gap).alias("w"), "target").agg(F.count(F.lit(1)).alias("n")).select("target", F.col("w.start").alias("start"), "n")


def replay(log: DataFrame) -> DataFrame:
    """``target, type, value``: the last value of each kind of change (batch)."""
    return log.groupBy("target", "type").agg(F.max_by("value", "ts").alias("value"))


def live_ids(log: DataFrame) -> DataFrame:
    """``target``: elements whose last ``add`` or ``remove`` is an ``add`` (batch)."""
    last = log.where(F.col("type").isin("add", "remove")).groupBy("target").agg(F.max_by("type", F.struct("ts", F.col("type") == "remove")).alias("last"))
    return last.where("last = 'add'").select("target")


def degree_stream(edges: DataFrame) -> DataFrame:
    """``id, degree`` kept up to date over a stream of edges (``source, target``), output mode update; a plain
    aggregate, whose state Spark keeps."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_changes(edges: DataFrame) -> DataFrame:
    """``id, degree, batch_new``: the same as a stateful operator that passes on one row for each touched node
    and micro-batch, for consumers that need to know what is new."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows)
        total = (state.get[0] if state.exists else 0) + n
        state.update((total,))
        yield pd.DataFrame({"id": [key[0]], "degree": [total], "batch_new": [n]})

    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").applyInPandasWithState(update, "id string, degree long, batch_new long", "n long", "update", "NoTimeout")


class Emitter:
    """Driver-side listeners over a log: each gets the events of one micro-batch that it asked for."""

    def __init__(self) -> None:
        self.listeners: list[tuple[str, str | None, Callable[[DataFrame], None], bool]] = []

    def add_listener(self, types: str, callback: Callable[[DataFrame], None], selector: str | None = None, one: bool = False) -> Emitter:
        self.listeners.append((types, selector, callback, one))
        return self

    def remove_listener(self, types: str | None = None, callback: Callable | None = None) -> Emitter:
        keep = lambda x: (types is not None and x[0] != types) or (callback is not None and x[2] is not callback)
        self.listeners = [x for x in self.listeners if keep(x)]
        return self

    def emit(self, batch: DataFrame, graph: Graph | None = None) -> Emitter:
        for entry in list(self.listeners):
            types, selector, callback, one = entry
            found = on(batch, types, graph, selector)
            if one:
                found = found.limit(1)
                if found.isEmpty():
                    continue
                self.listeners.remove(entry)
            callback(found)
        return self

    def attach(self, stream: DataFrame, graph: Graph | None = None, **options):
        """Starts a query that emits every micro-batch."""
        return stream.writeStream.options(**options).foreachBatch(lambda df, _: self.emit(df, graph) and None).start()
