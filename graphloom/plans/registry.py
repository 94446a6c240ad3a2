"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import graphs

#: Numbers with a point mean doubles in the oracles, not decimals.
DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.']|::)")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SOURCES = {
    "geo": (graphs.geo, graphs.GEO),
    "supply": (graphs.supply, graphs.SUPPLY),
    "trade": (graphs.trade, graphs.TRADE),
    "flows": (graphs.flows, graphs.FLOWS),
    "deals": (graphs.deals, graphs.DEALS),
    "web": (graphs.web, graphs.WEB),
    "vectors": (graphs.vectors, graphs.VECTORS),
}


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None, on: str | None = None, recursive: bool = False) -> None:
    """``on`` names the graph that ``f`` takes in place of (spark, sf_dir); its tables precede the SQL, which may
    begin with further ones (``, name AS (...) SELECT ...``)."""
    if name in QUERIES:
        raise ValueError(f"there is a query {name!r} already")
    QUERIES[name] = f if on is None else lambda spark, sf_dir: f(SOURCES[on][0](spark, sf_dir))
    if sql is not None:
        sql = DECIMAL.sub(r"\1::DOUBLE", sql)
        ORACLES[name] = sql if on is None else f"WITH {'RECURSIVE ' if recursive else ''}{SOURCES[on][1].strip()} {sql}"


def query(name: str, sql: str | None = None, on: str | None = None, recursive: bool = False) -> Callable:
    def wrap(f: Callable) -> Callable:
        register(name, f, sql, on, recursive)
        return f

    return wrap
