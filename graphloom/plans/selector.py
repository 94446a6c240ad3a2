"""The selector language: parser, canonical text and compilation to filters and semi-joins.

``node.a[weight > 2]:selected`` is an AND of checks; ``,`` is OR; ``A -> B``, ``A <-> B`` match
edges by their ends, ``P > C`` and ``A D`` nodes by the compound hierarchy; ``$`` marks the part of a
relation that is selected.  Text that doesn't parse raises ``SelectorError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from graphloom.graph import Collection, Graph


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Check:
    kind: str  # group, id, class, exist, undefined, truthy, falsy, data, meta, state
    name: str
    op: str = ""
    value: str | float | None = None

    def __str__(self) -> str:
        v = f'"{self.value}"' if isinstance(self.value, str) else f"{self.value:g}" if self.value is not None else ""
        name = re.sub(r"([^\w-])", r"\\\1", self.name) if self.kind != "group" else self.name
        if self.kind in ("data", "exist", "undefined", "truthy", "falsy"):
            name = self.name
        return {
            "group": name, "id": f"#{name}", "class": f".{name}", "exist": f"[{name}]", "undefined": f"[^{name}]", "truthy": f"[?{name}]",
            "falsy": f"[!{name}]", "data": f"[{name} {self.op} {v}]", "meta": f"[[{name} {self.op} {v}]]", "state": f":{self.name}",
        }[self.kind]


@dataclass(frozen=True)
class Term:
    checks: tuple[Check, ...]
    subject: bool = False

    def __str__(self) -> str:
        return ("$" if self.subject else "") + ("".join(map(str, self.checks)) or "*")


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...]
    relations: tuple[str, ...]

    def __str__(self) -> str:
        out = str(self.terms[0])
        for r, t in zip(self.relations, self.terms[1:], strict=True):
            out += f" {r} {t}" if r != " " else f" {t}"
        return out

    @property
    def chosen(self) -> int:
        """Index of the selected term; -1 if it is the edge itself."""
        marked = [i for i, t in enumerate(self.terms) if t.subject]
        if marked:
            return marked[0]
        return -1 if self.relations and "-" in self.relations[0] else len(self.terms) - 1


# Names of states and of graph metadata.
STATES = """selected unselected selectable unselectable locked unlocked visible hidden transparent grabbed free removed inside
grabbable ungrabbable animated unanimated parent childless child orphan nonorphan compound loop simple active inactive
backgrounding nonbackgrounding""".split()
METADATA = ("degree", "indegree", "outdegree")

META = r"""[!"#$%&'()*+,./:;<=>?@\[\]^`{|}~]"""
VARIABLE = rf"(?:[\w.-]|\\{META})+"
CLASS = rf"(?:[\w-]|\\{META})+"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
STRING = r'"(?:\\"|[^"])*"|\'(?:\\\'|[^\'])*\''
OPERATOR = r"@?(?:!=|>=|<=|\$=|\^=|\*=|=|>|<)|!@?(?:>=|<=|\$=|\^=|\*=|>|<)|@!(?:>=|<=|\$=|\^=|\*=|>|<)|!@="
SIMPLE = [
    ("group", re.compile(r"(node|edge|\*)(?![\w-])")),
    ("id", re.compile(rf"#({VARIABLE})")),
    ("class", re.compile(rf"\.({CLASS})")),
    ("meta", re.compile(rf"\[\[\s*({'|'.join(METADATA)})\s*({OPERATOR})\s*({NUMBER})\s*\]\]")),
    ("data", re.compile(rf"\[\s*({VARIABLE})\s*({OPERATOR})\s*({STRING}|{NUMBER})\s*\]")),
    ("bool", re.compile(rf"\[\s*([?!^])\s*({VARIABLE})\s*\]")),
    ("exist", re.compile(rf"\[\s*({VARIABLE})\s*\]")),
    ("state", re.compile(":(" + "|".join(sorted(STATES, reverse=True)) + r")(?![\w-])")),
]
RELATION = re.compile(r"\s+(<->|->|>)\s+|(\s+)")


def _plain(name: str) -> str:
    return re.sub(rf"\\({META})", r"\1", name)


@lru_cache(maxsize=1024)
def parse(text: str) -> tuple[Query, ...]:
    queries, at, text = [], 0, text.strip()
    terms: list[Term] = []
    relations: list[str] = []
    while True:
        subject = text.startswith("$", at)
        at += subject
        checks: list[Check] = []
        while at < len(text):
            for kind, pattern in SIMPLE:
                m = pattern.match(text, at)
                if m and not (kind == "group" and checks):
                    break
            else:
                break
            at = m.end()
            if kind in ("data", "meta"):
                raw = m[3]
                value = raw[1:-1].replace("\\" + raw[0], raw[0]) if raw[0] in "\"'" else float(raw)
                checks.append(Check(kind, m[1], m[2].replace(" ", ""), value))
            elif kind == "bool":
                checks.append(Check({"?": "truthy", "!": "falsy", "^": "undefined"}[m[1]], m[2]))
            else:
                checks.append(Check(kind, _plain(m[1]) if kind in ("id", "class") else m[1]))
        if not checks:
            raise SelectorError(f"cannot read {text!r} at {text[at:]!r}")
        terms.append(Term(tuple(checks), subject))
        comma = re.compile(r"\s*,\s*").match(text, at)
        relation = None if comma else RELATION.match(text, at)
        if comma or at == len(text):
            queries.append(_checked(Query(tuple(terms), tuple(relations)), text))
            terms, relations = [], []
            if not comma:
                return tuple(queries)
            at = comma.end()
        elif relation:
            relations.append(relation[1] or " ")
            at = relation.end()
        else:
            raise SelectorError(f"cannot read {text!r} at {text[at:]!r}")


def _checked(q: Query, text: str) -> Query:
    edge = [r for r in q.relations if "-" in r]
    if len(edge) > 1:
        raise SelectorError(f"{text!r} has more than one edge relation")
    if edge and len(q.relations) > 1:
        raise SelectorError(f"{text!r} mixes edges and the hierarchy")
    if sum(t.subject for t in q.terms) > 1:
        raise SelectorError(f"{text!r} marks more than one subject")
    return q


def to_text(queries: tuple[Query, ...]) -> str:
    return ", ".join(map(str, queries))


# compilation


def field(df: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """The column of a data path: an exact name wins over a path of struct fields and array
    places.  None where the table has no such field."""
    name = _plain(path)
    if name in df.columns:
        return df[f"`{name}`"], df.schema[name].dataType
    parts = [_plain(p) for p in re.split(r"(?<!\\)\.", path)]
    if parts[0] not in df.columns:
        return None
    col, kind = df[f"`{parts[0]}`"], df.schema[parts[0]].dataType
    for p in parts[1:]:
        if isinstance(kind, T.ArrayType) and p.isdigit():
            col, kind = F.get(col, int(p)), kind.elementType
        elif isinstance(kind, T.StructType) and p in kind.names:
            col, kind = col.getField(p), kind[p].dataType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(p)), kind.valueType
        else:
            return None
    return col, kind


def truthy(col: Column, kind: T.DataType) -> Column:
    """0, NaN, '', false and undefined are false, everything else is true."""
    if isinstance(kind, T.BooleanType):
        test = col
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        test = (col != 0) & ~F.isnan(col)
    elif isinstance(kind, T.NumericType):
        test = col != 0
    elif isinstance(kind, T.StringType):
        test = col != ""
    else:
        test = col.isNotNull()
    return F.coalesce(test, F.lit(False))


def _as_number(col: Column, kind: T.DataType) -> Column:
    return col.try_cast("double") if isinstance(kind, T.StringType) else col.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")


def compare(found: tuple[Column, T.DataType] | None, op: str, value: str | float) -> Column:
    """A data or metadata comparison; an undefined field only matches negated equalities and
    negated text tests."""
    negate, fold = "!" in op, "@" in op
    op = op.replace("!", "").replace("@", "")
    inequality = op in (">", ">=", "<", "<=")
    col, kind = found if found is not None else (F.lit(None).cast("string"), T.StringType())
    is_text, is_number = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
    if is_text:
        text = F.coalesce(col, F.lit(""))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):  # whole numbers are written without a point
        text = F.coalesce(F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string")), F.lit(""))
    else:
        text = F.coalesce(col.cast("string"), F.lit("")) if is_number else F.lit("")
    value_text = value if isinstance(value, str) else f"{value:.15g}"
    if fold:
        col, kind, is_text, is_number, text, value = F.lower(text), T.StringType(), True, False, F.lower(text), value_text.lower()
        value_text = value
    literal = F.lit(value_text)
    if op == "*=":
        test = F.contains(text, literal)
    elif op == "^=":
        test = F.startswith(text, literal)
    elif op == "$=":
        test = F.endswith(text, literal)
    elif op == "=":
        same = (is_text and isinstance(value, str)) or (is_number and not isinstance(value, str))
        test = F.coalesce(col == F.lit(value), F.lit(False)) if same else F.lit(False)
    else:
        left, right = (col, F.lit(value)) if is_text and isinstance(value, str) else (_as_number(col, kind), F.lit(value).try_cast("double"))
        test = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
        test = F.coalesce(test & ~F.isnan(left) & ~F.isnan(right) if not (is_text and isinstance(value, str)) else test, F.lit(False))
    if negate:
        test = col.isNotNull() & ~test if inequality else ~test
    return test


def _state(graph: Graph, df: DataFrame, edges: bool, name: str) -> DataFrame:
    """Rows of ``df`` in a state; flags are columns, the hierarchy is a semi- or anti-join."""
    from graphloom.operators import style

    both = {"unselected": "selected", "unselectable": "selectable", "unlocked": "locked", "free": "grabbed", "inside": "removed", "ungrabbable": "grabbable", "inactive": "active"}
    yes = both.get(name, name)
    if yes in both.values():
        col = F.col(yes)
        if yes == "locked" and graph.autolock:
            col = F.lit(True)
        if yes == "grabbable" and (graph.autoungrabify or edges):
            col = ~F.lit(graph.autoungrabify) & F.col("grabbable")
        if yes == "selectable" and graph.autounselectify:
            col = F.lit(False)
        return df.where(col if yes == name else ~col)
    if name in ("animated", "backgrounding"):
        return df.limit(0)
    if name in ("unanimated", "nonbackgrounding"):
        return df
    if name in ("visible", "hidden", "transparent"):
        seen = style.visibility(graph)
        test = {"visible": "visible", "hidden": "not visible", "transparent": "transparent"}[name]
        return _semi_ids(df, seen.where(test).select("id"))
    if name in ("loop", "simple"):
        return df.where("source = target" if name == "loop" else "source <> target") if edges else df.limit(0)
    if edges:
        if name != "compound":
            return df.limit(0)
        p = graph.parents()
        ends = df.select("id", F.explode(F.array("source", "target")).alias("__end")).join(p.withColumnRenamed("id", "__end"), "__end", "left_semi")
        return _semi_ids(df, ends.select("id").distinct())
    if name in ("orphan", "child", "nonorphan"):
        return df.where("parent is null" if name == "orphan" else "parent is not null")
    return _semi_ids(df, graph.parents(), "left_anti" if name == "childless" else "left_semi")


def match_term(graph: Graph, term: Term, df: DataFrame, edges: bool) -> DataFrame:
    tests: list[Column] = []
    later: list[Check] = []
    for c in term.checks:
        if c.kind == "group":
            if c.name != "*" and (c.name == "edge") != edges:
                return df.limit(0)
        elif c.kind == "id":
            tests.append(F.col("id") == c.name)
        elif c.kind == "class":
            tests.append(F.array_contains("classes", c.name))
        elif c.kind in ("exist", "undefined", "truthy", "falsy"):
            found = field(df, c.name)
            if c.kind in ("exist", "undefined"):
                there = found[0].isNotNull() if found else F.lit(False)
                tests.append(there if c.kind == "exist" else ~there)
            else:
                true = truthy(*found) if found else F.lit(False)
                tests.append(true if c.kind == "truthy" else ~true)
        elif c.kind == "data":
            tests.append(compare(field(df, c.name), c.op, c.value))
        else:
            later.append(c)
    if tests:
        df = df.where(reduce(lambda a, b: a & b, tests))
    for c in later:
        if c.kind == "state":
            df = _state(graph, df, edges, c.name)
        elif edges:  # metadata of edges is undefined
            df = df.where(compare(None, c.op, c.value))
        else:
            degree = graph.degrees.select(F.col("id").alias("__i"), F.col(c.name).alias("__m"))
            joined = df.join(degree, df["id"] == F.col("__i"), "left")
            df = joined.where(compare((F.coalesce(F.col("__m"), F.lit(0)), T.LongType()), c.op, c.value)).drop("__i", "__m")
    return df


def _match(graph: Graph, q: Query, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not q.relations:
        return match_term(graph, q.terms[0], nodes, False), match_term(graph, q.terms[0], edges, True)
    none = nodes.limit(0), edges.limit(0)
    part = lambda i: match_term(graph, q.terms[i], graph.nodes, False).select("id")
    from graphloom.graph import _semi

    if "-" in q.relations[0]:
        a, b = part(0), part(1)
        if q.relations[0] == "->":
            fits = _semi(_semi(graph.edges.select("id", "source", "target"), a, "source"), b, "target")
            near, far = "source", "target"
        else:
            fits = _semi(_semi(graph.both_ways, a, "a"), b, "b")
            near, far = "a", "b"
        if q.chosen < 0:
            return none[0], _semi(edges, fits.select("id").distinct())
        return _semi(nodes, fits.select(near if q.chosen == 0 else far).distinct()), none[1]
    # hierarchy: from each end towards the chosen term
    up = graph.nodes.where("parent is not null").select("id", F.col("parent").alias("ancestor"))
    closure = graph.closure() if " " in q.relations else None
    steps = [up if r == ">" else closure for r in q.relations]
    matched = part(0) if q.chosen > 0 else None
    for i in range(q.chosen):
        below = _semi(steps[i], matched, "ancestor").select("id").distinct()
        matched = _semi(part(i + 1), below) if i + 1 < q.chosen else below
    found = match_term(graph, q.terms[q.chosen], nodes, False)
    if matched is not None:
        found = _semi(found, matched)
    last = len(q.terms) - 1
    if q.chosen < last:
        matched = part(last)
        for i in range(last - 1, q.chosen - 1, -1):
            above = _semi(steps[i], matched, "id").select("ancestor").distinct()
            matched = _semi(part(i), above.withColumnRenamed("ancestor", "id")) if i > q.chosen else above
        found = _semi(found, matched)
    return found, none[1]


def apply_selector(text: str, c: Collection) -> Collection:
    """The elements of the collection that match; relations look at the whole graph.

    A selector of plain checks is a filter on the collection's own tables, which Catalyst pushes
    to the scan; alternatives without joins are one filter."""
    found = [_match(c.graph, q, c.nodes, c.edges) for q in parse(text)]
    nodes, edges = found[0]
    if len(found) > 1:
        ids = reduce(DataFrame.union, [n.select("id") for n, _ in found]).distinct(), reduce(DataFrame.union, [e.select("id") for _, e in found]).distinct()
        nodes, edges = _semi_ids(c.nodes, ids[0]), _semi_ids(c.edges, ids[1])
    return c._of(nodes, edges)


def _semi_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose id is among ``ids``; adds and renames nothing, so any column names will do."""
    return df.join(ids.select(F.col("id").alias("__in")), df["id"] == F.col("__in"), how)
