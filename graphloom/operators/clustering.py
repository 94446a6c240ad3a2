"""Clustering of nodes by attributes or by topology."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Collection
from graphloom.operators.iterate import cut
from graphloom.operators.paths import inner_edges

# Names of the distances.
DISTANCES = ("euclidean", "squaredEuclidean", "manhattan", "max")
ALIASES = {"squared-euclidean": "squaredEuclidean", "squaredeuclidean": "squaredEuclidean"}
MAX_NODES = 4000


def distance(a: Sequence[Column], b: Sequence[Column], name: str | Callable = "euclidean") -> Column:
    """Distance of two points given as columns of coordinates; an unknown name is euclidean.  A function takes both
    lists of columns and gives a column."""
    if callable(name):
        return name(a, b)
    diffs = [F.abs(x.cast("double") - y.cast("double")) for x, y in zip(a, b, strict=True)]
    name = ALIASES.get(name, name)
    total = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0.0)
    if name == "manhattan":
        return total(diffs)
    if name == "max":
        return F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    squares = total([d * d for d in diffs])
    return squares if name == "squaredEuclidean" else F.sqrt(squares)


def _np_distance(x: np.ndarray, y: np.ndarray, name: str | Callable) -> np.ndarray:
    """The same of all rows of x with all rows of y; a function takes lists of coordinate arrays that fit each other."""
    if callable(name):
        return np.asarray(name([v[:, None] for v in x.T], [v[None, :] for v in y.T]), float)
    d = np.abs(x[:, None, :] - y[None, :, :])
    name = ALIASES.get(name, name)
    if name == "manhattan":
        return d.sum(axis=2)
    if name == "max":
        return d.max(axis=2)
    s = (d * d).sum(axis=2)
    return s if name == "squaredEuclidean" else np.sqrt(s)


def _points(c: Collection, attributes: Sequence[Column]) -> DataFrame:
    return c.nodes.select("id", "ord", *[a.cast("double").alias(f"a{i}") for i, a in enumerate(attributes)])


def _start_centroids(points: DataFrame, k: int, m: int, seed: int) -> list[list[float]]:
    box = points.agg(*[f(f"a{i}").alias(f"{n}{i}") for i in range(m) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    rng = np.random.default_rng(seed)
    return [[float(rng.uniform(box[f"lo{i}"], box[f"hi{i}"])) if box[f"lo{i}"] is not None else 0.0 for i in range(m)] for _ in range(k)]


def _nearest(points: DataFrame, centroids: list[list[float]], name: str | Callable) -> DataFrame:
    """Adds ``cluster``: the centroid with the smallest distance, of equals the first.  Centroids are
    k constants in the expression, so nothing is joined or moved."""
    m = len(centroids[0])
    options = [F.struct(distance([F.col(f"a{i}") for i in range(m)], [F.lit(v) for v in p], name).alias("d"), F.lit(j).alias("j")) for j, p in enumerate(centroids)]
    return points.withColumn("cluster", (F.least(*options) if len(options) > 1 else options[0]).getField("j"))


def k_means(c: Collection, attributes: Sequence[Column], k: int = 2, name: str | Callable = "euclidean", max_iterations: int = 10, sensitivity: float = 1e-4, centroids: list[list[float]] | None = None, seed: int = 1) -> DataFrame:
    """``id, cluster``.  Starts from the given centroids or from random ones in the points' box;
    ends when no coordinate of any centroid moves by more than ``sensitivity``.  A cluster that loses all its
    points keeps its centroid."""
    points = cut(_points(c, attributes))
    m = len(attributes)
    centres = [list(map(float, p)) for p in centroids] if centroids else _start_centroids(points, k, m, seed)
    assigned = _nearest(points, centres, name)
    for _ in range(max_iterations):
        assigned = _nearest(points, centres, name)
        means = {r["cluster"]: [r[f"m{i}"] for i in range(m)] for r in assigned.groupBy("cluster").agg(*[F.avg(f"a{i}").alias(f"m{i}") for i in range(m)]).collect()}  # k rows
        new = [means.get(j, p) for j, p in enumerate(centres)]
        moved = max(abs(a - b) for p, q in zip(centres, new, strict=True) for a, b in zip(p, q, strict=True))
        centres = new
        if moved <= sensitivity:
            break
    return assigned.select("id", "cluster")


def _manhattan_sums(assigned: DataFrame, m: int) -> DataFrame:
    """``cluster, id, ord, cost``: for each row the sum of manhattan distances to all rows of its cluster."""
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"a{i}").alias("v")) for i in range(m)])).alias("__x")
    long = assigned.select("cluster", "id", "ord", axes).select("cluster", "id", "ord", "__x.*")
    counted = long.groupBy("cluster", "axis", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t"))
    below = Window.partitionBy("cluster", "axis").orderBy("v")
    whole = Window.partitionBy("cluster", "axis")
    n, t = F.sum("n").over(below), F.sum("t").over(below)
    sums = counted.select("cluster", "axis", "v", (F.col("v") * n - t + (F.sum("t").over(whole) - t) - F.col("v") * (F.sum("n").over(whole) - n)).alias("s"))
    return long.join(sums, ["cluster", "axis", "v"]).groupBy("cluster", "id", "ord").agg(F.round(F.sum("s"), 9).alias("cost"))


def k_medoids(c: Collection, attributes: Sequence[Column], k: int = 2, name: str | Callable = "euclidean", max_iterations: int = 10, medoids: list[str] | None = None) -> DataFrame:
    """``id, cluster, medoid``.  Nodes go to the nearest medoid by ``name``; a cluster's next medoid is the
    member with the smallest sum of manhattan distances (of equals the first); ends when none changes.

    The sums need no pairs: along one coordinate, the distances from a value to all others follow from how many
    members are below it and what they add up to, so distinct values are counted, ordered and summed up."""
    points = cut(_points(c, attributes))
    m = len(attributes)
    names = [r["id"] for r in points.orderBy("ord").limit(k).collect()] if medoids is None else list(medoids)
    assigned = None
    for _ in range(max_iterations):
        rows = {r["id"]: [r[f"a{i}"] for i in range(m)] for r in points.where(F.col("id").isin(names)).collect()}  # k rows
        assigned = cut(_nearest(points, [rows[n] for n in names], name))
        costs = _manhattan_sums(assigned, m)
        best = {r["cluster"]: r["id"] for r in costs.groupBy("cluster").agg(F.min_by("id", F.struct("cost", "ord")).alias("id")).collect()}  # k rows
        new = [best.get(j, n) for j, n in enumerate(names)]
        if new == names:
            break
        names = new
    table = F.array(*[F.lit(n) for n in names])
    return assigned.select("id", "cluster", F.get(table, F.col("cluster")).alias("medoid"))


def fuzzy_c_means(c: Collection, attributes: Sequence[Column], k: int = 2, name: str | Callable = "euclidean", m: float = 2.0, max_iterations: int = 10, sensitivity: float = 1e-4, seed: int = 1, centroids: list[list[float]] | None = None) -> DataFrame:
    """``id, cluster, membership array<double>``: memberships 1 / sum((d_i / d_k)^(2/(m-1))); a node at
    distance 0 of centroids belongs to those alone; the cluster is the largest membership's."""
    points = cut(_points(c, attributes))
    n = len(attributes)
    centres = centroids or _start_centroids(points, k, n, seed)
    degrees = None
    for _ in range(max_iterations):
        d = F.array(*[distance([F.col(f"a{i}") for i in range(n)], [F.lit(float(v)) for v in p], name) for p in centres])
        power = F.lit(2.0 / (m - 1))
        near = F.transform("d", lambda x: F.when(x == 0, 1.0).otherwise(0.0))
        zero = F.exists("d", lambda x: x == 0)
        share = F.transform("d", lambda x: F.when(x == 0, 0.0).otherwise(F.pow(F.try_divide(F.lit(1.0), x), power)))
        raw = F.when(zero, near).otherwise(share)
        degrees = points.withColumn("d", d).withColumn("raw", raw).withColumn("u", F.transform("raw", lambda x: F.try_divide(x, F.aggregate("raw", F.lit(0.0), lambda a, b: a + b))))
        weights = [F.pow(F.get("u", F.lit(j)), F.lit(m)) for j in range(len(centres))]
        sums = degrees.agg(*[F.sum(weights[j] * F.col(f"a{i}")).alias(f"s{j}_{i}") for j in range(len(centres)) for i in range(n)], *[F.sum(weights[j]).alias(f"w{j}") for j in range(len(centres))]).first()
        new = [[sums[f"s{j}_{i}"] / sums[f"w{j}"] if sums[f"w{j}"] else centres[j][i] for i in range(n)] for j in range(len(centres))]
        moved = max(abs(a - b) for p, q in zip(centres, new, strict=True) for a, b in zip(p, q, strict=True))
        centres = new
        if moved <= sensitivity:
            break
    best = F.array_position("u", F.array_max("u")).cast("int") - 1
    return degrees.select("id", best.alias("cluster"), F.col("u").alias("membership"))


def threshold_clusters(c: Collection, attributes: Sequence[Column], threshold: float, name: str | Callable = "euclidean", cell: float | None = None) -> DataFrame:
    """``id, cluster``: single-linkage clusters at a threshold - components of the pairs nearer than it.

    Points go to grid cells as wide as the threshold in the first two coordinates and meet only those of
    the same and adjacent cells, so far pairs are never formed."""
    points = _points(c, attributes)
    m, wide = len(attributes), cell or threshold
    axes = list(range(min(2, m)))
    cells = points.withColumns({f"c{i}": F.floor(F.col(f"a{i}") / wide) for i in axes})
    near = cells
    for i in axes:
        near = near.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + d for d in (-1, 0, 1)])))
    near = near.select(F.col("id").alias("other"), *[F.col(f"a{i}").alias(f"b{i}") for i in range(m)], *[f"c{i}" for i in axes])
    d = distance([F.col(f"a{i}") for i in range(m)], [F.col(f"b{i}") for i in range(m)], name)
    pairs = cells.join(near, [f"c{i}" for i in axes]).where(F.col("id") < F.col("other")).where(d < threshold)
    from graphloom.graph import Graph
    from graphloom.operators.paths import components

    links = pairs.select(F.concat_ws("|", "id", "other").alias("id"), F.col("id").alias("source"), F.col("other").alias("target"))
    links = cut(links)
    joined = Graph.of(c.nodes.select("id", "ord"), links)
    return components(joined.elements()).withColumnRenamed("component", "cluster")


def _gathered(c: Collection, attributes: Sequence[Column], kernel, schema: str) -> DataFrame:
    """All points in one group, for methods on the full distance matrix; more than ``MAX_NODES`` raise."""

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MAX_NODES:
            raise ValueError(f"{len(rows)} nodes are more than a full matrix is made for ({MAX_NODES})")
        return kernel(rows.sort_values("ord", kind="stable").reset_index(drop=True))

    few = _points(c, attributes).limit(MAX_NODES + 1)
    return few.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(guarded, schema)


def hierarchical(c: Collection, attributes: Sequence[Column], name: str | Callable = "euclidean", linkage: str = "min", threshold: float | None = None, depth: int = 0, mode: str = "threshold") -> DataFrame:
    """``id, cluster``: agglomerative clustering with linkage min (single), max (complete) or mean.  Mode
    ``threshold`` merges while the nearest clusters are nearer than the threshold (none: to one cluster); mode
    ``dendrogram`` merges all and cuts the tree at ``depth`` levels from its root.

    Single linkage at a threshold is ``threshold_clusters``, which needs no matrix."""
    linkage = {"single": "min", "complete": "max"}.get(linkage, linkage)
    if mode == "threshold" and linkage == "min" and threshold is not None and threshold > 0:
        return threshold_clusters(c, attributes, threshold, name)
    m = len(attributes)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[[f"a{i}" for i in range(m)]].to_numpy(float)
        d = _np_distance(x, x, name)
        np.fill_diagonal(d, np.inf)
        trees: dict[int, object] = dict(enumerate(range(len(x))))
        size, alive = np.ones(len(x)), np.ones(len(x), bool)
        stop = np.inf if mode == "dendrogram" or threshold is None else threshold
        while alive.sum() > 1:
            i, j = divmod(int(np.argmin(d)), len(x))
            i, j = min(i, j), max(i, j)
            if not d[i, j] < stop and np.isfinite(stop):
                break
            new = np.minimum(d[i], d[j]) if linkage == "min" else np.where(np.isfinite(d[i]) & np.isfinite(d[j]), np.maximum(d[i], d[j]), np.inf) if linkage == "max" else (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
            d[i], d[:, i] = new, new
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            alive[j] = False
            trees[i] = (trees[i], trees.pop(j))
        label = np.zeros(len(x), int)
        tops = list(trees.values())
        if mode == "dendrogram":
            for _ in range(depth):
                tops = [part for t in tops for part in (t if isinstance(t, tuple) else (t,))]
        for n, t in enumerate(tops):
            todo = [t]
            while todo:
                v = todo.pop()
                if isinstance(v, tuple):
                    todo += v
                else:
                    label[v] = n
        first: dict[int, str] = {}
        for node, n in zip(rows["id"], label, strict=True):
            first[n] = min(first.get(n, node), node)
        return pd.DataFrame({"id": rows["id"], "cluster": [first[n] for n in label]})

    return _gathered(c, attributes, kernel, "id string, cluster string")


def markov(c: Collection, weight: Column | None = None, expand: int = 2, inflate: float = 2.0, mult: float = 1.0, max_iterations: int = 20, prune: float = 0.0, attributes: Sequence[Column] | None = None) -> DataFrame:
    """``id, cluster``: Markov clustering on a sparse matrix of rows (i, j, v): symmetric weights, diagonal set
    to ``mult``, columns normalised; then powers and inflation until four decimals don't change.  An edge's weight is ``weight``
    or the sum of ``attributes``.  Entries under ``prune`` go, which keeps a large matrix sparse and changes results slightly;
    by default only zeros do.  A cluster is the support of a row at three decimals."""
    if attributes:
        weight = sum(attributes[1:], attributes[0])
    e = inner_edges(c, loops=False).select("source", "target", (F.lit(1.0) if weight is None else weight.cast("double")).alias("v"))
    sides = e.select(F.col("source").alias("i"), F.col("target").alias("j"), "v").union(e.select("target", "source", "v"))
    own = c.nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(mult)).alias("v"))

    def normal(df: DataFrame) -> DataFrame:
        total = df.groupBy("j").agg(F.sum("v").alias("t"))
        return df.join(total, "j").select("i", "j", (F.col("v") / F.col("t")).alias("v"))

    state = cut(normal(sides.groupBy("i", "j").agg(F.sum("v").alias("v")).unionByName(own)))
    for _ in range(max_iterations):
        power = state
        for _ in range(expand - 1):
            right = state.select(F.col("i").alias("k"), F.col("j").alias("z"), F.col("v").alias("v2"))
            power = power.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("z").alias("j")).agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
        power = cut(power)
        new = cut(normal(power.select("i", "j", F.pow("v", F.lit(float(inflate))).alias("v"))).where((F.col("v") > 0) & (F.col("v") >= prune)))
        both = new.join(power.withColumnRenamed("v", "old"), ["i", "j"], "full")
        changed = both.where(F.round(F.coalesce("v", F.lit(0.0)), 4) != F.round(F.coalesce("old", F.lit(0.0)), 4))
        state = new
        if changed.isEmpty():
            break
    support = state.where(F.round("v", 3) > 0).select("i", "j")
    # rows with the same support are one cluster; its name is its smallest member
    return support.groupBy("j").agg(F.min("i").alias("i")).join(support.groupBy("i").agg(F.min("j").alias("cluster")), "i").select(F.col("j").alias("id"), "cluster")


def affinity(c: Collection, attributes: Sequence[Column], preference: str | float = "median", damping: float = 0.8, name: str | Callable = "euclidean", max_iterations: int = 1000, min_iterations: int = 100) -> DataFrame:
    """``id, cluster`` (the exemplar's id): affinity propagation on similarities -distance; messages run until
    the exemplars have stayed the same for ``min_iterations`` rounds, then each cluster takes its best exemplar."""
    if not 0.5 <= damping < 1:
        raise ValueError(f"Damping must range on [0.5, 1).  Got: {damping}")
    if isinstance(preference, str) and preference not in ("median", "mean", "min", "max"):
        raise ValueError(f"Preference must be one of median, mean, min, max or a number.  Got: {preference}")
    m = len(attributes)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[[f"a{i}" for i in range(m)]].to_numpy(float)
        exemplar = affinity_exemplars(-_np_distance(x, x, name), preference, damping, max_iterations, min_iterations)
        return pd.DataFrame({"id": rows["id"], "cluster": rows["id"].to_numpy()[exemplar]})

    return _gathered(c, attributes, kernel, "id string, cluster string")


def affinity_exemplars(s: np.ndarray, preference: str | float, damping: float, max_iterations: int, min_iterations: int) -> np.ndarray:
    n = len(s)
    s = s.copy()
    off = s[~np.eye(n, dtype=bool)]
    np.fill_diagonal(s, {"median": np.median, "mean": np.mean, "min": np.min, "max": np.max}[preference](off) if isinstance(preference, str) and n > 1 else 0.0 if isinstance(preference, str) else preference)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    rows, stable, last = np.arange(n), 0, None
    for _ in range(max_iterations):
        t = a + s
        best = t.argmax(axis=1)
        first = t[rows, best].copy()
        t[rows, best] = -np.inf
        second = t.max(axis=1)
        new = s - first[:, None]
        new[rows, best] = s[rows, best] - second
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        total = p.sum(axis=0)
        new = np.minimum(0, total[None, :] - p)
        np.fill_diagonal(new, total - p.diagonal())
        a = damping * a + (1 - damping) * new
        now = (r.diagonal() + a.diagonal()) > 0
        stable = stable + 1 if last is not None and (now == last).all() else 0
        last = now
        if stable >= min_iterations and now.any():
            break
    centres = np.flatnonzero(last) if last is not None and last.any() else np.array([int((r + a).diagonal().argmax())])
    to = centres[s[:, centres].argmax(axis=1)]
    to[centres] = centres
    for e in np.unique(to):
        members = np.flatnonzero(to == e)
        to[members] = members[s[np.ix_(members, members)].sum(axis=0).argmax()]
    return to
