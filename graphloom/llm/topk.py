"""Operator 7: exact top-k search by aggregation of sorted lists without random access.

Vectors are dealt into blocks of rows.  A block has a list for each dimension, sorted by value; a query reads it from the top
where its own component is positive and from the bottom where it is negative.  All lists are read in step.  A row's
lower bound is what was read of it, plus the worst entries of the lists in which it wasn't met yet; its upper bound takes the entries
next to be read instead.  Rows whose upper bound is under the k-th best lower bound can't qualify any more, and a
query is done when no more than k rows are left.  Only those are looked up, for their final scores in whole numbers.

Lists are read down to a few depths, for a group of queries at once: what they give down to a depth, with the bounds of what is
below, is a matrix, and sums of it are matrix products.  Rows stay where their block is; queries are copied to every block, row by row, and a task holds one block and one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
#: Queries that read a block together.
GROUP = 64
#: Shares of the lists' length down to which they are read before bounds are looked at.
DEPTHS = (0.25, 0.5, 0.75, 0.9, 1.0)
#: Up to these, sums of whole numbers are exact in 32 and in 64 bits.
EXACT32, EXACT64 = float(1 << 24), float(1 << 53)


class SortedLists:
    """One block: integer vectors (rows x dimensions) and the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.whole = ids, x
        n = len(ids)
        order = np.argsort(-x.astype(np.float64), axis=0, kind="stable")  # places by falling value, a column for each list
        self.rank = np.empty((n, x.shape[1]), np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.values = np.take_along_axis(x, order, axis=0)
        self.largest = float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0
        self.depths = sorted({max(1, round(share * n)) for share in DEPTHS} | {n})
        self.known: dict[tuple[int, type], list[np.ndarray]] = {}
        self.read = self.entries = 0

    def _down_to(self, depth: int, kind: type) -> list[np.ndarray]:
        """What is known when all lists are read down to a depth: for rows read from the top, and for those read from the bottom, the
        entry where it was met, and where it wasn't the worst of its list (lower bounds) or the one next to be read (upper bounds)."""
        if (depth, kind) not in self.known:
            x, n = self.whole.astype(kind), len(self.ids)
            values = self.values.astype(kind)
            met, met_below = self.rank < depth, self.rank >= n - depth
            if depth == n:
                self.known[depth, kind] = [x, x]
            else:
                self.known[depth, kind] = [np.where(met, x, values[-1]), np.where(met_below, x, values[0]), np.where(met, x, values[depth]), np.where(met_below, x, values[n - 1 - depth])]
        return self.known[depth, kind]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each query ids and scores of the k best rows but its own: higher score first, then smaller id."""
        n = len(self.ids)
        most = self.largest * np.abs(queries.astype(np.float64)).sum(axis=1)
        slack = np.where(most < EXACT64, 0.0, most * 1e-12)  # what rounding may be off
        kind = np.float32 if most.max(initial=0) < EXACT32 else np.float64
        q = queries.astype(kind)
        up, down = np.maximum(q, 0).T.copy(), np.minimum(q, 0).T.copy()  # dimensions x queries
        mine = [np.flatnonzero(self.ids == i) for i in own]
        active, left, before = np.arange(len(q)), [np.empty(0, np.int64)] * len(q), 0
        self.entries += n * int(np.count_nonzero(q))
        for depth in self.depths:
            self.read += (depth - before) * int(np.count_nonzero(q[active]))
            before = depth
            known = self._down_to(depth, kind)
            low = known[0] @ up + known[1] @ down
            high = low if len(known) == 2 else known[2] @ up + known[3] @ down
            done = []
            for j, query in enumerate(active):
                bounds = low[:, j].copy()
                bounds[mine[query]] = -np.inf
                bar = np.partition(bounds, n - k)[n - k] if n > k else -np.inf
                may = high[:, j] >= bar - slack[query]
                may[mine[query]] = False
                if depth == n or np.count_nonzero(may) <= k:
                    left[query] = np.flatnonzero(may)
                    done.append(j)
            if done:
                keep = np.setdiff1d(np.arange(len(active)), done)
                active, up, down = active[keep], up[:, keep].copy(), down[:, keep].copy()
            if not len(active):
                break
        return [self._resolved(left[j], queries[j], k) for j in range(len(q))]

    def _resolved(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        wide = self.largest * float(np.abs(query.astype(np.float64)).sum()) >= float(1 << 62)
        scores = [int(s) for s in (self.whole[rows].astype(object) @ query.astype(object) if wide else self.whole[rows] @ query)] if len(rows) else []
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in best):
            raise OverflowError("a score is beyond 64 bits")
        return self.ids[rows[best]] if best else np.empty(0, np.int64), [scores[i] for i in best]


def whole_numbers(col: Column, scale: int = 256) -> Column:
    """floor(scale * v) of each component; one beyond 64 bits raises."""
    far = F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")
    return F.transform(col, lambda v: F.when(F.abs(v.cast("double") * scale) < float(1 << 63), F.floor(v.cast("double") * scale).cast("long")).otherwise(far))


def usable(col: Column) -> Column:
    """Not null, and neither null nor non-finite components."""
    odd = F.exists(col, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return col.isNotNull() & ~odd


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of numbers, with zeros behind the shorter ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``queries`` (a condition on columns
    of ``vectors``) holds, the ``k`` other rows with the largest integer inner product, ties to
    the smaller id; all of them if there are fewer.

    Vectors that are null or hold null or non-finite components, and rows without an id, take
    no part.  Shorter vectors count as ending in zeros.  Repeated rows (same id) are one row,
    with the vector that sorts first.  Components and scores are 64-bit numbers; what is beyond raises."""
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = good.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "asks")).alias("r")).select("id", "r.v", "r.asks")
    shape = rows.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    dims, blocks = shape["dims"] or 0, max(1, -(-shape["n"] // block_rows))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("asks"), "id", "v")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asks"), "id", "v")
    # with room, so that hashes of the few numbers seldom bring two blocks to one task
    met = held.unionByName(asked).repartition(4 * blocks, "block").sortWithinPartitions("block", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists = None, None
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for b in batches:
            of, asks, names, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), dims)
            cuts = np.flatnonzero(np.diff(of) | np.diff(asks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if lo == hi:
                    continue
                if of[lo] != block:
                    block, lists, ids, parts = of[lo], None, [], []
                if not asks[lo]:
                    ids.append(names[lo:hi])
                    parts.append(x[lo:hi])
                    continue
                if lists is None and ids:
                    lists = SortedLists(np.concatenate(ids), np.concatenate(parts))
                    ids, parts = [], []
                for at in range(lo, hi if lists is not None else lo, GROUP):
                    to = min(at + GROUP, hi)
                    found = lists.top(x[at:to], names[at:to], k)
                    out = [(q, v, s) for q, (vs, ss) in zip(names[at:to].tolist(), found, strict=True) for v, s in zip(vs.tolist(), ss, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
