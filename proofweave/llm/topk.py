"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are whole numbers: floor(scale * component), the component as double. The rows are dealt into blocks; the index of a
block holds, per dimension, its rows in order of their component, equal components being one segment. For a query, a
segment's impact is what it adds to a score above the least that its dimension can add, rounded up to one of LEVELS levels.
Segments are processed level by level from the highest, adding the level to the accumulators of their rows. A row's unseen
dimensions add no more than the next level, nor than the top of their own dimension, which bounds every row's score.
Processing stops when the rows whose bound reaches the k-th best of some exact scores hold fewer components than there are postings left; these possible members are
rescored exactly, and no other row can be among the best.

Queries meet every block of rows, in blocks of queries; each pair of blocks returns at most k rows per query, and the best k
over all blocks remain. Nothing is broadcast.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as followed by zeros; an
empty one has the score zero. Ties go to the smaller id; repeated ids are candidates of their own, but a query is never a
candidate of its own id. Components so large that a score could leave 53 bits raise. Null ids are neither queries nor candidates. Empty
tables: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, cut

SCALE = 256
LEVELS = 20
BLOCK_ROWS = 32_768
QUERY_ROWS = 512


def whole_vectors(vectors: DataFrame, key: str, column: str, scale: int = SCALE) -> DataFrame:
    """(id, v) with v = floor(scale * component) as array<bigint>; rows that take no part are left out."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull()).where(finite).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class ImpactIndex:
    """Postings of one block: per dimension its rows in order of their component, equal components being one segment."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.exact = rows.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.ascontiguousarray(np.take_along_axis(rows, order, 0).T)
        self.order = np.ascontiguousarray(order.T).astype(np.intp)

    def _segments(self, query: np.ndarray, levels: int):
        """(width of a level, highest level, rows, per dimension): postings of a level or above, per dimension."""
        low, high = query * self.values[:, 0], query * self.values[:, -1]
        floor, span = np.minimum(low, high), np.abs(high - low)
        step = max(1, -(-int(span.max(initial=0)) // levels))
        # a posting is of level l or above when it adds more than (l - 1) * step to the least of its dimension
        edge = floor[:, None] + np.arange(levels, dtype=np.int64) * step
        count = np.zeros((len(query), levels + 1), np.int64)
        for d in np.flatnonzero(span):
            q, own = query[d], self.values[d]
            if q > 0:
                count[d, :levels] = len(own) - np.searchsorted(own, edge[d] // q, side="right")
            else:
                count[d, :levels] = np.searchsorted(own, -(-edge[d] // q), side="left")
        return step, -(-span // step), count

    def score(self, members: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; doubles hold them exactly, see ``_pair``."""
        return (self.exact[members] @ query.astype(np.float64)).astype(np.int64)

    def best(self, query: np.ndarray, own_id: int, k: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, postings processed) of the k best rows, ties to the smaller id."""
        n = len(self.ids)
        allowed = self.ids != own_id
        k = min(k, int(allowed.sum()))
        if not k or not len(query):
            members = np.flatnonzero(allowed)
            members = members[np.argsort(self.ids[members], kind="stable")][:k]
            return members, np.zeros(len(members), np.int64), 0
        step, top, count = self._segments(query, levels)
        gained, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least = int(np.minimum(query * self.values[:, 0], query * self.values[:, -1]).sum())
        total, posted, members = int(count[:, 0].sum()), 0, np.flatnonzero(allowed)
        due = 0.0
        for level in range(levels, 0, -1):
            a, z = count[:, level], count[:, level - 1]
            lists = [self.order[d, n - z[d] : n - a[d]] if query[d] > 0 else self.order[d, a[d] : z[d]] for d in np.flatnonzero(z > a)]
            if not lists:
                continue
            hits = np.bincount(np.concatenate(lists), minlength=n)
            gained += hits * (level * step)
            seen += hits
            posted += int((z - a).sum())
            if posted < due:
                continue
            due = posted + total / 8  # a proof is tried that often: it reads all accumulators
            # what is unseen in a dimension adds no more than the next level, nor than the dimension's own top
            next_ = (level - 1) * step
            most = least + gained - seen * next_ + int(np.minimum(top * step, next_).sum())
            likely = np.argpartition(np.where(allowed, most, np.iinfo(np.int64).min), -min(n, 4 * k))[-min(n, 4 * k) :]
            sure = np.sort(self.score(likely[allowed[likely]], query))
            if len(sure) < k:
                continue
            members = np.flatnonzero((most >= sure[-k]) & allowed)
            if len(members) * np.count_nonzero(query) <= total - posted:  # fewer components to rescore than postings left
                break
        score = self.score(members, query)
        order = np.lexsort((self.ids[members], -score))[:k]
        return members[order], score[order], posted


def _pair(group: pa.Table, k: int) -> pa.Table:
    sides = group["side"].to_numpy()
    width = max((len(v) for v in group["v"].to_pylist()), default=0) if len(group) < 2 else int(np.diff(group["v"].combine_chunks().offsets.to_numpy()).max())
    every, ids = _matrix(group["v"], width), group["id"].to_numpy()
    top = int(np.abs(every).max(initial=0))
    if top * top * max(1, width) >= 1 << 53:
        raise OverflowError("components too large for exact scores")
    index, rows = ImpactIndex(ids[sides == 0], every[sides == 0]), []
    for own, query in zip(ids[sides == 1].tolist(), every[sides == 1], strict=True):
        at, score, _ = index.best(query, own, k)
        rows.append((np.full(len(at), own), index.ids[at], score))
    columns = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every row that ``queries`` (of ``key``) names."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = cut(whole_vectors(vectors, key, column))
    asking = whole.select(F.col("id").alias(key), "v").where(queries).select(F.col(key).alias("id"), "v")
    n, m = whole.count(), asking.count()
    row_blocks, query_blocks = n // block_rows + 1, m // query_rows + 1
    spread = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = whole.select("id", "v", F.lit(0).alias("side"), spread(row_blocks).alias("rb")).withColumn("qb", every(query_blocks))
    asked = asking.select("id", "v", F.lit(1).alias("side"), spread(query_blocks).alias("qb")).withColumn("rb", every(row_blocks))
    met = rows.unionByName(asked.select(rows.columns)).groupBy("rb", "qb").applyInArrow(lambda g: _pair(g, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
