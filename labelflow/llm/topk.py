"""Exact top-k inner products by Fagin's threshold algorithm.

A candidate group keeps one list per dimension, sorted by that component. For a query the lists are
read side by side from the end that its component's sign favours. Whoever appears is scored in
full; the components at the present depth bound the score of everyone not seen yet. Reading stops
when that bound is below the k-th score found (at equality a smaller id might still follow).
Depth is read in steps that double, so a step is a few array operations.

The query set meets all rows in blocks: queries and candidates are dealt into groups of bounded
size, every pair of groups is one task's work, and a query's best k of each group are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside a task: behind every other id.
_NO_ID = np.iinfo(np.int64).max
#: A list's depth is told in this many steps.
_STEPS = 256


def usable(vector: Column) -> Column:
    """Neither null nor holding nulls, NaN or infinite components."""
    inf = float("inf")
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                                          | (F.abs(x) == F.lit(inf)))


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """Every component x as floor(scale * x), a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


class Lists:
    """Candidates of one group with their sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")  # scores tie towards the smaller id
        self.ids, n = ids[order], len(ids)
        self.exact = rows[order]
        self.n = n
        top = int(np.abs(self.exact).max(initial=0))
        self.top, self.dims = top, self.exact.shape[1]
        by = np.argsort(self.exact, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.exact, by, axis=0)  # ascending, per dimension
        rank = np.empty((self.dims, n), np.int64)
        np.put_along_axis(rank, by.T, np.arange(n)[None, :], axis=1)
        self.step = -(-n // _STEPS) or 1
        # the step at which a candidate appears in a list read from its low or its high end
        self.low = (rank // self.step).astype(np.uint8)
        self.high = ((n - 1 - rank) // self.step).astype(np.uint8)

    def scores(self, q: np.ndarray, which: np.ndarray | None) -> np.ndarray:
        """Exact scores: in floating point where no sum can leave its exact integers."""
        bound = self.top * int(np.abs(q).max(initial=0)) * max(1, self.dims)
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        name = f"_as_{np.dtype(kind).char}"
        if not hasattr(self, name):
            setattr(self, name, self.exact.astype(kind))
        rows = getattr(self, name)
        if which is None:
            return rows @ q.astype(kind)
        if 2 * len(which) > self.n:
            return (rows @ q.astype(kind))[which]
        return rows[which] @ q.astype(kind)

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than ``own``."""
        lists = np.flatnonzero(q)
        n = self.n
        if not len(lists):  # every score is zero
            first = np.zeros(n, np.uint8)
        else:
            first = np.where((q[lists] > 0)[:, None], self.high[lists], self.low[lists]).min(0)
        allowed = self.ids != own
        found, got, done, depth = np.zeros(0, np.int64), np.zeros(0, object), 0, 1
        while True:
            new = np.flatnonzero((first >= done) & (first < depth) & allowed)
            if len(new):
                s = self.scores(q, new)
                found, got = np.concatenate([found, new]), np.concatenate([got, s]) \
                    if len(got) else s
                if len(found) > k:
                    keep = self._largest(got, found, k)
                    found, got = found[keep], got[keep]
            done, at = depth, depth * self.step
            if at >= n or done >= _STEPS:
                break
            if len(found) == k:
                # the next unseen component of every list, from the end in use
                edge = np.where(q > 0, self.sorted[n - 1 - at], self.sorted[at])
                if int(sum(map(int.__mul__, map(int, edge), map(int, q)))) < got.min():
                    break
            depth = min(_STEPS, depth * 2)
        order = self._largest(got, found, k)
        return found[order], got[order]

    @staticmethod
    def _largest(score: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k largest scores, ties to the smaller index."""
        if len(score) > 4 * k and score.dtype != object:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            some = np.flatnonzero(score >= cut)
            return some[np.lexsort((index[some], -score[some]))][:k]
        if score.dtype == object:
            return np.array(sorted(range(len(score)), key=lambda i: (-score[i], index[i]))[:k],
                            np.int64)
        return np.lexsort((index, -score))[:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id",
          vector_col: str = "vector", group_rows: int = 8192, group_queries: int = 1024
          ) -> DataFrame:
    """``(query_id, rank, <id>, score)``: the k best rows of each query by inner product of integer
    vectors, highest first, ties to the smaller id (null ids last); fewer where there are fewer.

    Rows under a query's own id are not its candidates. Several query rows under one id count as
    one query, the one with the smallest vector. Null vectors take no part; missing components
    of a shorter vector count as zero; empty tables give no rows."""
    nq, n = queries.count(), rows.count()
    qg, cg = -(-nq // group_queries) or 1, -(-n // group_rows) or 1
    one = queries.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min(vector_col).alias("v")) \
        .withColumn("qg", F.pmod(F.xxhash64("id"), F.lit(qg)).cast("int")) \
        .withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(cg - 1))))
    # a running number deals equal rows apart too; a row's group does not change the result
    dealt = rows.where(F.col(vector_col).isNotNull()) \
        .select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"),
                F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cg)).cast("int")
                .alias("cg")) \
        .withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(qg - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, c = _matrix(left.column("v")), _matrix(right.column("v"))
            dims = max(q.shape[1], c.shape[1])
            q, c = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, c))
            ids = right.column("id").fill_null(_NO_ID).to_numpy()
            lists = Lists(ids, c)
            for own, vector in zip(left.column("id").to_pylist(), q):
                at, score = lists.best(vector, own, k)
                out["query_id"] += [own] * len(at)
                out["id"] += [None if i == _NO_ID else i for i in lists.ids[at].tolist()]
                out["score"] += [int(s) for s in score]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "id", "score")])
    found = one.groupBy("cg", "qg").cogroup(dealt.groupBy("cg", "qg")).applyInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
