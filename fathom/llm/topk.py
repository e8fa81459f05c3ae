"""Exact top-k inner products by Fagin's threshold algorithm.

Rows are dealt by a hash of their id to slabs, queries to blocks, both of a bounded number of
components, and each pair of a block and a slab is one group: its size is bounded whatever
the table's. Within a group every dimension has a list of the slab's rows sorted by
component. A query reads its lists in parallel from the end that its component's sign
prefers, scores each row when it is first seen, and stops once the bound on unseen rows, its
product with the components last read, is below its kth score. Each query meets one slab
first; its kth score there is where it starts from in the others, which return only rows that
reach it. The best k of all these are the result.

Vectors that are null or empty or hold a null or non-finite component, and rows whose id is
null, take no part. Vectors of different lengths aren't compared. Ties go to the smaller id.
Where ids repeat, a pair of ids has the best score of its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Components of a slab's rows and of a block's queries, at most; and the fewest rows of a slab
#: that a table is dealt into for the sake of its tasks.
SLAB, BLOCK, LEAST = 1 << 21, 1 << 21, 2048
FIRST_DEPTH = 32


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as long; null unless all are finite numbers."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class Lists:
    """A slab's rows and their sorted lists: ids (n), rows (n, d) int64."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.rising = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.most = float(np.abs(self.rows.astype(float)).max(initial=0))
        self.floats = np.ascontiguousarray(self.rows.astype(np.float64))

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of id `own`, or of those that reach the floor.

        Rows read are counted in self.read.
        """
        n = len(self.ids)
        dims = np.flatnonzero(query)
        up = dims[query[dims] < 0]  # the least components are the best
        down = dims[query[dims] > 0]
        exact = self.most * float(np.abs(query.astype(float)).sum()) < 2**53
        seen = self.ids == own
        best_ids, best = np.zeros(0, self.ids.dtype), np.zeros(0, np.int64)
        at, depth = 0, FIRST_DEPTH
        self.read = 0
        while at < n:
            to = min(n, at + depth)
            if len(dims):
                met = np.zeros(n, bool)
                met[self.rising[at:to, up].ravel()] = True
                met[self.rising[n - to : n - at, down].ravel()] = True
                new = np.flatnonzero(met & ~seen)
                low = (query[up] * self.rows[self.rising[to - 1, up], up]).sum() + (query[down] * self.rows[self.rising[n - to, down], down]).sum()
            else:  # every score is 0
                new, low, to = np.flatnonzero(~seen), 0, n
            seen[new] = True
            self.read += len(new)
            score = (self.floats[new] @ query.astype(np.float64)).astype(np.int64) if exact else self.rows[new] @ query
            least = best[-1] if len(best) == k else floor
            if least is not None:
                better = score >= least
                new, score = new[better], score[better]
            ids, score = np.concatenate([best_ids, self.ids[new]]), np.concatenate([best, score])
            order = np.lexsort((ids, -score))[:k]
            best_ids, best = ids[order], score[order]
            at, depth = to, depth * 2
            least = best[-1] if len(best) == k else floor
            if least is not None and low < least:
                break
        return best_ids, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int, slab: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows but its own id's.

    rows(vec_id, vector array<long>) and queries(query_id, vector) hold integer vectors. slab
    and block are numbers of rows and queries, by default so many as SLAB and BLOCK say.
    """
    rows = rows.where("vec_id is not null and vector is not null and size(vector) > 0").select("vec_id", "vector", F.size("vector").alias("d"))
    queries = queries.where("query_id is not null and vector is not null and size(vector) > 0").select("query_id", "vector", F.size("vector").alias("d"))
    n, wide = rows.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(1))).first()
    asked = queries.count()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    slabs = -(-n // slab) if slab else max(-(-n * wide // SLAB), min(tasks, -(-n // LEAST)))
    blocks = -(-asked // block) if block else -(-asked * wide // BLOCK)
    slabs, blocks = max(1, slabs), max(1, blocks)
    dealt = lambda id_col, n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    home = F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(slabs)).cast("int")
    placed = rows.withColumn("slab", dealt("vec_id", slabs))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            lists = Lists(held.column("vec_id").to_numpy(), _matrix(held.column("vector")))
            want = 2 * k if len(np.unique(lists.ids)) < len(lists.ids) else k
            for own, query, floor in zip(asked.column("query_id").to_numpy(), _matrix(asked.column("vector")), asked.column("floor").to_pylist(), strict=True):
                ids, score = lists.top(query, own, want, floor)
                while want < len(lists.ids) and len(ids) == want and len(np.unique(ids)) < k:  # repeated ids fill the list
                    want *= 2
                    ids, score = lists.top(query, own, want, floor)
                out.append((np.full(len(ids), own), ids, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))  # columns of their own
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k)

    near = met(queries.select("*", home.alias("slab"), F.lit(None).cast("long").alias("floor")), placed, ["d", "slab"])
    if slabs > 1:
        near = saved(near, "near")
        floors = best(near).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(slabs - 1)), lambda s: s != home)).alias("slab")
        left = queries.join(floors, "query_id", "left").withColumn("block", dealt("query_id", blocks)).select("*", others)
        right = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        near = near.union(met(left, right, ["d", "block", "slab"]))
    return best(near).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
