"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards of at most ``SHARD_ROWS`` rows by a hash of their id. A shard sorts its vectors once along every
dimension. A query walks the lists of its nonzero dimensions from the end that helps it, in growing steps; every
vector met is scored in full, and the walk ends when the sum of the query's products with the values reached, which
no unseen vector can exceed, is below the k-th score. A query meets every shard, and the best of all shards are merged.
Queries are a stated set, sent to the shards in blocks of ``QUERY_ROWS``.

Components become floor(scale * x) in double arithmetic. Vectors that are null or hold null or non-finite components take no
part, neither as queries nor as candidates; shorter vectors count as padded with zeros. Null ids take no part. A query leaves
out the rows with its own id; repeated rows of an id are candidates each, and a repeated query id gives its ranks once per
distinct vector order (the smallest vector is taken). Equal scores go by the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common

K, SCALE, EVERY = 20, 64, 20
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: List entries per dimension that a walk reads first, and the growth of each further step.
FIRST_DEPTH, STEP = 64, 8
#: A step that would meet each row more often than this takes all rows that are left.
MOST_REPEATS = 8


class SortedLists:
    """A shard's vectors, and per dimension their rows in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.largest = float(np.abs(self.vectors.astype(float)).sum(axis=1).max()) if len(ids) else 0.0
        # floats give exact sums below 2^24 and 2^53; beyond that products are taken in integers
        self.narrow = self.vectors.astype(np.float32) if self.largest < 2**24 else None
        self.wide = self.vectors.astype(np.float64) if self.narrow is None else None

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        size = self.largest * float(np.abs(query.astype(float)).max(initial=0))
        if self.narrow is not None and size < 2**24:
            values, query = self.narrow, query.astype(np.float32)
        elif size < 2**53:
            values, query = self.narrow if self.wide is None else self.wide, query.astype(np.float64)
        else:
            return (self.vectors[rows] * query).sum(axis=1)
        many = len(rows) * 4 > len(values)
        return ((values @ query)[rows] if many else values[rows] @ query).astype(np.int64)

    def bound(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """Most that a vector beyond ``depth`` in all lists can score."""
        n = len(self.ids)
        dims = np.concatenate([up, down])
        ends = np.concatenate([self.rows[up, n - depth], self.rows[down, depth - 1]])
        return sum(a * b for a, b in zip(query[dims].tolist(), self.vectors[ends, dims].tolist(), strict=True))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by falling score and rising id."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        unseen = self.ids != query_id
        best_rows, best = np.empty(0, np.int64), np.empty(0, np.int64)
        depth = min(FIRST_DEPTH, n)
        while n:
            if not len(up) + len(down):  # a zero query scores 0 everywhere: the smallest ids win
                fresh, depth = np.flatnonzero(unseen)[:k], n
            elif depth == n:
                fresh = np.flatnonzero(unseen)
            else:
                met = np.zeros(n, bool)
                met[self.rows[up, n - depth:]] = True
                met[self.rows[down, :depth]] = True
                fresh = np.flatnonzero(met & unseen)
            unseen[fresh] = False
            rows, values = np.concatenate([best_rows, fresh]), np.concatenate([best, self.scores(query, fresh)])
            if len(values) > k:
                enough = values >= np.partition(values, len(values) - k)[len(values) - k]
                rows, values = rows[enough], values[enough]
            keep = np.lexsort((self.ids[rows], -values))[:k]
            best_rows, best = rows[keep], values[keep]
            if depth == n or len(best) == k and best[-1] > self.bound(query, up, down, depth):
                break
            # lists that together repeat every row many times are read to their ends
            depth = min(n, depth * STEP) if (len(up) + len(down)) * depth * STEP < MOST_REPEATS * n else n
        return self.ids[best_rows], best


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null if any is null or not finite."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def padded(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, :len(x)] = x
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.count_if("asks").alias("asks")).first()
    shards, width = max(1, math.ceil(size["n"] / shard_rows)), max(size["width"] or 0, 1)
    queries = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    candidates = rows.select("vec_id", "vector", F.lit(False).alias("asks"),
                             F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"))
    asked = queries.select("vec_id", "vector", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    # one task per shard and block of queries: a shard is sent once per block
    blocks = max(1, math.ceil(size["asks"] / QUERY_ROWS))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def work(left: pa.Table) -> pa.Table:
        asks = np.asarray(left["asks"].combine_chunks().to_numpy(zero_copy_only=False))
        ids = left["vec_id"].to_numpy()
        values = padded(left["vector"].combine_chunks(), width)
        lists = SortedLists(ids[~asks], values[~asks])
        found = [lists.top(int(i), q, k) for i, q in zip(ids[asks], values[asks], strict=True)]
        return pa.table({"query_id": pa.array(ids[asks], pa.int64()),
                         "ids": pa.array([x[0] for x in found], pa.list_(pa.int64())),
                         "scores": pa.array([x[1] for x in found], pa.list_(pa.int64()))})

    local = candidates.unionByName(asked).groupBy("shard", "block").applyInArrow(
        work, "query_id long, ids array<long>, scores array<long>")
    pairs = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("negative"), i.alias("vec_id")))
    best = local.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.negative")).alias("score"))


def nearest_vectors(spark, folder: str) -> DataFrame:
    """Query op9: ids divisible by 20 against all other rows."""
    return top_k(common.table(spark, folder, "embeddings"), F.col("vec_id") % EVERY == 0)
