"""Operator 6: nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows by a hash of their
id (and by dimension; vectors of different dimension never meet).  Each shard
builds a tree: a vantage point, the median of the distances to it, and the
nearest and farthest distance on either side.  All queries of a block descend
together; a side is skipped by a query when ``factor`` times the triangle
inequality's lower bound exceeds its k-th best distance so far.  ``factor`` 1
restores exact search, a larger one skips more.  The k best of every shard are
merged.  Distances are Euclidean, on the original vectors, in double precision.

Queries are a stated set (by default the rows whose id is divisible by 100),
in blocks of ``QUERY_BLOCK``, so a task holds one shard and one block.  A query
is never its own neighbour (rows with its id are left out); ties go to the smaller
id.  Vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows with a null id; a query with fewer candidates than k
gets them all, one with none gets no row.  A repeated row is a candidate once
per repeat; a repeated query is answered once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
LEAF = 64
FACTOR = 1.15


class Tree:
    """Vantage-point tree over the rows of ``x`` (float64)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        # The point farthest from the middle tells the others apart best.
        middle = self.x[rows].mean(axis=0)
        point = self.x[rows[np.argmax(((self.x[rows] - middle) ** 2).sum(axis=1))]]
        d = np.sqrt(((self.x[rows] - point) ** 2).sum(axis=1))
        cut = np.median(d)
        near = d <= cut
        if near.all():
            near = d < cut
            if not near.any():                                 # all at one distance: half and half
                near[:len(near) // 2] = True
        sides = [(self._build(rows[m]), d[m].min(), d[m].max()) for m in (near, ~near)]
        return point, sides

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        """Distances and ids of the k nearest rows of each query (inf, -1: none)."""
        best = np.full((len(queries), k), np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, own, best, names, factor)
        return best, names

    def _visit(self, node, active, q, own, best, names, factor):
        if isinstance(node, np.ndarray):
            d = np.sqrt(((q[active][:, None, :] - self.x[node][None, :, :]) ** 2).sum(axis=2))
            ids = np.broadcast_to(self.ids[node], d.shape)
            d = np.where(ids == own[active][:, None], np.inf, d)
            d = np.concatenate([best[active], d], axis=1)
            ids = np.concatenate([names[active], ids], axis=1)
            take = np.lexsort((ids, d), axis=1)[:, :best.shape[1]]
            best[active] = np.take_along_axis(d, take, 1)
            names[active] = np.take_along_axis(ids, take, 1)
            return
        point, sides = node
        d = np.sqrt(((q[active] - point) ** 2).sum(axis=1))
        bounds = [np.maximum(0, np.maximum(d - high, low - d)) for _, low, high in sides]
        first = bounds[0] <= bounds[1]
        for group, order in ((first, (0, 1)), (~first, (1, 0))):
            for s in order:
                slack = 1e-9 * (1 + d[group])                  # rounding of the bound
                go = (bounds[s][group] - slack) * factor <= best[active[group], -1]
                some = active[group][go]
                for i in range(0, len(some), 256):
                    self._visit(sides[s][0], some[i:i + 256], q, own, best, names, factor)


def nearest(vectors: DataFrame, queries=None, k: int = 10, factor: float = FACTOR,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id_col>, score) of the k nearest rows of each query."""
    if factor < 1 or k < 1:
        raise ValueError("factor must be 1 or more, k positive")
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("id").isNotNull() & (F.size("x") > 0)))
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(finite & F.exists("x", lambda v: v != 0)).withColumn("dim", F.size("x"))
    asked = rows.where(F.col("id") % 100 == 0 if queries is None else F.col("id").isin(queries)
                       if isinstance(queries, (list, tuple)) else queries)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = (asked.dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    placed = (rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))

    def search(asked_rows: pd.DataFrame, shard_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked_rows) or not len(shard_rows):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype(
                {"query_id": "int64", "id": "int64", "score": "float64"})
        tree = Tree(np.stack(shard_rows["x"].to_list()), shard_rows["id"].to_numpy(np.int64))
        own = asked_rows["id"].to_numpy(np.int64)
        d, ids = tree.search(np.stack(asked_rows["x"].to_list()), own, k, factor)
        found = np.isfinite(d)
        return pd.DataFrame({"query_id": np.repeat(own, found.sum(axis=1)), "id": ids[found], "score": d[found]})

    key = ["dim", "shard", "block"]
    found = (asked.select("id", "x", *key).groupBy(*key)
             .cogroup(placed.select("id", "x", *key).groupBy(*key))
             .applyInPandas(search, "query_id long, id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
