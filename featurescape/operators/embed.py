"""Neighbour graph and neighbour embeddings (POS-6, POS-4, POS-5).

``knn_graph`` is exact; its partition is in :mod:`featurescape.operators.knn`.

The embeddings re-aim single-machine UMAP / t-SNE solvers as DataFrame
iterations (structural parity only: the reference's coordinates come from
seeded third-party solvers and cannot be reproduced):

* affinities per source from its k distances (bounded lists), bandwidth by
  bisection: in ``aggregate`` for UMAP, for t-SNE's longer lists in NumPy, all
  sources of a batch at once;
* symmetrisation by a full outer join of (src, dst) with (dst, src);
* layout: start from PCA, then rounds of each method's own forces
  (:mod:`featurescape.operators.layout`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.operators.ids import with_global_index
from featurescape.operators.knn import knn_tables
from featurescape.operators.layout import levels_for, tsne_layout, umap_layout
from featurescape.operators.positions import pca_positions
from featurescape.session import materialize

DEFAULT_K = 15


def _vectors(df: DataFrame, id_col: str, vec_col: str | None, cols: list[str] | None) -> DataFrame:
    if vec_col is not None:
        v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    else:
        v = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])
    return df.select(F.col(id_col).cast("string").alias("id"), v.alias("v"))


def knn_graph(df: DataFrame, k: int = DEFAULT_K, id_col: str = "ID", vec_col: str | None = None,
              cols: list[str] | None = None, seed: int = 42, chunk_rows: int | None = None,
              cells: int | None = None) -> DataFrame:
    """POS-6: exact k nearest neighbours ``(src, dst, rank, dist)``, rank
    1..k, ties broken by ``dst`` id; an item is not its own neighbour (see
    :mod:`featurescape.operators.knn`)."""
    return knn_tables(_vectors(df, id_col, vec_col, cols), k, seed, chunk_rows, cells)[0]


def _bisect(score, target, iters: int = 32):
    """Bandwidth sigma in [1e-6, 1e6] by geometric bisection such that
    ``score(sigma)`` (increasing in sigma) meets ``target``; ``score`` builds
    a Column over the row's bounded neighbour list."""
    init = F.struct(F.lit(1e-6).alias("lo"), F.lit(1e6).alias("hi"))
    res = F.aggregate(
        F.sequence(F.lit(1), F.lit(iters)), init,
        lambda st, _: F.when(score(F.sqrt(st["lo"] * st["hi"])) > target,
                             F.struct(st["lo"].alias("lo"), F.sqrt(st["lo"] * st["hi"]).alias("hi")))
                      .otherwise(F.struct(F.sqrt(st["lo"] * st["hi"]).alias("lo"), st["hi"].alias("hi"))))
    return F.sqrt(res["lo"] * res["hi"])


def _kernel_sum(entries, kernel):
    return lambda s: F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + kernel(e, s))


def umap_weights(knn: DataFrame, k: int) -> DataFrame:
    """Fuzzy membership per directed edge, then a + b - ab symmetrisation."""
    g = knn.groupBy("src").agg(F.collect_list(F.struct("dst", "dist")).alias("e"))   # k entries
    rho = F.array_min(F.filter(F.transform("e", lambda e: e["dist"]), lambda d: d > 0))
    g = g.withColumn("rho", F.coalesce(rho, F.lit(0.0)))
    target = math.log2(k)
    sigma = _bisect(_kernel_sum(F.col("e"), lambda e, s: F.exp(-F.greatest(e["dist"] - F.col("rho"),
                                                                          F.lit(0.0)) / s)),
                    F.lit(target))
    g = g.withColumn("sigma", sigma)
    edges = g.select("src", "rho", "sigma", F.explode("e").alias("e")).select(
        "src", F.col("e.dst").alias("dst"),
        F.exp(-F.greatest(F.col("e.dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w"))
    return _symmetrise(edges, lambda a, b: a + b - a * b)


def _conditional(perplexity: float, iters: int = 32):
    """(src, dst, w) of rows (src, e): conditional affinities of every source's list, the
    bandwidths of a batch bisected together (as in :func:`_bisect`)."""
    target = math.log(perplexity)

    def run(batches):
        for batch in batches:
            lists, src = batch.column(1), batch.column(0)
            if not len(src):
                continue
            entry = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            first = np.cumsum(size) - size                     # no list is empty
            d2 = entry.field("dist").to_numpy(zero_copy_only=False).astype(float) ** 2
            lo, hi = np.full(len(src), 1e-6), np.full(len(src), 1e6)
            with np.errstate(all="ignore"):
                for _ in range(iters):
                    s = np.sqrt(lo * hi)
                    two_s2 = 2.0 * s * s
                    p = np.exp(-d2 / np.repeat(two_s2, size))
                    z = np.maximum(np.add.reduceat(p, first), 1e-300)
                    score = np.log(z) + np.add.reduceat(d2 * p, first) / (two_s2 * z)
                    high = (score > target) | np.isnan(score)  # NaN is the largest number in Spark
                    lo, hi = np.where(high, lo, s), np.where(high, s, hi)
                sigma = np.sqrt(lo * hi)
                p = np.exp(-d2 / np.repeat(2 * sigma ** 2, size))
                w = p / np.repeat(np.maximum(np.add.reduceat(p, first), 1e-300), size)
            yield pa.RecordBatch.from_arrays(
                [src.take(pa.array(np.repeat(np.arange(len(src)), size))), entry.field("dst"), pa.array(w)],
                names=["src", "dst", "w"])
    return run


def tsne_weights(knn: DataFrame, perplexity: float, n: int) -> DataFrame:
    """Gaussian conditional affinities over squared distances with the
    bandwidth calibrated to the perplexity (entropy H = ln Z + beta * sum
    d^2 p equal to ln(perplexity), in nats), then (p + p^T) / 2n."""
    g = knn.groupBy("src").agg(F.collect_list(F.struct("dst", "dist")).alias("e"))   # bounded by k
    kind = dict(knn.dtypes)
    cond = g.mapInArrow(_conditional(perplexity), f"src {kind['src']}, dst {kind['dst']}, w double")
    return _symmetrise(cond, lambda a, b: (a + b) / (2.0 * n))


def _symmetrise(edges: DataFrame, combine) -> DataFrame:
    a = edges.select("src", "dst", F.col("w").alias("a"))
    b = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("b"))
    j = a.join(b, ["src", "dst"], "full")
    return j.select("src", "dst", combine(F.coalesce(F.col("a"), F.lit(0.0)),
                                          F.coalesce(F.col("b"), F.lit(0.0))).alias("w"))


def neighbor_embedding(df: DataFrame, method: str = "umap", k: int = DEFAULT_K, perplexity: float = 30.0,
                       id_col: str = "ID", vec_col: str | None = None, cols: list[str] | None = None,
                       rounds: int = 30, seed: int = 42) -> DataFrame:
    """POS-4 (``umap``) / POS-5 (``tsne``): 2-D layout ``(algorithm, ID, x,
    y)`` of every row, from a PCA start by the forces of
    :mod:`featurescape.operators.layout`.  Ids are taken as unique."""
    base = _vectors(df, id_col, vec_col, cols)
    n = base.count()
    if method == "umap":
        # standardised numeric inputs (population std, 0 -> 1), as the reference does
        d = base.select(F.size("v")).first()[0]
        stats = base.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(
            F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
        m = [0.0] * d
        s = [1.0] * d
        for r in stats:
            m[r["i"]] = r["m"]
            s[r["i"]] = r["s"] if r["s"] else 1.0
        mv = F.array(*[F.lit(x) for x in m])
        sv = F.array(*[F.lit(x) for x in s])
        base = base.select("id", F.zip_with(F.zip_with("v", mv, lambda a, b: a - b), sv,
                                            lambda a, b: a / b).alias("v"))
    kk = k if method == "umap" else int(min(max(3 * perplexity, 1), max(n - 1, 1)))
    init = pca_positions(base, vector_col="v", id_col="id")
    bnd = init.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first()["m"] or 1.0
    start = init.select(F.col("ID").alias("id"), F.round(F.col("x") / bnd * 10, 6).alias("x"),
                        F.round(F.col("y") / bnd * 10, 6).alias("y"))
    pos = materialize(with_global_index(start, ["id"], "no"))
    # From here on an id is the first number it has, in id order; text is attached again at the end.
    number = materialize(pos.groupBy(F.col("id").alias("name")).agg(F.min("no").alias("id")))
    once = number.count() == n
    numbered = base.join(number, F.col("name").eqNullSafe(base["id"])).select(number["id"], "v")
    knn = materialize(knn_tables(numbered, kk, seed)[0])
    w = umap_weights(knn, kk) if method == "umap" else tsne_weights(knn, perplexity, n)
    edges = materialize(w.where(F.col("w") > 0))
    if not once:                                               # an edge between all rows of its two ids
        rows = pos.join(number, F.col("name").eqNullSafe(pos["id"])).select(number["id"], "no")
        edges = materialize(edges.join(rows.toDF("src", "s"), "src").join(rows.toDF("dst", "d"), "dst")
                            .select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"))
    out = umap_layout(pos, edges, n, rounds, seed=seed) if method == "umap" else \
        tsne_layout(pos, edges, rounds, levels=levels_for(n))
    return out.select(F.lit(method).alias("algorithm"), F.col("id").alias("ID"), "x", "y")
