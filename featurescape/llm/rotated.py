"""Operator 13: near copies among embeddings by randomised-rotation binary codes.

Two vectors of one label link when their cosine is ``least`` (0.93) or more.

A unit vector, padded and turned by a random rotation, is kept as the signs of its
coordinates (the *code*) with a stored correction factor: its inner product with that
code.  For another vector q, ``<code, q> / factor`` estimates the inner product without
bias, with an error of about ``sqrt(1 / factor**2 - 1) / sqrt(bits - 1)``; ``SIGMAS`` times
that (plus the rounding of q to bytes, which is known) bounds it.  Pairs whose bounds, taken
in both directions, stay below the threshold are done; the others are recomputed in
double precision.  Nothing links on an estimate.

1. *Balls.*  Rows are dealt by label and some sign bits into chunks of ``CHUNK`` at most;
   in each, vectors within half the threshold's angle of a common member form a ball.
   All pairs in a ball are linked (triangle inequality), so groups of copies, however
   large, shrink to few balls before anything is compared in pairs.  A vector without close
   neighbours is a ball of its own.
2. *Buckets.*  Each ball enters, for ``tables`` sets of sign bits, the buckets of its
   members.  Bits and tables follow from the label's size, so that a bucket holds about
   ``CHUNK`` balls and a linked pair misses all common buckets with a probability below
   ``MISS``; a label of up to ``CHUNK`` rows is one bucket, and nothing is missed.  Larger
   buckets are compared in blocks.  Estimates and bounds decide which pairs of balls to
   recompute.
3. *Decision.*  The exact angle of two balls' centres and their radii tell that all, or none,
   of their pairs link; in between the members are compared exactly.

Links are counted, never written out in pairs for copies; components come from one edge per
linked pair of balls.  Vectors of different dimension never meet.  Vectors that are null,
empty, zero or hold null or non-finite components, and rows without a label, have no
links and are components of their own.  Each repeated row is a vector of its own, also
with a repeated or null id (ids only name components: the smallest one, null if there is
none; a null id is never kept).  An empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.llm.common import HELD, enter
from featurescape.llm.components import components
from featurescape.operators.ids import broadcast_if_small
from featurescape.session import materialize

LEAST = 0.93
SIGMAS = 6.0                # width of the confidence bounds
MISS = 1e-8                 # probability that a linked pair shares no bucket
CHUNK = 1024                # vectors of a chunk, balls of a bucket's block
SEED = 13
SLACK = 1e-6                # rounding of angles, in radians

_ROTATIONS: dict = HELD.setdefault("rotated", {})


def rotation(dim: int, number: int) -> np.ndarray:
    """Orthonormal rows: a random rotation of ``dim`` dimensions (number >= 0), or of the
    padded space that codes live in (number -1; dim columns)."""
    if (dim, number) not in _ROTATIONS:
        bits = code_bits(dim) if number < 0 else dim
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number + 1]).normal(size=(bits, dim)))
        _ROTATIONS[dim, number] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, number]


def code_bits(dim: int) -> int:
    return 64 * max(4, math.ceil(4 * dim / 64))


def tables_for(bits: int, least: float) -> int:
    """Sets of ``bits`` sign bits that a pair at the threshold needs."""
    same = (1 - math.acos(least) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(MISS) / math.log1p(-same))


def bucket_keys(u: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(row, table) numbers that name the table and its sign bits."""
    dim = u.shape[1]
    out = np.zeros((len(u), tables), np.int64)
    for t in range(tables):
        for i in range(bits):
            number, column = divmod(t * bits + i, dim)
            out[:, t] = 2 * out[:, t] + (u @ rotation(dim, number)[column] >= 0)
    return out + (np.arange(tables, dtype=np.int64) << 40)


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of unit vectors, and their correction factors."""
    turned = u @ rotation(u.shape[1], -1).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def to_bytes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors rounded to signed bytes, the scale, and the length of the error."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1))


class Estimates:
    """Upper bounds of inner products between coded vectors."""

    def __init__(self, codes: np.ndarray, factors: np.ndarray, q: np.ndarray, scale: np.ndarray, error: np.ndarray):
        dim = q.shape[1]
        bits = code_bits(dim)
        signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
        self.code = signs / (math.sqrt(bits) * factors).astype(np.float32)[:, None]
        self.query = ((q * scale[:, None]) @ rotation(dim, -1).T).astype(np.float32)
        self.width = SIGMAS * np.sqrt(np.maximum(0, 1 / factors ** 2 - 1)) / math.sqrt(bits - 1)
        self.factors, self.error = factors, error

    def value(self, i, j) -> np.ndarray:
        """Unbiased estimates of <i, j> from the codes of i (ranges of rows)."""
        return self.code[i] @ self.query[j].T

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of <i, j> for pairs of rows, from both directions."""
        one = np.einsum("ij,ij->i", self.code[i], self.query[j]) + self.width[i] + self.error[j] / self.factors[i]
        two = np.einsum("ij,ij->i", self.code[j], self.query[i]) + self.width[j] + self.error[i] / self.factors[j]
        return np.minimum(one, two) + 1e-5

    def above(self, rows: slice, cols: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows whose upper bounds reach ``least``: a look at all of them in one
        direction, and at what passes in both."""
        need = least - 1e-5 - self.width[rows] - self.error[cols].max() / self.factors[rows]
        x, y = np.nonzero(self.value(rows, cols) >= need.astype(np.float32)[:, None] - np.float32(1e-6))
        x, y = x + rows.start, y + cols.start
        keep = self.upper(x, y) >= least
        return x[keep], y[keep]


def cover(u: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centre (a row) and angle to it: rows with the most neighbours within
    ``radius`` gather them first; others are their own."""
    centre, angle = np.arange(len(u)), np.zeros(len(u))
    near = np.empty((len(u), len(u)), bool)
    for i in range(0, len(u), 512):
        near[i:i + 512] = u[i:i + 512] @ u.T >= math.cos(radius)
    np.fill_diagonal(near, True)
    degree = near.sum(axis=1)
    free = np.ones(len(u), bool)
    while True:
        c = int(np.argmax(np.where(free, degree, 0)))
        if not free[c] or degree[c] < 2:
            return centre, angle
        taken = np.flatnonzero(near[c] & free)
        centre[taken] = c
        angle[taken] = np.arccos(np.clip(u[taken] @ u[c], -1, 1))
        angle[c] = 0
        free[taken] = False
        degree -= near[:, taken].sum(axis=1)


def _scaled(column: pd.Series) -> np.ndarray:
    """Vectors divided by their largest component, so that squares stay in range."""
    x = np.stack(column.to_list()).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _units(column: pd.Series) -> np.ndarray:
    x = _scaled(column)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _usable(label, x):
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _split_large(df: DataFrame, key: list[str], limit: int) -> DataFrame:
    """``parts``: into how many pieces of about ``limit`` rows each key's rows go."""
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_"))
    large = broadcast_if_small(materialize(sizes.where(F.col("rows_") > limit)))
    parts = F.ceil(F.coalesce("rows_", F.lit(1)) / F.lit(limit)).cast("int")
    return df.join(large, key, "left").withColumn("parts", parts).drop("rows_")


def _placed(rows: DataFrame, least: float, chunk: int) -> DataFrame:
    """Every usable row in its ball; the ball's centre row has what buckets need."""
    sizes = materialize(rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size_")))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size_") / F.lit(chunk)))).cast("int")
    rows = rows.join(broadcast_if_small(sizes), ["label", "dim"]).withColumn("bits", bits)

    def first_keys(frames):
        enter("rotated")
        for pdf in frames:
            key = np.zeros(len(pdf), np.int64)
            for (dim, b), at in pdf.groupby(["dim", "bits"]).indices.items():
                key[at] = bucket_keys(_units(pdf["x"].iloc[at]), int(b), 1)[:, 0]
            yield pdf[["rid", "label", "dim", "bits", "x"]].assign(key=key)

    kind = rows.schema["label"].dataType.simpleString()
    dealt = rows.select("rid", "label", "dim", "bits", "x").mapInPandas(
        first_keys, f"rid long, label {kind}, dim int, bits int, x array<double>, key long")
    dealt = _split_large(materialize(dealt), ["label", "dim", "key"], chunk)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts").cast("long")))
    half = math.acos(least) / 2 - SLACK

    def balls(pdf: pd.DataFrame) -> pd.DataFrame:
        enter("rotated")
        pdf = pdf.sort_values("rid", ignore_index=True)
        x, bits = _scaled(pdf["x"]), int(pdf["bits"].iloc[0])
        norm = np.sqrt((x ** 2).sum(axis=1))
        u = x / norm[:, None]
        centre, angle = cover(u, half)
        keys = bucket_keys(u, bits, tables_for(bits, least))
        rid = pdf["rid"].to_numpy(np.int64)
        out = pdf[["rid", "label", "dim"]].assign(x=list(x), norm=norm, ball=rid[centre], angle=angle)
        codes, factors = encode(u)
        q, scale, error = to_bytes(u)
        n = np.bincount(centre, minlength=len(u))
        wide = np.zeros(len(u))
        np.maximum.at(wide, centre, angle)
        order = np.argsort(centre, kind="stable")
        ends = np.cumsum(n)
        held = {c: np.unique(keys[order[ends[c] - n[c]:ends[c]]]).tolist() for c in np.flatnonzero(n).tolist()}
        here = n > 0
        return out.assign(n=n, wide=wide, factor=factors, scale=scale, error=error,
                          keys=[held.get(i) for i in range(len(u))],
                          code=[c.tobytes() if h else None for c, h in zip(codes, here)],
                          q=[v.tobytes() if h else None for v, h in zip(q, here)])

    return materialize(dealt.groupBy("label", "dim", "key", "part").applyInPandas(
        balls, f"rid long, label {kind}, dim int, x array<double>, norm double, ball long, angle double, n long, wide double, "
               "factor double, scale double, error double, keys array<long>, code binary, q binary"))


def _candidates(centres: DataFrame, least: float, chunk: int) -> DataFrame:
    """(a, b): balls in a common bucket whose estimates do not rule a link out."""
    key = ["label", "dim", "key"]
    entries = centres.select("label", "dim", F.explode("keys").alias("key"), "ball", "wide", "factor", "scale",
                             "error", "code", "q")
    entries = _split_large(entries, key, chunk)
    own = F.pmod(F.xxhash64("ball"), F.col("parts").cast("long")).cast("int")
    entries = entries.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entries = entries.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    limit = math.acos(least)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        enter("rotated")
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        pdf = pdf.sort_values(["own", "ball"], ignore_index=True)
        ball, wide = pdf["ball"].to_numpy(np.int64), pdf["wide"].to_numpy()
        split = int((pdf["own"] == low).sum())
        found = Estimates(np.stack([np.frombuffer(c, np.uint8) for c in pdf["code"]]), pdf["factor"].to_numpy(),
                          np.stack([np.frombuffer(q, np.int8) for q in pdf["q"]]), pdf["scale"].to_numpy(),
                          pdf["error"].to_numpy())
        out = [np.zeros((0, 2), np.int64)]
        for i in range(0, split, 512):
            rows = slice(i, min(i + 512, split))
            for j in range(i if low == high else split, len(pdf), 2048):
                cols = slice(j, min(j + 2048, len(pdf)))
                bound = limit + wide[rows].max() + wide[cols].max()
                x, y = found.above(rows, cols, math.cos(min(math.pi, bound)))
                if low == high:
                    x, y = x[y > x], y[y > x]
                out.append(np.sort(np.stack([ball[x], ball[y]], axis=1), axis=1))
        out = np.concatenate(out)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return entries.groupBy(*key, "low", "high").applyInPandas(compare, "a long, b long").distinct()


def _member_links(mixed: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """(a, b, rid, n): links of each member of two balls with the other ball's."""
    members = placed.select("ball", "rid", "x")
    rows = (mixed.select("a", "b", F.explode(F.array("a", "b")).alias("ball"))
            .join(members, "ball").withColumn("first", F.col("ball") == F.col("a")))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        u, first = _units(pdf["x"]), pdf["first"].to_numpy(bool)
        near = u[first] @ u[~first].T >= least
        n = np.zeros(len(pdf), np.int64)
        n[first], n[~first] = near.sum(axis=1), near.sum(axis=0)
        return pdf[["a", "b", "rid"]].assign(n=n)[n > 0]

    return materialize(rows.groupBy("a", "b").applyInPandas(count, "a long, b long, rid long, n long"))


def near_copies(vectors: DataFrame, least: float = LEAST, chunk: int = CHUNK, id_col: str = "vec_id",
                vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    if not 0 < least < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    x = F.col(vector_col).cast("array<double>")
    rows = materialize(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
                       .withColumn("rid", F.monotonically_increasing_id()))
    usable = _usable(F.col("label"), F.col("x"))
    placed = _placed(rows.where(usable).withColumn("dim", F.size("x")), least, chunk)
    centres = placed.where("rid = ball")
    centre = centres.select("ball", "n", "wide", "x", "norm")
    pairs = (_candidates(centres, least, chunk)
             .join(centre.select(*[F.col(c).alias(f"{c}_a") for c in centre.columns]), F.col("a") == F.col("ball_a"))
             .join(centre.select(*[F.col(c).alias(f"{c}_b") for c in centre.columns]), F.col("b") == F.col("ball_b")))
    dot = F.aggregate(F.zip_with("x_a", "x_b", lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    cosine = dot / (F.col("norm_a") * F.col("norm_b"))
    wide, limit = F.col("wide_a") + F.col("wide_b"), math.acos(least)
    angle = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    verdict = (F.when(single, F.when(F.col("cosine") >= least, "all").otherwise("none"))
               .when(angle + wide <= limit - SLACK, "all").when(angle - wide > limit + SLACK, "none")
               .otherwise("mixed"))
    pairs = materialize(pairs.withColumn("cosine", cosine).withColumn("verdict", verdict)
                        .where("verdict != 'none'").select("a", "b", "n_a", "n_b", "verdict"))
    whole = pairs.where("verdict = 'all'")
    partly = _member_links(pairs.where("verdict = 'mixed'"), placed, least)
    by_ball = (whole.select(F.col("a").alias("ball"), F.col("n_b").alias("n"))
               .unionByName(whole.select(F.col("b").alias("ball"), F.col("n_a").alias("n")))
               .groupBy("ball").agg(F.sum("n").alias("ball_links")))
    by_row = partly.groupBy("rid").agg(F.sum("n").alias("row_links"))
    roots = components(whole.select("a", "b").unionByName(partly.select("a", "b").distinct()))
    balls = (centres.select("ball", "n").join(by_ball, "ball", "left")
             .join(roots.withColumnRenamed("node", "ball"), "ball", "left")
             .select("ball", (F.col("n") - 1 + F.coalesce("ball_links", F.lit(0))).alias("near"),
                     F.coalesce("root", "ball").alias("root")))
    members = (rows.select("rid", "id").join(placed.select("rid", "ball"), "rid", "left").join(balls, "ball", "left")
               .join(by_row, "rid", "left")
               .withColumn("root", F.coalesce("root", "rid"))
               .withColumn("n_links", F.coalesce("near", F.lit(0)) + F.coalesce("row_links", F.lit(0))))
    members = materialize(members.select("id", "root", F.col("n_links").cast("long").alias("n_links")))
    names = members.groupBy("root").agg(F.min("id").alias("component_id"))
    return (members.join(names, "root")
            .select(F.col("id").alias(id_col), "n_links", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def oracle_sql(least: float = LEAST) -> str:
    """DuckDB SQL of the query over ``embeddings``."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0
    AND len([e for e in embedding if e <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {least}),
reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
near AS (SELECT a, count(*) AS n FROM link GROUP BY a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(near.n, 0)::BIGINT AS n_links,
       least(e.vec_id, coalesce(root.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(root.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN near ON near.a = e.vec_id LEFT JOIN root ON root.a = e.vec_id
"""
