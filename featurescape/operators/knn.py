"""Exact k-nearest-neighbour graph (POS-6) over a nested metric partition.

1. *Cells.*  A hash sample of about ``sqrt(n) / 4`` items serves as pivots, nested in two
   levels (a vector looks for its top pivot first, then for the nearest pivot below
   it), so finding a cell costs the fourth root of n and cells grow with the square root.
2. *Chunks.*  The rows are range-partitioned by (cell, distance to its pivot) and cut into
   chunks: one row each, with the vectors as one binary and the band of distances
   they lie in.  A vector is written once; a hot cell is many chunks.
3. *Bounds.*  The k-th distance inside the own chunk, the k-th nearest pivot, and then a
   first pass over the own cell bound each item's k-th neighbour from above.
4. *Pruning.*  By the triangle inequality, a chunk whose band does not meet
   ``d(q, pivot) +- bound`` of any item of a query chunk holds none of its neighbours.
   That is decided on chunk numbers and bands alone; only the surviving pairs of
   chunks are met with vectors: a block of query chunks stays in a task, the member
   chunks pass by one at a time, and the best so far bounds what follows.
5. *Distances.*  A matrix product screens a pair of chunks; what may belong to the k
   nearest is recomputed exactly.  Ties go to the smaller id.

The share of all pairs that was compared is logged.  On data without metric structure
every chunk meets every other one: the work is quadratic then, blocks stay bounded and
a vector is sent once for each block.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.operators.ids import with_global_index
from featurescape.session import materialize

CHUNK_BYTES = 1 << 20       # vectors of a chunk
BLOCKS = 24                 # blocks of query chunks while the rows are few
BLOCK_BYTES = 64 << 20      # vectors of a block and what is kept for them, at most

log = logging.getLogger(__name__)


def _squares(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and the rounding they may carry (per q)."""
    qq, mm = (q ** 2).sum(axis=1), (m ** 2).sum(axis=1)
    return (np.maximum(qq[:, None] + mm[None, :] - 2.0 * (q @ m.T), 0.0),
            1e-10 * (qq + (mm.max() if len(mm) else 0.0)) + 1e-300)


def _nth_bound(q: np.ndarray, m: np.ndarray, nth: int) -> np.ndarray:
    """Upper bound of each q's nth smallest distance (from 0) to the rows of m."""
    if len(m) <= nth:
        return np.full(len(q), np.inf)
    out = np.empty(len(q))
    for i in range(0, len(q), 512):
        d2, tol = _squares(q[i:i + 512], m)
        out[i:i + 512] = np.sqrt(np.partition(d2, nth, axis=1)[:, nth] + 2 * tol)
    return out


class Pivots:
    """Two levels of pivots; the cell of a vector and its distance to the cell's pivot."""

    def __init__(self, ids: list[str], vectors: np.ndarray):
        self.ids, self.vectors = np.array(ids, dtype=object), vectors
        self.top = vectors[:max(1, math.isqrt(len(vectors)))]
        home = _squares(vectors, self.top)[0].argmin(axis=1)
        home[:len(self.top)] = np.arange(len(self.top))        # no top pivot without one below
        self.below = [np.flatnonzero(home == t) for t in range(len(self.top))]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = _squares(x, self.top)[0].argmin(axis=1)
        cell = np.zeros(len(x), np.int64)
        for t in np.unique(home):
            at = home == t
            cell[at] = self.below[t][_squares(x[at], self.vectors[self.below[t]])[0].argmin(axis=1)]
        return cell, np.sqrt(((x - self.vectors[cell]) ** 2).sum(axis=1))


class Members:
    """A chunk's rows as others look for their nearest among them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, centre: np.ndarray):
        self.x, self.ids, self.centre = x, ids, centre
        squares = ((x - centre) ** 2).sum(axis=1)
        self.far = float(np.sqrt(np.fmax.reduce(squares))) if len(x) else 0.0
        self._side = {}

    def side(self, kind) -> np.ndarray:
        """Columns m and -m * m / 2, so that a product with (q, 1) grows as the distance falls."""
        if kind not in self._side:
            y = self.x - self.centre
            half = -0.5 * (y ** 2).sum(axis=1)
            bad = ~np.isfinite(half)                           # nobody's neighbour
            y[bad], half[bad] = 0.0, -np.inf
            self._side[kind] = np.vstack([y.T, half]).astype(kind)
        return self._side[kind]


class Nearest:
    """The ``k`` nearest rows so far of every row of a chunk, within its bound; rows with
    its own id are left out, ties go to the smaller id.

    A product in single precision (double, where its rounding would let many rows
    through) screens the members; what may be near enough is computed exactly and
    waits in a list that is merged, and tightens the bounds, once it is as long as
    the rows' neighbours."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int, centre: np.ndarray):
        self.x, self.ids, self.bound, self.k, self.centre = x, ids, bound.copy(), k, centre
        self.square = ((x - centre) ** 2).sum(axis=1)
        self.rows, self.dist, self.names = np.zeros(0, np.int64), np.zeros(0), ids[:0]
        self.waiting, self.n_waiting, self.own, self._side = [], 0, [(np.zeros(0, np.int64), np.zeros(0))], {}

    def _rounding(self, m: Members, kind) -> np.ndarray:
        """What a screening product may be off by, per row."""
        return (2 * (self.x.shape[1] + 8) * float(np.finfo(kind).eps)
                * (np.sqrt(self.square) * m.far + m.far ** 2 / 2 + self.square / 2) + 1e-300)

    def _kind(self, m: Members):
        middle = float(np.median(self.bound ** 2))
        scale = max(m.far, float(np.sqrt(self.square.max())))
        fine = scale < 1e15 and np.isfinite(middle) and self._rounding(m, np.float32).max() <= 1e-3 * middle
        return np.float32 if fine else np.float64

    def meet(self, m: Members) -> None:
        with np.errstate(all="ignore"):                        # vectors that are not finite have no neighbours
            kind = self._kind(m)
            if kind not in self._side:
                self._side[kind] = np.hstack([self.x - self.centre, np.ones((len(self.x), 1))]).astype(kind)
            off = self._rounding(m, kind)
            for i in range(0, len(self.x), 512):
                at = slice(i, i + 512)
                near = self._side[kind][at] @ m.side(kind)
                least = (self.square[at] - self.bound[at] ** 2) / 2 - off[at]
                hits = near >= least.astype(kind)[:, None]
                if np.count_nonzero(hits) > 4 * self.k * len(near) and near.shape[1] > self.k + 1:
                    last = near.shape[1] - 1 - self.k          # one of the nearest may be the row itself
                    least = np.maximum(least, np.partition(near, last, axis=1)[:, last] - 2 * off[at])
                    hits = near >= least.astype(kind)[:, None]
                found = np.flatnonzero(hits)
                for s in range(0, len(found), 65536):
                    r, c = np.divmod(found[s:s + 65536], near.shape[1])
                    self._candidates(i + r, c, m)
        if self.n_waiting > max(len(self.x) * self.k, 4096):
            self.merge()

    def _candidates(self, r: np.ndarray, c: np.ndarray, m: Members) -> None:
        d = np.sqrt(((self.x[r] - m.x[c]) ** 2).sum(axis=1))
        keep = d <= self.bound[r]
        r, c, d = r[keep], c[keep], d[keep]
        names = m.ids[c]
        other = self.ids[r] != names
        if not other.all():
            self.own.append((r[~other], d[~other]))
        self.waiting.append((r[other], d[other], names[other]))
        self.n_waiting += int(other.sum())

    def merge(self) -> None:
        r, d, names = (np.concatenate(x) for x in zip((self.rows, self.dist, self.names), *self.waiting))
        by = np.argsort(d)
        by = by[np.argsort(r[by].astype(np.uint16 if len(self.x) <= 1 << 16 else np.int64), kind="stable")]
        r, d, names = r[by], d[by], names[by]
        if ((r[1:] == r[:-1]) & (d[1:] == d[:-1])).any():
            by = np.lexsort((_places(names), d, r))
            r, d, names = r[by], d[by], names[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = place < self.k
        self.rows, self.dist, self.names = r[best], d[best], names[best]
        self.waiting, self.n_waiting = [], 0
        last = place == self.k - 1
        self.bound[r[last]] = np.minimum(self.bound[r[last]], d[last])
        if sum(len(own[0]) for own in self.own) > 2 * len(self.x):
            self.own = [self._first_own()]

    def _first_own(self) -> tuple[np.ndarray, np.ndarray]:
        r, d = (np.concatenate(x) for x in zip(*self.own))
        by = np.lexsort((d, r))
        r, d = r[by], d[by]
        few = np.arange(len(r)) - np.searchsorted(r, r) <= self.k
        return r[few], d[few]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, place from 0, distance), by row and place.  Where ids repeat, a row's
        neighbours are those of its k + 1 nearest rows that have other ids."""
        self.merge()
        r, d = self._first_own()
        keep = np.ones(len(self.rows), bool)
        for row in np.flatnonzero(np.bincount(r, minlength=len(self.x)) > 1):
            mine = slice(*np.searchsorted(self.rows, [row, row + 1]))
            all_ = np.sort(np.concatenate([self.dist[mine], d[slice(*np.searchsorted(r, [row, row + 1]))]]))
            if len(all_) > self.k:
                keep[mine] = self.dist[mine] ** 2 <= all_[self.k] ** 2 + 8e-10 * (self.x[row] ** 2).sum()
        rows = self.rows[keep]
        return rows, self.names[keep], np.arange(len(rows)) - np.searchsorted(rows, rows), self.dist[keep]


def _places(names: np.ndarray) -> np.ndarray:
    """Numbers in the order of the names, equal for equal names."""
    return np.unique(names, return_inverse=True)[1] if names.dtype == object else names


def _pack(x: np.ndarray) -> bytes:
    """Doubles, as single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * n * dim else np.float64
    return np.frombuffer(data, kind).astype(np.float64).reshape(n, dim)


def _chunk_table(pts: DataFrame, pivots: Pivots, k: int, chunk_rows: int) -> DataFrame:
    """One row per chunk: number, cell, band lo..hi, n, ids, vectors, bounds."""

    def assign(frames):
        for pdf in frames:
            if len(pdf):
                cell, d = pivots.cells(np.stack(pdf["v"].to_numpy()))
                yield pdf.assign(cell=cell, d=d)

    kind = dict(pts.dtypes)["id"]
    placed = pts.mapInPandas(assign, f"id {kind}, v array<double>, cell long, d double")
    order = ["cell", "d", "id"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(frames):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def chunk(pdf):
            x = np.stack(pdf["v"].to_numpy())
            return {"chunk": number, "cell": int(pdf["cell"].iloc[0]), "lo": pdf["d"].iloc[0], "hi": pdf["d"].iloc[-1],
                    "n": len(pdf), "ids": pdf["id"].tolist(), "v": _pack(x),
                    "bound": _nth_bound(x, x, k).tobytes()}   # the item itself is one of the k + 1

        for pdf in frames:
            for _, part in pdf.groupby("cell", sort=False):
                at = 0
                while at < len(part):
                    if held and (rows == chunk_rows or held[0]["cell"].iloc[0] != part["cell"].iloc[0]):
                        yield pd.DataFrame([chunk(pd.concat(held))])
                        number, held, rows = number + 1, [], 0
                    piece = part.iloc[at:at + chunk_rows - rows]
                    held.append(piece)
                    rows, at = rows + len(piece), at + len(piece)
        if held:
            yield pd.DataFrame([chunk(pd.concat(held))])

    return materialize(placed.mapInPandas(
        cut, f"chunk long, cell long, lo double, hi double, n int, ids array<{kind}>, v binary, bound binary"))


def _pairs(chunks: DataFrame, pivots: Pivots, radii: dict, own_cell: bool) -> DataFrame:
    """(q, m): pairs of chunks that the bands cannot rule out; in the own cell only,
    or everywhere."""
    low = np.array([radii.get(c, (np.inf, -np.inf))[0] for c in range(len(pivots.vectors))])
    high = np.array([radii.get(c, (np.inf, -np.inf))[1] for c in range(len(pivots.vectors))])

    def reach(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                x, bound = _unpack(row.v, row.n, pivots.vectors.shape[1]), np.frombuffer(row.bound, np.float64)
                wanted = np.array([row.cell]) if own_cell else np.arange(len(low))
                lo, hi = np.full(len(wanted), np.inf), np.full(len(wanted), -np.inf)
                for i in range(0, row.n, 256):
                    d2, tol = _squares(x[i:i + 256], pivots.vectors[wanted])
                    d = np.sqrt(d2)
                    slack = 1e-9 + np.sqrt(tol)[:, None]       # rounding of a distance near zero
                    b = bound[i:i + 256, None]
                    a, z = d - b - slack, d + b + slack
                    meets = (a <= high[wanted]) & (z >= low[wanted])
                    lo = np.minimum(lo, np.where(meets, a, np.inf).min(axis=0))
                    hi = np.maximum(hi, np.where(meets, z, -np.inf).max(axis=0))
                some = lo <= hi
                yield pd.DataFrame({"q": row.chunk, "cell": wanted[some], "a": lo[some], "z": hi[some]})

    reached = chunks.select("chunk", "cell", "n", "v", "bound").mapInPandas(
        reach, "q long, cell long, a double, z double")
    bands = chunks.select(F.col("chunk").alias("m"), "cell", "lo", "hi")
    return materialize(reached.join(bands, "cell").where("hi >= a and lo <= z").select("q", "m"))


def _blocks(chunks: DataFrame, side: int) -> DataFrame:
    """(chunk, qb): ``side`` chunks that follow each other are one block."""
    at = with_global_index(chunks.select("chunk"), ["chunk"], "at")
    return materialize(at.select("chunk", F.expr(f"cast(at div {int(side)} as int)").alias("qb")))


def _compare(chunks: DataFrame, pairs: DataFrame, blocks: DataFrame, n_blocks: int, k: int, centre: np.ndarray,
             emit, schema: str) -> DataFrame:
    """What ``emit`` makes of every query chunk's number and :class:`Nearest`.  A task holds the
    query chunks of one block; the member chunks that any of them meets pass by one
    after another, those of the block itself first, and are sent once for each block."""
    dim = len(centre)
    near = pairs.join(blocks.select(F.col("chunk").alias("q"), "qb"), "q").groupBy("qb", "m").agg(
        F.collect_list("q").alias("wanted"))                   # a block's chunks at most
    near = near.join(blocks.select(F.col("chunk").alias("m"), F.col("qb").alias("mb")), "m")
    what = chunks.select("chunk", "n", "ids", "v", "bound")
    asked = what.join(blocks, "chunk").select("qb", F.lit(0).alias("turn"), "chunk", "n", "ids", "v", "bound",
                                              F.lit(None).cast("array<bigint>").alias("wanted"))
    members = near.join(what.withColumnRenamed("chunk", "m"), "m").select(
        "qb", F.when(F.col("qb") == F.col("mb"), 1).otherwise(2).alias("turn"), F.col("m").alias("chunk"), "n", "ids", "v",
        F.lit(None).cast("binary").alias("bound"), "wanted")
    rows = asked.unionByName(members).repartitionById(n_blocks, F.col("qb")).sortWithinPartitions("qb", "turn", "chunk")

    def run(batches):
        block, held = None, {}
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                if block != col["qb"][i].as_py():
                    yield from (b for c, near in held.items() for b in emit(c, near))
                    block, held = col["qb"][i].as_py(), {}
                x = _unpack(col["v"][i].as_buffer(), col["n"][i].as_py(), dim)
                ids = col["ids"][i].values.to_numpy(zero_copy_only=False)
                if col["turn"][i].as_py() == 0:
                    bound = np.frombuffer(col["bound"][i].as_buffer(), np.float64)
                    held[col["chunk"][i].as_py()] = Nearest(x, ids, bound, k, centre)
                else:
                    m = Members(x, ids, centre)
                    for c in col["wanted"][i].as_py():
                        held[c].meet(m)
        yield from (b for c, near in held.items() for b in emit(c, near))

    return rows.mapInArrow(run, schema)


def _kth(k: int):
    """(q, kth): the rows of a chunk that have k neighbours, and the distance of the k-th."""
    def emit(chunk, near):
        rows, _, place, d = near.result()
        last = place == k - 1
        kth = [{"at": int(r), "d": float(x)} for r, x in zip(rows[last], d[last])]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()),
                                          pa.array([kth], pa.list_(pa.struct([("at", pa.int32()), ("d", pa.float64())])))],
                                         names=["q", "kth"])
    return emit


def _edges(kind: str):
    """(src, dst, rank, dist) of a chunk's rows."""
    def emit(chunk, near):
        rows, names, place, d = near.result()
        as_ = pa.string() if kind == "string" else pa.int64()
        for s in range(0, len(rows), 100_000):
            at = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(near.ids[rows[at]], as_), pa.array(names[at], as_),
                                              pa.array(place[at] + 1, pa.int32()), pa.array(d[at])],
                                             names=["src", "dst", "rank", "dist"])
    return emit


def _tightened(chunks: DataFrame, kth: DataFrame) -> DataFrame:
    """Chunks whose bounds take in the k-th distances ``kth``, a list for each chunk."""

    def apply(frames):
        for pdf in frames:
            out = []
            for bound, kth_ in zip(pdf["bound"], pdf["kth"]):
                b = np.frombuffer(bound, np.float64).copy()
                for e in (kth_ if kth_ is not None else []):
                    b[e["at"]] = min(b[e["at"]], e["d"])
                out.append(b.tobytes())
            yield pdf.drop(columns="kth").assign(bound=out)

    kept = chunks.join(kth, chunks["chunk"] == kth["q"], "left").select(*chunks.columns, "kth")
    return materialize(kept.mapInPandas(apply, chunks.schema))


def knn_tables(pts: DataFrame, k: int, seed: int = 42, chunk_rows: int | None = None,
               cells: int | None = None) -> tuple[DataFrame, float]:
    """The graph of ``pts`` (id, a string or a bigint, and v array<double>) and the share of
    all pairs compared."""
    pts = materialize(pts)
    n = pts.count()
    kind = dict(pts.dtypes)["id"]
    empty = pts.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, rank int, dist double")
    if n < 2:
        return empty, 0.0
    # About sqrt(n) / 4 vectors on the driver: 25,000 for ten billion items.
    wanted = min(n, cells or math.isqrt(n) // 4 + 1)
    sample = (pts.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id").limit(wanted).collect())
    pivots = Pivots([r["id"] for r in sample], np.array([r["v"] for r in sample], dtype=float))
    centre = np.nan_to_num(pivots.vectors.mean(axis=0), posinf=0.0, neginf=0.0)
    dim = max(1, pivots.vectors.shape[1])
    chunk_rows = chunk_rows or max(128, min(2048, CHUNK_BYTES // (8 * dim)))
    chunks = _chunk_table(pts, pivots, k, chunk_rows)
    bands = chunks.groupBy("cell").agg(F.min("lo"), F.max("hi"), F.count(F.lit(1))).collect()    # a row per pivot
    radii = {r[0]: (r[1], r[2]) for r in bands}
    n_chunks = sum(r[3] for r in bands)
    # Blocks are few enough to fit in a task with the neighbours of their rows.
    side = max(1, min(-(-n_chunks // BLOCKS), BLOCK_BYTES // ((8 * dim + 24 * k) * -(-n // n_chunks))))
    blocks, n_blocks = _blocks(chunks, side), -(-n_chunks // side)
    if any(r[3] > 1 for r in bands):               # first pass: the rest of the own cell
        first = _compare(chunks, _pairs(chunks, pivots, radii, True), blocks, n_blocks, k, centre, _kth(k),
                         "q long, kth array<struct<at:int,d:double>>")
        chunks = _tightened(chunks, first)
    pairs = _pairs(chunks, pivots, radii, False)
    sizes = chunks.select("chunk", F.col("n").cast("double").alias("n"))
    compared = (pairs.join(sizes.toDF("q", "nq"), "q").join(sizes.toDF("m", "nm"), "m")
                .agg(F.sum(F.col("nq") * F.col("nm"))).first()[0] or 0.0)
    share = compared / (float(n) * float(n))
    log.info("kNN of %d items: %.1f %% of all pairs compared", n, 100 * share)
    return _compare(chunks, pairs, blocks, n_blocks, k, centre, _edges(kind),
                    f"src {kind}, dst {kind}, rank int, dist double"), share
