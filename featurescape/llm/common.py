"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text handled by one vectorised numpy step; a longer single text is
# still handled whole (by the operators that accept it, in overlapping chunks).
SLICE_BYTES = 2 << 20


# Rows of an Arrow batch: texts of some KB make batches of some MB.
BATCH_ROWS = 1000

# What operators keep in a Python worker between tasks, by operator.
HELD: dict[str, dict] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of ``BATCH_ROWS`` rows at most to Python."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def enter(operator: str) -> None:
    """At a task's start: drop what other operators kept in this worker, and
    give free memory back, which a reused worker would hold through the job."""
    others = [held for name, held in HELD.items() if name != operator and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its offsets (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) whose texts hold about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of a uint64 array (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def byte_table(seed: int) -> np.ndarray:
    """256 fixed pseudo-random 64-bit values."""
    return np.random.default_rng(seed).integers(0, 2 ** 64, 256, dtype=np.uint64)


def digest_set(values: list[int]) -> str:
    """Comma-joined decimals, as the digest columns want them."""
    return ",".join(map(str, values))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def char_count(column) -> F.Column:
    """Code points of a text, 0 for null."""
    return F.coalesce(F.char_length(column), F.lit(0)).cast("long")


# Splitters of an ordered sequence: sampled keys for each of its buckets.
SAMPLE_PER_BUCKET = 32


def in_order(df: DataFrame, key: list[F.Column], wrap: bool = False, before: bool = False,
             marks: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` dealt into ordered buckets, with what a row needs of its
    neighbours beyond the bucket's ends.

    ``key`` (non-null, orderable) gives the order.  Splitters come from the keys
    with the smallest hashes: a sample whose size depends on the number of
    buckets alone.  Adds ``_bucket`` and ``_side``: 0 for a row in its place, 1
    for a copy of the first row of the next bucket (``wrap``: after the last
    comes the first again), with ``before`` also -1 for a copy of the last row
    of the bucket before.  Partitions are sorted by bucket, side and key; only
    the copies (two a bucket at most, more if whole rows repeat) travel twice.

    ``marks`` (_key, mark) has the rows that count as neighbours, with a mark
    that is the same for copies: the rows copied from each side are then the
    nearest one and the nearest one whose mark differs from it.
    """
    spark = df.sparkSession
    width = shuffle_width(spark)
    buckets = 3 * width
    df = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)]))
    fields = df.schema["_key"].dataType
    keys = df.select("_key")
    sample = sorted(tuple(r["_key"]) for r in keys.distinct().orderBy(F.xxhash64("_key"), "_key")
                    .limit(SAMPLE_PER_BUCKET * buckets).collect())
    splitters = sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []
    place = F.lit(0)
    if splitters:
        array = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(s, fields)])
                          for s in splitters])
        place = F.size(F.filter(array, lambda s: s <= F.col("_key")))
    df = df.withColumn("_bucket", place)
    ends = sorted(tuple(r) for r in df.groupBy("_bucket").agg(
        F.min("_key").alias("a"), F.max("_key").alias("b")).collect())   # a row for each bucket
    copies = []
    if marks is not None:
        copies = _unlike_neighbours([e[0] for e in ends], marks.withColumn("_bucket", place))
    for i, (bucket, a, b) in enumerate(ends if marks is None else []):
        if i or wrap:
            copies.append((tuple(a), ends[i - 1][0], 1))
        if before and i + 1 < len(ends):
            copies.append((tuple(b), ends[i + 1][0], -1))
    out = df.withColumn("_side", F.lit(0))
    if copies:
        small = spark.createDataFrame(copies, f"_key {fields.simpleString()}, _bucket int, _side int")
        out = out.unionByName(df.drop("_bucket").join(F.broadcast(small), "_key"))
    return (out.repartition(width, "_bucket").sortWithinPartitions("_bucket", "_side", "_key").drop("_key"))


def _unlike_neighbours(buckets: list[int], marks: DataFrame) -> list[tuple]:
    """(_key, _bucket, _side) of the nearest row beyond each end of each bucket,
    and of the nearest one there with another mark."""
    ends = marks.groupBy("_bucket").agg(F.min(F.struct("_key", "mark")).alias("a"),
                                        F.max(F.struct("_key", "mark")).alias("b"))
    unlike = marks.join(F.broadcast(ends), "_bucket").groupBy("_bucket").agg(     # a row for each bucket
        F.first("a").alias("a"), F.first("b").alias("b"),
        F.min(F.when(F.col("mark") != F.col("a.mark"), F.struct("_key", "mark"))).alias("a2"),
        F.max(F.when(F.col("mark") != F.col("b.mark"), F.struct("_key", "mark"))).alias("b2"))
    rows = {r["_bucket"]: [(tuple(x["_key"]), bytes(x["mark"])) if x is not None else None
                           for x in (r["a"], r["a2"], r["b"], r["b2"])] for r in unlike.collect()}
    copies = []
    for side, order in ((1, buckets[::-1]), (-1, buckets)):
        near = far = None                                      # nearest row, nearest one unlike it
        for bucket in order:
            copies += [(x[0], bucket, side) for x in (near, far) if x is not None]
            if bucket not in rows:
                continue
            first, other = rows[bucket][:2] if side == 1 else rows[bucket][2:]
            if other is None:
                other = near if near is not None and near[1] != first[1] else far
            near, far = first, other
    return copies


def strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string column over UTF-8 bytes, starting at its buffers' starts
    (string kernels misread columns that are cut out of larger ones)."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(raw)))


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges first .. first + count - 1, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
