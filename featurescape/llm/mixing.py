"""Operator 4: mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their ids, are cut into
blocks of ``block_chars`` code points (a document belongs to the block in which it
starts).  With weight w, the j-th block of a source (from 1) is released at slot
``floor((j - 1) / w)`` and due by ``ceil(j / w)``; every slot takes the released
block with the earliest deadline (ties: the source that sorts first).  With
weights that sum to 1 this meets all deadlines, so after any number of slots each
source has had less than one block more or less than its share.

Weights are integers over their sum D, so the schedule repeats after D slots;
the driver computes one period (its size depends on the weights alone) and the
slot of every block follows from its number: no sequential pass over the data.
The running sum that numbers the blocks is taken per source and hash bucket, with
the sums of the buckets before it added from a table of sources x BUCKETS rows, so a
source with a third of all rows is spread over BUCKETS groups.

Every row gets a slot; nothing is dropped or repeated.  When a source has run
out its slots stay empty and the others go on in order.  Default weights are the
square roots of the sources' sizes, quantised to ``RESOLUTION`` steps (at
least one).  Sources missing from given weights get the least weight given.  A null
source is a source of its own; null text has length 0; rows with equal ids, null
ids too, stand side by side in the order of their text's hash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescape.llm.common import char_count
from featurescape.session import materialize

BLOCK_CHARS = 1 << 16
RESOLUTION = 1000
BUCKETS = 256


def pfair_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period of sum(weights) slots."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in weights]                        # release slot, source
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []                          # deadline, source
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, s = heapq.heappop(waiting)
            j = len(slots[s]) + 1
            heapq.heappush(ready, (-(-j * total // weights[s]), s))
        due, s = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a deadline was missed")
        slots[s].append(now)
        j = len(slots[s]) + 1
        if j <= weights[s]:
            heapq.heappush(waiting, ((j - 1) * total // weights[s], s))
    return slots


def source_key(column) -> Column:
    """The source's name, with null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def whole_weights(sizes: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    total = sum(sizes.values()) or 1
    return {s: max(1, round(resolution * v / total)) for s, v in sizes.items()}


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             keep: list[str] | None = None) -> DataFrame:
    """Every row's place in the mixture: id, source, weight, block (from 0 in its
    source), release, deadline, slot, and offset (code points of its source before
    it).  Ordered by slot, then offset, the rows are the mixture.  Columns named in
    ``keep`` are carried along under ``_<name>``."""
    if block_chars < 1:
        raise ValueError("block_chars must be positive")
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(source_col).alias("key"),
        char_count(F.col(text_col)).alias("chars"), F.xxhash64(F.col(id_col).cast("string")).alias("hash"),
        text_hash.alias("tie"), *[F.col(c).alias(f"_{c}") for c in keep or []])
    rows = rows.withColumn("bucket", F.shiftrightunsigned("hash", 64 - BUCKETS.bit_length() + 1).cast("int"))
    sums = materialize(rows.groupBy("key", "bucket").agg(F.sum("chars").alias("sum"), F.count("*").alias("n")))
    # One row a source: the names of sources are a catalogue, not data.
    per_source = {r["key"]: (r["chars"], r["n"]) for r in sums.groupBy("key").agg(
        F.sum("sum").alias("chars"), F.sum("n").alias("n")).collect()}
    if weights is None:
        sizes = {s: max(c, 1) ** 0.5 for s, (c, _) in per_source.items()}
    else:
        given = {("null" if s is None else f"={s}"): w for s, w in weights.items()}
        if not given or min(given.values()) <= 0:
            raise ValueError("weights must be positive")
        sizes = {s: given.get(s, min(given.values())) for s in per_source}
    whole = whole_weights(sizes)
    total = sum(whole.values())
    period = [(s, k, slot, whole[s]) for s, slots in pfair_period(whole).items() for k, slot in enumerate(slots)]
    table = spark.createDataFrame(period, "key string, turn int, first_slot long, weight int")
    so_far = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("sum").over(so_far), F.lit(0)).alias("start"))
    within = Window.partitionBy("key", "bucket").orderBy("hash", "id", "tie").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (rows.withColumn("before", F.coalesce(F.sum("chars").over(within), F.lit(0)))
              .join(starts, ["key", "bucket"])
              .withColumn("offset", F.col("start") + F.col("before"))
              .withColumn("block", F.floor(F.col("offset") / F.lit(block_chars)).cast("long")))
    sizes_table = spark.createDataFrame([(s, w) for s, w in whole.items()], "key string, weight int")
    placed = placed.join(F.broadcast(sizes_table), "key").withColumn(
        "turn", F.expr("cast(block % weight as int)"))
    # The period has at most RESOLUTION plus one row for each source.
    placed = placed.join(F.broadcast(table.drop("weight")), ["key", "turn"])
    w = F.col("weight").cast("long")
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), (w / F.lit(total)).alias("weight"),
        "block", F.expr(f"(block * {total}) div weight").alias("release"),
        F.expr(f"((block + 1) * {total} + weight - 1) div weight").alias("deadline"),
        (F.expr("block div weight") * F.lit(total) + F.col("first_slot")).alias("slot"), "offset",
        *[f"_{c}" for c in keep or []])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mixture: partitions
    are ranges of slots, each sorted by slot and offset."""
    placed = schedule(docs, weights, block_chars, id_col, text_col, source_col, keep=docs.columns)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = placed.repartitionByRange(n, "slot", "offset").sortWithinPartitions("slot", "offset")
    return ordered.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])
