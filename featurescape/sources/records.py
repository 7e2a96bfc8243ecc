"""CSV records that run over line ends, read without one task per file.

Whether a line starts inside a quoted field depends on all lines before it.  Each
line is therefore reduced to what it does to that state (where it ends if it starts
outside, where if inside); these steps combine, first along the lines of a file
block, then along the blocks of a file (one row a block), and give every line its
true start.  Lines between two starts outside quotes are one record.

Line ends within a field become ``\\n``; blank lines between records are skipped.
A quote opens a field only as its first character, as in pandas; two quotes in a
quoted field are one.  A file that ends inside a field raises ``OpenQuoteError``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurescape.session import materialize

_INSIDE = re.compile(r'(?:[^"]|"")*+"[^,]*(?:,|\Z)', re.S)                  # rest of a quoted field
_FIELD = re.compile(r'"(?:[^"]|"")*+"[^,]*(?:,|\Z)|[^",][^,]*(?:,|\Z)|,', re.S)


class OpenQuoteError(ValueError):
    """A file ends inside a quoted field."""


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of the line."""
    at = 0
    if inside:
        m = _INSIDE.match(line)
        if m is None:
            return True
        at = m.end()
    while at < len(line):
        m = _FIELD.match(line, at)
        if m is None:
            return True
        at = m.end()
    return False


def _steps(batches):
    """Adds ``e0`` and ``e1``: whether the line ends inside quotes if it starts outside, inside."""
    for b in batches:
        value = b.column("value")
        quoted = pc.match_substring(value, '"').to_pylist()
        e0, e1 = [False] * b.num_rows, [True] * b.num_rows
        for i, has in enumerate(quoted):
            if has:
                line = value[i].as_py()
                e0[i], e1[i] = ends_inside(line, False), ends_inside(line, True)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e0), pa.array(e1)], names=[*b.schema.names, "e0", "e1"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some record runs over a line end: then, and only then, the first line
    that does so ends inside quotes though it starts outside."""
    quoted = _lines(spark, path).where(F.col("value").contains('"')).select("value")
    opened = quoted.mapInArrow(_steps, "value string, e0 boolean, e1 boolean").where("e0").select("e0")
    return not opened.isEmpty()


def _after(start: Column, window) -> Column:
    """State after the rows of the window from a state before them: the last row that sets
    it whatever it was, turned by the rows since that swap it."""
    swaps = F.coalesce(F.sum(F.col("swaps")).over(window), F.lit(0))
    last = F.last(F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("to"), F.col("swapped").alias("at"))),
                  ignorenulls=True).over(window)
    turned = (swaps - F.coalesce(last["at"], F.lit(0))) % 2 == 1
    return F.coalesce(last["to"], start) != turned


def _prepared(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("swaps", (F.col("e0") & ~F.col("e1")).cast("long"))
                .withColumn("swapped", F.sum("swaps").over(upto)))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rec, record)``: the text of every record, ``rec`` ascending in file order."""
    tagged = _lines(spark, path).withColumn("mid", F.monotonically_increasing_id()).mapInArrow(
        _steps, "value string, file string, block long, mid long, e0 boolean, e1 boolean")
    lines = _prepared(materialize(tagged), ["file", "block"], "mid")    # a window is at most one block
    before = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    lines = materialize(lines.select(
        "file", "block", "mid", "value", "e0", "e1",
        *[_after(F.lit(s), before).alias(f"s{int(s)}") for s in (False, True)],
        *[_after(F.lit(s), whole).alias(f"b{int(s)}") for s in (False, True)]))
    blocks = lines.groupBy("file", "block").agg(F.first("b0").alias("e0"), F.first("b1").alias("e1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = materialize(_prepared(blocks, ["file"], "block").select(
        "file", "block", _after(F.lit(False), earlier).alias("start"), _after(F.lit(False), upto).alias("end")))
    left = blocks.groupBy("file").agg(F.max_by("end", "block").alias("open")).where("open").select("file").first()
    if left:
        raise OpenQuoteError(f"{left['file']} ends inside a quoted field")

    first = F.when(F.col("start"), F.col("s1")).otherwise(F.col("s0"))
    placed = (lines.join(blocks.select("file", "block", "start"), ["file", "block"])
                   .withColumn("inside", first)
                   .withColumn("open", F.when(first, F.col("e1")).otherwise(F.col("e0"))))
    # a record is named by the block and the place of the line it starts with
    upto = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(~F.col("inside"), F.struct("block", "mid"))
    placed = placed.withColumn("rec", F.last(here, ignorenulls=True).over(upto))
    tails = lines.select("file", "block").distinct()
    starts = placed.groupBy("file", "block").agg(F.max(here).alias("final"))
    carried = tails.join(starts, ["file", "block"]).select(
        "file", "block", F.last("final", ignorenulls=True).over(earlier).alias("carried"))
    placed = (placed.join(carried, ["file", "block"])
                    .withColumn("rec", F.coalesce("rec", "carried")).select("file", "rec", "block", "mid", "value",
                                                                            "inside", "open"))
    single = placed.where("not inside and not open").select("file", "rec", F.col("value").alias("record"))
    joined = (placed.where("inside or open").groupBy("file", "rec")
                    .agg(F.sort_array(F.collect_list(F.struct("block", "mid", "value"))).alias("parts"))   # one record
                    .select("file", "rec", F.concat_ws("\n", F.col("parts.value")).alias("record")))
    return single.where(F.trim("record") != "").unionByName(joined)
