"""Tabular sources and sinks (SRC-1, SRC-2, SNK-1).

``read_table`` reads a CSV with header the way ``pandas.read_csv`` types
it, but as one distributed job: every column is read as text, pandas' NA
tokens become null, and a single aggregate counts, per column, how many
non-null values parse as integer / number / boolean.  Columns are then
cast accordingly (dates stay text).  Parquet input keeps its own types.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.functions.numbers import (FALSE_TOKENS, NA_TOKENS, TRUE_TOKENS, is_number_text,
                                            to_number)
from featurescape.operators.ids import ensure_id
from featurescape.session import materialize
from featurescape.sources.paths import children, exists
from featurescape.sources.records import csv_records, spans_lines

INT_PATTERN = r"^\s*[+-]?\d+\s*$"


UNSIGNED = str(2 ** 64 - 1)


class RaggedRowError(ValueError):
    """A row has more fields than the header."""


class MissingInputError(FileNotFoundError):
    """SRC-2: the input path does not exist."""


def _dedupe_headers(names: list[str]) -> list[str]:
    """pandas renames repeated headers ``x``, ``x.1``, ``x.2`` ..."""
    seen: dict[str, int] = {}
    out = []
    taken = set(names)
    for n in names:
        if n in seen:
            k = seen[n]
            cand = f"{n}.{k}"
            while cand in taken:
                k += 1
                cand = f"{n}.{k}"
            seen[n] = k + 1
            taken.add(cand)
            out.append(cand)
        else:
            seen[n] = 1
            out.append(n)
    return out


def _check_input(spark: SparkSession, path: str) -> None:
    """SRC-2, on whatever file system the path names."""
    if not exists(spark, path):
        raise MissingInputError(f"no input file at {path}")


CSV_OPTIONS = {"escape": '"', "nullValue": "\u0000__none__", "emptyValue": ""}


def _csv_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header, and the rows as ``_c0 .. _cn`` (one column more than the header, null unless
    a row is too long) with their source file and block."""
    if not spans_lines(spark, path):
        first = spark.read.options(header=False, escape='"').csv(path).limit(1).collect()
        if not first:
            raise ValueError(f"no columns in {path}")
        schema = ", ".join(f"_c{i} string" for i in range(len(first[0]) + 1))
        raw = spark.read.schema(schema).options(**CSV_OPTIONS, header=True, mode="PERMISSIVE").csv(path)
        return list(first[0]), raw.select("*", F.col("_metadata.file_path").alias("_src_file"),
                                          F.col("_metadata.file_block_start").alias("_src_block"))
    records = materialize(csv_records(spark, path).repartitionByRange("file", "rec").sortWithinPartitions("file", "rec"))
    heads = records.groupBy("file").agg(F.min("rec").alias("rec"))
    head = records.join(heads, ["file", "rec"]).orderBy("file").limit(1).select("record").first()["record"]
    width = spark.range(1).select(F.size(F.split(F.lit(head), ",")).alias("n")).first()["n"]        # at least
    names = list(_parsed(spark.range(1).select(F.lit(head).alias("record")), width).first())
    while names and names[-1] is None:
        names.pop()
    rows = records.join(heads, ["file", "rec"], "left_anti")
    rows = rows.repartitionByRange("file", "rec").sortWithinPartitions("file", "rec")
    return names, _parsed(rows, len(names) + 1, F.col("file").alias("_src_file"),
                          F.lit(0).cast("long").alias("_src_block"))


def _parsed(records: DataFrame, width: int, *more) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return records.select(F.from_csv("record", schema, CSV_OPTIONS).alias("_r"), *more).select(
        *[F.col(f"_r._c{i}").alias(f"_c{i}") for i in range(width)], *(["_src_file", "_src_block"] if more else []))


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    _check_input(spark, path)
    header, rows = _csv_rows(spark, path)
    names = _dedupe_headers([n if n else f"Unnamed: {i}" for i, n in enumerate(header)])
    na = [F.lit(t) for t in NA_TOKENS]
    cols = [F.when(F.col(f"_c{i}").isin(*na) | F.col(f"_c{i}").isNull(), F.lit(None).cast("string"))
              .otherwise(F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)]
    # source order for ID assignment: file and split of every row
    return rows.select(*cols, "_src_file", "_src_block", F.col(f"_c{len(names)}").isNotNull().alias("_src_long"))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, pandas NA tokens -> null, repeated headers renamed like
    pandas, quoted fields over line ends kept whole.  Short rows are filled with nulls;
    what a row has beyond the header is left to :func:`read_table` to refuse."""
    return _csv_text(spark, path).drop("_src_long")


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_src_file", "_src_block", "_src_long")]


def infer_types(df: DataFrame) -> dict[str, str]:
    """One aggregate over all columns: a column is ``bigint`` if every value
    is an integer and none is missing (beyond 64 bits ``decimal(20,0)`` while
    an unsigned one would hold them, else text, missing values or not), ``double`` if every value is a number
    (ints with blanks widen), ``boolean`` if all are True/False spellings
    without blanks, else ``string`` (dates included)."""
    aggs = []
    for i, c in enumerate(_data_columns(df)):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(INT_PATTERN)).alias(f"i{i}"),
                 F.count_if(v.rlike(INT_PATTERN) & F.trim(v).try_cast("bigint").isNull()).alias(f"w{i}"),
                 F.count_if(F.trim(v).try_cast("decimal(38,0)").between(F.lit(0), F.lit(UNSIGNED).cast("decimal(38,0)"))
                            ).alias(f"u{i}"),
                 F.count_if(is_number_text(v)).alias(f"d{i}"),
                 F.count_if(v.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}")]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    long = F.count_if(F.col("_src_long")) if "_src_long" in df.columns else F.lit(0)
    row = df.agg(*aggs, long.alias("long")).collect()[0]
    if row["long"]:
        raise RaggedRowError(f"{row['long']} rows have more fields than the header")
    out = {}
    for i, c in enumerate(_data_columns(df)):
        n, ni, nd, nb, rows = row[f"n{i}"], row[f"i{i}"], row[f"d{i}"], row[f"b{i}"], row["rows"]
        if n == 0:
            out[c] = "double"  # all missing: pandas gives float64 NaN
        elif ni == n and row[f"w{i}"]:
            out[c] = "decimal(20,0)" if row[f"u{i}"] == n == rows else "string"
        elif ni == n and n == rows:
            out[c] = "bigint"
        elif nd == n:
            out[c] = "double"
        elif nb == n and n == rows:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        t = types.get(c, "keep")
        if t == "keep":
            cols.append(v)
            continue
        if t == "bigint":
            cols.append(F.trim(v).try_cast("bigint").alias(c))
        elif t == "double":
            cols.append(to_number(v).alias(c))
        elif t.startswith("decimal"):
            cols.append(F.trim(v).try_cast(t).alias(c))
        elif t == "boolean":
            cols.append(v.isin(*TRUE_TOKENS).alias(c))
        else:
            cols.append(v.alias(c))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, add_id: bool = True) -> DataFrame:
    """SRC-1/SRC-2 (+ PRJ-1): read CSV or Parquet, type CSV columns like
    pandas, make ``ID`` the first column (string)."""
    _check_input(spark, path)
    if path.endswith(".parquet") or any(f.endswith(".parquet") for f in children(spark, path)):
        df = spark.read.parquet(path)
    else:
        text = _csv_text(spark, path)
        df = apply_types(text, infer_types(text)).drop("_src_long")
    return ensure_id(df, keep_order_column=True) if add_id else df


def with_id_path(path: str) -> str:
    """SNK-1 naming: ``<stem>_with_id.csv`` next to the input."""
    d, f = os.path.split(path)
    stem = re.sub(r"\.[^.]*$", "", f)
    return os.path.join(d, f"{stem}_with_id.csv")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: the table with its ``ID`` column as CSV with header (a
    directory of part files written in parallel)."""
    from featurescape.operators.encode import is_internal
    out = df.drop(*[c for c in df.columns if is_internal(c)])
    out.write.mode(mode).option("header", True).csv(path)
