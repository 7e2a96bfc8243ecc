"""Row identity: ``ensure_id`` (PRJ-1), exact global positions, size-checked
broadcast.

Global numbering never goes through a single-partition window over the
data.  Rows are tagged with ``monotonically_increasing_id`` (partition id in
the high bits, position in the low 33 bits); one small aggregate per
partition/file block yields counts, a window over those *counts* (one row
per block, bounded by the number of splits the driver already plans) turns
them into offsets, and a broadcast join adds the offset back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurescape.session import materialize, shuffle_partitions

_LOW_BITS = (1 << 33) - 1

# Metadata tables (one row per partition, file block or feature) are
# broadcast below this row count; above it the join is left to AQE.
BROADCAST_ROW_LIMIT = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT,
                       known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven <= ``max_rows``."""
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


def _offsets(counts: DataFrame, order_cols: list[str], n_col: str,
             out: str) -> DataFrame:
    # ``counts`` holds one row per block: a single-task window is bounded by
    # the number of blocks, never by the data.
    w = Window.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n_col).over(w), F.lit(0)))


def with_global_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """Add the exact 0-based position of each row in the order of
    ``order_cols`` (ties: arbitrary but consistent).

    Range-partitions the rows (sampled bounds), sorts within partitions and
    materialises them (a table in the checkpoint folder), so the
    nondeterministic bounds are frozen before the per-partition counts are
    taken.
    """
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    ranged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged)
    pid = F.shiftright(F.col("_mid"), 33)
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, ["_pid"], "_n", "_off").select("_pid", "_off")
    out = (ranged.join(F.broadcast(offsets), pid == F.col("_pid"))
                 .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
                 .drop("_mid", "_pid", "_off"))
    return out


def _parquet_rows(df: DataFrame):
    """(file_path, row_index) of a Parquet scan, or None for other plans."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018 - forces analysis
        return F.col("_metadata.file_path"), F.col("_metadata.row_index")
    except Exception:  # noqa: BLE001 - no Parquet scan
        return None


def with_row_number(df: DataFrame, name: str = "_rownum") -> DataFrame:
    """1-based row number in source order: files by path, then position in the
    file; other plans by partition order.

    A Parquet scan numbers rows by their index in the file, which does not
    depend on how the file is split.  Any other source is written once with its
    tags, so that the counts and the rows come from the same splits: a change of
    splits between two scans (executors gained or lost, another split size)
    can neither drop nor renumber rows.
    """
    rows = None if "_src_file" in df.columns else _parquet_rows(df)
    if rows is not None:
        path, index = rows
        counts = df.select(path.alias("_f")).groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
        offsets = broadcast_if_small(materialize(_offsets(counts, ["_f"], "_n", "_off").drop("_n")))
        return (df.withColumn("_f", path).withColumn("_row", index).join(offsets, "_f")
                  .withColumn(name, F.col("_off") + F.col("_row") + 1).drop("_f", "_row", "_off"))
    sourced = "_src_file" in df.columns and "_src_block" in df.columns
    fcol, bcol = (F.col("_src_file"), F.col("_src_block")) if sourced else (F.lit(""), F.lit(0).cast("long"))
    tagged = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_f", fcol).withColumn("_b", bcol)
    tagged = materialize(tagged.drop(*(("_src_file", "_src_block") if sourced else ())))
    tagged = tagged.withColumn("_p", F.shiftright(F.col("_mid"), 33))
    blocks = (tagged.groupBy("_f", "_b", "_p")
                    .agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n")))
    offsets = broadcast_if_small(materialize(_offsets(blocks, ["_f", "_b", "_p"], "_n", "_off").drop("_n")))
    return (tagged.join(offsets, ["_f", "_b", "_p"])
                  .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0") + 1)
                  .drop("_f", "_b", "_p", "_mid", "_m0", "_off"))


def ensure_id(df: DataFrame, keep_order_column: bool = False) -> DataFrame:
    """PRJ-1: make ``ID`` the first column.

    If the first header (stripped, lower-cased) is ``id`` it is renamed to
    ``ID``; otherwise ``ID`` = "1".."n" in source order is inserted.  A later
    column called exactly ``ID`` is an error (the reference crashes there).
    With ``keep_order_column`` a BIGINT ``_ord`` (1..n) is kept for
    order-sensitive operators such as ball clustering.
    """
    cols = [c for c in df.columns if c not in ("_src_file", "_src_block")]
    if not cols:
        raise ValueError("table has no columns")
    first = cols[0]
    if first.strip().lower() == "id":
        if "ID" in cols[1:]:
            raise ValueError("a column named 'ID' appears after the id column")
        dtype = dict(df.dtypes)[first]
        idc = F.col(f"`{first}`")
        if dtype in ("float", "double"):
            idc = F.when(idc == F.floor(idc), idc.cast("long").cast("string")).otherwise(idc.cast("string"))
        else:
            idc = idc.cast("string")
        out = df.withColumn(first, idc).withColumnRenamed(first, "ID")
        if keep_order_column:
            out = with_row_number(out, "_ord")
        return out.drop("_src_file", "_src_block")
    if "ID" in cols:
        raise ValueError("column 'ID' exists but is not the first column")
    numbered = with_row_number(df, "_ord")
    out = numbered.select(F.col("_ord").cast("string").alias("ID"),
                          *[F.col(f"`{c}`") for c in cols],
                          *([F.col("_ord")] if keep_order_column else []))
    return out
