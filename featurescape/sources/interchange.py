"""Dataset snapshot files: readers (SRC-3 ... SRC-6) and writers (SNK-2 ...
SNK-7).

Readers accept the reference layout (one JSON array or object per file,
read with an explicit schema; integer ids become strings) as well as this
engine's own layout.  Writers produce the engine layout: Parquet (primary)
or JSON Lines directories written in parallel, partitioned by ``dataset``,
``time`` (and ``algorithm`` for positions), so readers prune partitions.
A single-file JSON array would funnel a whole table through one task, so
it is not written.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.operators.positions import safe_algorithm_name

FEATURE_SCHEMA = ("defaultcontext string, features map<string, map<string, double>>, id string, "
                  "values map<string, string>")
META_SCHEMA = ("features map<string, struct<histogram: map<string, double>, max: double, min: double, "
               "median: double, variance: double, deviation: double>>")
SCHEMA_SCHEMA = ("color string, glyph array<string>, label map<string, string>, tooltip array<string>, "
                 "variantcontext map<string, struct<description: string, id: string>>")
POSITION_SCHEMA = "id string, position struct<x: double, y: double>"

# Snapshot date format (ddMMyyyy) and file name layout
# ``<base>.<time>.<kind>[.<subtype>].json``.
TIME_FORMAT = "%d%m%Y"
FILE_PATTERN = r"^(.+?)\.(\d{8})\.(\w+)(?:\.(\w+))?\.json$"


def _read_json(spark: SparkSession, schema: str, paths, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(paths)


def read_features(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """SRC-3: item records (id always STRING)."""
    return _read_json(spark, FEATURE_SCHEMA, path, multiline)


def read_meta(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """SRC-4."""
    return _read_json(spark, META_SCHEMA, path, multiline)


def read_schema(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """SRC-5."""
    return _read_json(spark, SCHEMA_SCHEMA, path, multiline)


def read_positions(spark: SparkSession, paths: list[str], multiline: bool = True) -> DataFrame:
    """SRC-6: all position files of a snapshot in one read, keyed by the
    algorithm taken from each file name; tidy ``(algorithm, ID, x, y)``
    plus ``_pord`` (row position, for last-wins deduplication)."""
    df = _read_json(spark, POSITION_SCHEMA, paths, multiline)
    algo = F.regexp_extract(F.col("_metadata.file_name"), r"\.position\.([^.]+)\.json$", 1)
    return df.select(algo.alias("algorithm"), F.col("id").alias("ID"), F.col("position.x").alias("x"),
                     F.col("position.y").alias("y"), F.monotonically_increasing_id().alias("_pord"))


def snapshot_time(date: _dt.date | None = None) -> str:
    """SNK-7: ``ddMMyyyy`` of the run date (injectable for tests)."""
    return (date or _dt.date.today()).strftime(TIME_FORMAT)


def snapshot_base(stem: str, date: _dt.date | None = None) -> str:
    """SNK-7: ``<stem>.<ddMMyyyy>``."""
    return f"{stem}.{snapshot_time(date)}"


def _writer(df: DataFrame, fmt: str, mode: str):
    """``overwrite`` replaces the partitions that are written, no others: a second
    run of a snapshot leaves it once."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    return w.format("json" if fmt == "json" else "parquet")


def _save(df: DataFrame, out_dir: str, kind: str, fmt: str, mode: str, run: str | None, inner=()) -> None:
    """Under ``dataset=/time=``, and under ``run=`` if the snapshot is committed as a unit
    (see :mod:`featurescape.sources.snapshots`)."""
    by = ["dataset", "time"]
    if run is not None:
        df, by = df.withColumn("run", F.lit(run)), [*by, "run"]
    _writer(df, fmt, mode).partitionBy(*by, *inner).save(f"{out_dir}/{kind}")


def write_features(items: DataFrame, out_dir: str, dataset: str, time: str, fmt: str = "parquet",
                   mode: str = "overwrite", run: str | None = None) -> None:
    """SNK-2: item records under ``dataset=/time=`` partitions."""
    df = items.select("defaultcontext", "features", "id", "values").withColumn(
        "dataset", F.lit(dataset)).withColumn("time", F.lit(time))
    _save(df, out_dir, "feature", fmt, mode, run)


def write_meta(meta: DataFrame, out_dir: str, dataset: str, time: str, fmt: str = "json",
               mode: str = "overwrite", run: str | None = None) -> None:
    """SNK-3: the one-row meta document."""
    df = meta.withColumn("dataset", F.lit(dataset)).withColumn("time", F.lit(time))
    _save(df, out_dir, "meta", fmt, mode, run)


def write_schema(schema_doc: DataFrame, out_dir: str, dataset: str, time: str, fmt: str = "json",
                 mode: str = "overwrite", run: str | None = None) -> None:
    """SNK-4: the one-row schema document."""
    df = schema_doc.withColumn("dataset", F.lit(dataset)).withColumn("time", F.lit(time))
    _save(df, out_dir, "schema", fmt, mode, run)


def write_positions(pos: DataFrame, out_dir: str, dataset: str, time: str, fmt: str = "parquet",
                    mode: str = "overwrite", run: str | None = None) -> None:
    """SNK-5: tidy positions partitioned by algorithm (names sanitised,
    Q17).  A set without valid rows writes nothing (empty partitions are
    not created)."""
    df = pos.select(safe_algorithm_name(F.col("algorithm")).alias("algorithm"), F.col("ID").alias("id"),
                    F.struct("x", "y").alias("position")).withColumn("dataset", F.lit(dataset)).withColumn(
        "time", F.lit(time))
    _save(df, out_dir, "position", fmt, mode, run, ["algorithm"])


def read_snapshot_positions(spark: SparkSession, out_dir: str, dataset: str, time: str | None = None,
                            fmt: str = "parquet") -> DataFrame:
    """Engine layout reader: partition filters prune to one snapshot."""
    df = spark.read.format("json" if fmt == "json" else "parquet").load(f"{out_dir}/position")
    df = df.where(F.col("dataset") == dataset)
    if time is not None:
        df = df.where(F.col("time") == time)
    return df.select("dataset", "time", "algorithm", F.col("id").alias("ID"),
                     F.col("position.x").alias("x"), F.col("position.y").alias("y"))


def catalog_from_layout(spark: SparkSession, out_dir: str, source: str = "local") -> DataFrame:
    """SNK-6 counterpart: catalogue rows of an engine-layout folder, from
    the partition directories only (no data files are read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out_dir)
                  .select("path"))
    kind = F.regexp_extract("path", r"/(feature|meta|schema|position)/", 1)
    ds = F.regexp_extract("path", r"/dataset=([^/]+)/", 1)
    tm = F.regexp_extract("path", r"/time=([^/]+)/", 1)
    algo = F.regexp_extract("path", r"/algorithm=([^/]+)/", 1)
    rows = files.select(ds.alias("dataset"), F.lit(source).alias("source"), tm.alias("time"),
                        kind.alias("kind"), F.when(algo != "", algo).alias("subtype"),
                        F.regexp_extract("path", r"^(.*/time=[^/]+(?:/algorithm=[^/]+)?)/", 1).alias("path"))
    return rows.where(F.col("kind") != "").distinct()


def write_catalog(cat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-6: catalogue rows as JSON Lines (the generated TypeScript module
    of the reference is code, not data, and is not produced)."""
    cat.write.mode(mode).json(path)
