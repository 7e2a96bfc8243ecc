"""Dataset catalogue (CAT-1 ... CAT-8, SORT-1).

Tidy form: ``catalog(dataset, source, time, kind, subtype, path)`` -- one
row per file of a snapshot (``kind`` = feature/meta/schema/position,
``subtype`` = algorithm for positions).  The nested document of the
reference is a view (:func:`nested_catalog`).  Catalogues are metadata
(bounded by the number of files), the small lists returned to the driver
by the listing helpers are the point of those helpers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOG_SCHEMA = "dataset string, source string, time string, kind string, subtype string, path string"


def merge_catalog(current: DataFrame, new: DataFrame) -> DataFrame:
    """CAT-1: add the snapshots (dataset, time) of ``new`` that ``current``
    lacks; a dataset already present keeps its ``source``; current rows
    first, then new ones."""
    have = current.select("dataset", "time").distinct()
    add = new.join(have, ["dataset", "time"], "left_anti")
    src = current.select("dataset", F.col("source").alias("_cur_source")).distinct()
    add = (add.join(src, "dataset", "left")
              .withColumn("source", F.coalesce(F.col("_cur_source"), F.col("source")))
              .drop("_cur_source"))
    # union keeps the partitions of ``current`` before those of ``add``
    return current.unionByName(add.select(*current.columns))


def datasets(cat: DataFrame) -> DataFrame:
    """CAT-2."""
    return cat.select("dataset").distinct()


def timestamps(cat: DataFrame, dataset: str) -> list[str]:
    """CAT-3/SORT-1: times of a dataset, ascending as strings (Q16)."""
    rows = cat.where(F.col("dataset") == dataset).select("time").distinct().orderBy("time").collect()
    return [r[0] for r in rows]


def algorithms(cat: DataFrame, dataset: str, time: str | None = None) -> list[str]:
    """CAT-4: position algorithms of a snapshot (default: first time)."""
    if time is None:
        ts = timestamps(cat, dataset)
        if not ts:
            return []
        time = ts[0]
    rows = (cat.where((F.col("dataset") == dataset) & (F.col("time") == time) & (F.col("kind") == "position"))
               .select("subtype").distinct().orderBy("subtype").collect())
    return [r[0] for r in rows]


def contexts(schema_doc: DataFrame) -> list[str]:
    """CAT-5: context ids of a schema document (the reference leaves this a
    stub returning nothing)."""
    row = schema_doc.select(F.map_keys("variantcontext").alias("k")).first()
    return sorted(row["k"]) if row and row["k"] else []


def snapshot_files(cat: DataFrame, dataset: str, time: str | None = None) -> DataFrame:
    """CAT-6/CAT-7: the files of one snapshot (default: first time); unknown
    dataset -> empty."""
    if time is None:
        ts = timestamps(cat, dataset)
        if not ts:
            return cat.limit(0)
        time = ts[0]
    return cat.where((F.col("dataset") == dataset) & (F.col("time") == time))


def has_data(cat: DataFrame) -> bool:
    """CAT-8."""
    return not cat.isEmpty()


def nested_catalog(cat: DataFrame) -> DataFrame:
    """The reference's nested document: ``(dataset, source, items
    ARRAY<STRUCT<time, algorithms STRUCT<feature, meta, schema, position
    MAP<algo, file>>>>)`` with times sorted as strings."""
    per_time = (cat.groupBy("dataset", "source", "time")
                   .agg(F.max(F.when(F.col("kind") == "feature", F.col("path"))).alias("feature"),
                        F.max(F.when(F.col("kind") == "meta", F.col("path"))).alias("meta"),
                        F.max(F.when(F.col("kind") == "schema", F.col("path"))).alias("schema"),
                        F.map_from_entries(F.filter(
                            F.collect_list(F.struct(F.col("subtype"), F.col("path"))),
                            lambda e: e["subtype"].isNotNull())).alias("position")))
    entries = F.collect_list(F.struct(
        F.col("time"), F.struct("feature", "meta", "schema", "position").alias("algorithms")))
    by_time = F.array_sort(entries, lambda a, b: F.when(a["time"] < b["time"], -1)
                           .when(a["time"] > b["time"], 1).otherwise(0))
    return per_time.groupBy("dataset", "source").agg(by_time.alias("items"))
