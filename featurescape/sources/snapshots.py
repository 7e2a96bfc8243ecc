"""Snapshots as a unit (CAT-6, CAT-7 over SNK-2 ... SNK-5).

Every run writes its artefacts under a folder of its own (partition ``run=``).  A
manifest, one small file per snapshot that lists what belongs to it, is written
beside its place and put there by a rename as the last step: a reader sees the old
snapshot or the new one, and nothing of a run that ended half-way.  What earlier runs of
the snapshot left is removed after that.  Loading reads the files that the manifest, or
any other catalogue, lists, and no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.operators.catalog import CATALOG_SCHEMA, snapshot_files
from featurescape.sources import interchange
from featurescape.sources.paths import children, file_system

MANIFESTS = "_manifest"
_MANIFEST_SCHEMA = f"dataset string, time string, run string, source string, files array<struct<{CATALOG_SCHEMA}>>"


@dataclass
class Snapshot:
    """What a snapshot holds; parts that it does not have are None."""
    dataset: str
    time: str
    features: DataFrame | None = None      # FEATURE_SCHEMA
    positions: DataFrame | None = None     # algorithm, ID, x, y
    schema: DataFrame | None = None
    meta: DataFrame | None = None
    algorithms: tuple[str, ...] = ()


def new_run() -> str:
    return uuid.uuid4().hex


def _run_folders(spark: SparkSession, out_dir: str, dataset: str, time: str) -> list[tuple[str, str | None, str, str]]:
    """(kind, algorithm, run, path) of all that runs of a snapshot have written: a few listings."""
    found = []
    for kind in ("feature", "meta", "schema", "position"):
        for path in children(spark, f"{out_dir}/{kind}/dataset={dataset}/time={time}"):
            name = path.rsplit("/", 1)[-1]
            if name.startswith("run="):
                inner = [(None, path)] if kind != "position" else [
                    (p.rsplit("=", 1)[-1], p) for p in children(spark, path) if "/algorithm=" in p]
                found += [(kind, algorithm, name[4:], p) for algorithm, p in inner]
    return found


def commit(spark: SparkSession, out_dir: str, dataset: str, time: str, run: str, source: str = "local") -> DataFrame:
    """Make ``run`` the snapshot (dataset, time); its catalogue rows."""
    everything = _run_folders(spark, out_dir, dataset, time)
    files = [{"dataset": dataset, "source": source, "time": time, "kind": kind, "subtype": algorithm, "path": path}
             for kind, algorithm, r, path in everything if r == run]
    if not any(f["kind"] == "feature" for f in files):
        raise ValueError(f"run {run} has written no features of {dataset} at {time}")
    text = json.dumps({"dataset": dataset, "time": time, "run": run, "source": source, "files": files})
    place = f"{out_dir}/{MANIFESTS}/{dataset}.{time}.json"
    beside, fs = file_system(spark, f"{out_dir}/{MANIFESTS}/.{run}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, jvm.Path(place), options)
    for path in {p[:p.index(f"run={r}") + len(f"run={r}")] for _, _, r, p in everything if r != run}:
        at, fs = file_system(spark, path)
        fs.delete(at, True)
    return spark.createDataFrame([tuple(f.values()) for f in files], CATALOG_SCHEMA)


def catalogue(spark: SparkSession, out_dir: str) -> DataFrame:
    """Catalogue rows of all committed snapshots of a folder, from the manifests alone."""
    if not any(p.endswith(".json") for p in children(spark, f"{out_dir}/{MANIFESTS}")):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    rows = spark.read.schema(_MANIFEST_SCHEMA).json(f"{out_dir}/{MANIFESTS}/*.json")
    return rows.select(F.explode("files").alias("f")).select("f.*")


def load(spark: SparkSession, files: DataFrame, dataset: str, time: str | None = None) -> Snapshot | None:
    """The snapshot that a catalogue lists for (dataset, time; default: its first time).
    None if it lists none.  Single files are read as the interchange JSON documents,
    folders in this engine's layout."""
    rows = snapshot_files(files, dataset, time).collect()      # a row per file of one snapshot
    if not rows:
        return None
    found = Snapshot(dataset, rows[0]["time"])
    by_kind: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["subtype"] or "", r["path"])):
        by_kind.setdefault(r["kind"], []).append(r)

    def read(kind: str, single, schema: str, lines: bool) -> DataFrame | None:
        paths = [r["path"] for r in by_kind.get(kind, [])]
        if not paths:
            return None
        if all(p.endswith(".json") for p in paths):
            return single(spark, paths)
        return spark.read.schema(schema).format(_format(spark, paths[0], lines)).load(paths)

    found.features = read("feature", interchange.read_features, interchange.FEATURE_SCHEMA, False)
    found.meta = read("meta", interchange.read_meta, interchange.META_SCHEMA, True)
    found.schema = read("schema", interchange.read_schema, interchange.SCHEMA_SCHEMA, True)
    placed = by_kind.get("position", [])
    found.algorithms = tuple(dict.fromkeys(r["subtype"] for r in placed))
    for r in placed:
        if r["path"].endswith(".json"):
            one = interchange.read_positions(spark, [r["path"]]).select(F.lit(r["subtype"]).alias("algorithm"), "ID", "x", "y")
        else:
            one = (spark.read.schema(interchange.POSITION_SCHEMA).format(_format(spark, r["path"], False)).load(r["path"])
                   .select(F.lit(r["subtype"]).alias("algorithm"), F.col("id").alias("ID"), "position.x", "position.y"))
        found.positions = one if found.positions is None else found.positions.unionByName(one)
    return found


def _format(spark: SparkSession, folder: str, lines: bool) -> str:
    names = [p for p in children(spark, folder) if "/part-" in p]
    return "json" if (any(p.endswith(".json") for p in names) if names else lines) else "parquet"
