"""Batch preparation of a dataset snapshot (section 3.1 of the survey).

``read -> ID -> (schema | features | meta) -> positions -> write``.  The
typed table with its ``ID`` is first written once as Parquet under the
output folder (the CSV is parsed a single time; every later pass is a
column-pruned Parquet scan), then each artefact is written partitioned by
``dataset``/``time``/``run``, and the run is committed as the snapshot when all are
there.  Returns the catalogue rows of the new snapshot.
"""

from __future__ import annotations

import datetime as _dt
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.operators import encode, items, positions, profile
from featurescape.operators.embed import neighbor_embedding
from featurescape.session import materialize
from featurescape.sources import interchange, snapshots
from featurescape.sources.tables import read_table, with_id_path, write_table


def prepare_dataset(spark: SparkSession, path: str, out_dir: str, date: _dt.date | None = None,
                    fmt: str = "parquet", write_with_id_csv: bool = False, pca: bool = True,
                    dataset: str | None = None, neighbours: tuple[str, ...] = (), rounds: int = 30) -> DataFrame:
    """Writes and commits the snapshot.  ``neighbours`` names the neighbour embeddings to
    lay out as well, ``("umap", "tsne")`` for the complete set; they take ``rounds``
    passes over the items each and are left to the caller for that.  Items that share
    an id have one place there, that of the smallest features."""
    stem = dataset or re.sub(r"\.[^.]*$", "", os.path.basename(path.rstrip("/")))
    time, run = interchange.snapshot_time(date), snapshots.new_run()
    raw = read_table(spark, path)
    staged = f"{out_dir}/_staged/{stem}.{time}"
    raw.write.mode("overwrite").parquet(staged)          # one parse, then columnar passes
    raw = spark.read.parquet(staged)
    if write_with_id_csv:
        write_table(raw, with_id_path(path))             # SNK-1
    interchange.write_schema(items.derive_schema(raw), out_dir, stem, time, run=run)
    enc, model = encode.encode_features(raw)
    interchange.write_features(items.to_items(raw, model), out_dir, stem, time, fmt, run=run)
    interchange.write_meta(profile.build_meta(raw), out_dir, stem, time, run=run)
    sets = []
    proj = positions.projection_features(enc)
    if pca and len(proj.columns) >= 3:
        sets.append(positions.pca_positions(proj))
    geo = positions.geo_positions(raw)
    if geo is not None:
        sets.append(geo)
    pairs = positions.pair_positions(raw)
    if pairs is not None:
        sets.append(pairs)
    if pairs is not None and neighbours:                 # positions the table brings are kept
        given = {r[0] for r in pairs.select("algorithm").distinct().collect()}
        neighbours = tuple(m for m in neighbours if m not in given)
    if neighbours and len(proj.columns) >= 3:
        names = [c for c in proj.columns if c != "ID"]
        one = materialize(proj.groupBy("ID").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_one"))
                              .select("ID", "_one.*"))
        sets += [neighbor_embedding(one, method=m, cols=names, rounds=rounds) for m in neighbours]
    for s in sets:
        interchange.write_positions(s.select("algorithm", "ID", "x", "y"), out_dir, stem, time, fmt, run=run)
    return snapshots.commit(spark, out_dir, stem, time, run)
