import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from featurescape.operators import catalog, items
from featurescape.plans.ingest import prepare_dataset
from featurescape.sources import interchange, snapshots


def _cars(folder, rows=30, name="cars"):
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w") as f:
        f.write("name,hp,weight,umap-x,umap-y\n")
        f.writelines(f"car{i},{100 + i * 3},{1000 + (i * 37) % 400},{i},{-i}\n" for i in range(rows))
    return path


def _ids(df):
    return sorted(int(r["id"]) for r in df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_load_returns_all_parts(spark, tmpdir_fresh, fmt):
    out = f"{tmpdir_fresh}/out"
    for day in (9, 10):
        prepare_dataset(spark, _cars(tmpdir_fresh, 20 + day), out, dt.date(2025, 7, day), fmt=fmt)
    files = snapshots.catalogue(spark, out)
    assert catalog.timestamps(files, "cars") == ["09072025", "10072025"]
    first = snapshots.load(spark, files, "cars")
    assert (first.time, first.algorithms) == ("09072025", ("pca", "umap"))
    assert _ids(first.features) == list(range(1, 30))
    assert first.features.columns == ["defaultcontext", "features", "id", "values"]
    assert first.positions.columns == ["algorithm", "ID", "x", "y"]
    assert {(r.algorithm, r.n) for r in first.positions.groupBy("algorithm").agg(F.count("*").alias("n")).collect()} == {
        ("pca", 29), ("umap", 29)}
    assert first.meta.first()["features"]["2"]["min"] == 100.0
    assert first.schema.first()["label"]["2"] == "hp"
    assert _ids(snapshots.load(spark, files, "cars", "10072025").features) == list(range(1, 31))
    assert snapshots.load(spark, files, "bikes") is None
    assert snapshots.load(spark, files, "cars", "01011999") is None


def test_neighbour_embeddings_in_a_snapshot(spark, tmpdir_fresh):
    out, day = f"{tmpdir_fresh}/out", dt.date(2025, 7, 9)
    path = os.path.join(tmpdir_fresh, "cars.csv")
    with open(path, "w") as f:
        f.write("id,hp,weight,tsne-x,tsne-y\n")
        f.writelines(f"car{i % 25},{100 + i * 3},{1000 + (i * 37) % 400},{i},{-i}\n" for i in range(30))
    files = prepare_dataset(spark, path, out, day, neighbours=("umap", "tsne"), rounds=2)
    loaded = snapshots.load(spark, files, "cars")
    rows = loaded.positions.collect()
    assert loaded.algorithms == ("pca", "tsne", "umap")
    assert sorted(r.ID for r in rows if r.algorithm == "umap") == sorted(f"car{i}" for i in range(25))
    assert all(r.x == r.x and r.y == r.y for r in rows)
    assert sorted(r.x for r in rows if r.algorithm == "tsne") == [float(i) for i in range(30)]     # as given


def test_a_run_that_ends_half_way_stays_invisible(spark, tmpdir_fresh, monkeypatch):
    out, day = f"{tmpdir_fresh}/out", dt.date(2025, 7, 9)
    assert snapshots.catalogue(spark, out).collect() == []
    prepare_dataset(spark, _cars(tmpdir_fresh, 30), out, day)
    before = snapshots.catalogue(spark, out).collect()

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(interchange, "write_positions", broken)
        with pytest.raises(RuntimeError):
            prepare_dataset(spark, _cars(tmpdir_fresh, 50), out, day)
    assert snapshots.catalogue(spark, out).collect() == before
    assert _ids(snapshots.load(spark, snapshots.catalogue(spark, out), "cars").features) == list(range(1, 31))
    prepare_dataset(spark, _cars(tmpdir_fresh, 40), out, day)              # replaces it, and clears up
    after = snapshots.load(spark, snapshots.catalogue(spark, out), "cars")
    assert _ids(after.features) == list(range(1, 41))
    assert _ids(spark.read.parquet(f"{out}/feature")) == list(range(1, 41))


def test_nothing_is_committed_without_features(spark, tmpdir_fresh):
    with pytest.raises(ValueError):
        snapshots.commit(spark, tmpdir_fresh, "cars", "09072025", snapshots.new_run())


def test_load_of_interchange_files(spark, tmpdir_fresh):
    def put(name, value):
        with open(os.path.join(tmpdir_fresh, name), "w") as f:
            json.dump(value, f, indent=2)
        return os.path.join(tmpdir_fresh, name)

    rows = [("feature", None, put("d.09072025.feature.json", [{"defaultcontext": "1", "features": {"1": {"1": 0.5}}, "id": 7,
                                                               "values": {"1": "x"}}])),
            ("position", "umap", put("d.09072025.position.umap.json", [{"id": 7, "position": {"x": 1.0, "y": 2.0}}])),
            ("position", "pca", put("d.09072025.position.pca.json", [{"id": 7, "position": {"x": 3.0, "y": 4.0}}]))]
    files = spark.createDataFrame([("d", "local", "09072025", *r) for r in rows], catalog.CATALOG_SCHEMA)
    got = snapshots.load(spark, files, "d")
    assert got.meta is None and got.schema is None and got.algorithms == ("pca", "umap")
    assert sorted(map(tuple, got.positions.collect())) == [("pca", "7", 3.0, 4.0), ("umap", "7", 1.0, 2.0)]
    assert got.features.first()["id"] == "7"
    joined = items.attach_positions(got.features.select(F.col("id").alias("ID")), got.positions, list(got.algorithms))
    assert joined.first()["pca_x"] == 3.0
