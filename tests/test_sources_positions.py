import datetime as dt
import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurescape.operators import catalog, encode, filters, items, positions
from featurescape.plans.ingest import prepare_dataset
from featurescape.sources import files, interchange, tables


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_table_types_like_pandas(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "mixed.csv")
    _write(p, "a,b,c,d,e,f,g,x,x\n"
              "1,1,1.5,True,True,2024-01-02,foo,1,2\n"
              "2,,2.5,False,,2024-01-03,NA,3,4\n"
              "3,7,n/a,True,False,2024-01-04,-,5,6\n")
    df = tables.read_table(spark, p)
    assert df.columns[:1] == ["ID"] and "x.1" in df.columns
    types = dict(df.dtypes)
    assert types["a"] == "bigint" and types["b"] == "double" and types["c"] == "double"
    assert types["d"] == "boolean" and types["e"] == "string" and types["f"] == "string"
    rows = df.orderBy("_ord").collect()
    assert [r["ID"] for r in rows] == ["1", "2", "3"]
    assert rows[1]["g"] is None and rows[2]["g"] == "-"
    vals = df.select(items.raw_values(df).alias("v")).orderBy(F.col("v")["1"]).collect()
    assert vals[1]["v"]["2"] == "nan" and vals[0]["v"]["2"] == "1.0" and vals[0]["v"]["4"] == "True"


def test_missing_input(spark):
    with pytest.raises(tables.MissingInputError):
        tables.read_table(spark, "/nonexistent/file.csv")


def test_ids_follow_file_order_across_files(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "multi")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), "v\n" + "\n".join(str(i) for i in range(5)) + "\n")
    _write(os.path.join(d, "b.csv"), "v\n" + "\n".join(str(i) for i in range(5, 300)) + "\n")
    df = tables.read_table(spark, d)
    got = sorted((int(r["ID"]), r["v"]) for r in df.collect())
    assert got == [(i + 1, i) for i in range(300)]


def test_geo_and_pair_positions(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2", 1.0, "x", 3.0, None), ("2", "bad", "3", 2.0, "4", None, 1.0),
         ("3", " 7 ", "8", None, "5", 4.0, 2.0)],
        "ID string, Lon string, LAT string, `Map-X` double, `map-y` string, `foo-x` double, `bar-y` double")
    geo = {r["ID"]: (r["x"], r["y"]) for r in positions.geo_positions(df).collect()}
    assert geo == {"1": (1.5, 2.0), "3": (7.0, 8.0)}
    pairs = positions.pair_positions(df).collect()
    assert [(r["algorithm"], r["ID"], r["x"], r["y"]) for r in pairs] == [("map", "2", 2.0, 4.0)]
    assert positions.geo_positions(df.drop("LAT")) is None


def test_scale_degenerate_extent(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 5.0)], "ID string, x double, y double")
    assert {(r["x"], r["y"]) for r in positions.scale_positions(df, 100, 50).collect()} == {(0.0, 0.0)}
    df2 = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 4.0)], "ID string, x double, y double")
    assert sorted((r["x"], r["y"]) for r in positions.scale_positions(df2, 100, 50).collect()) == [
        (-50.0, -25.0), (50.0, 25.0)]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 10
    df = spark.createDataFrame([(str(i), *map(float, row)) for i, row in enumerate(x)],
                               "ID string, a double, b double, c double, d double, e double")
    got = np.array([[r["x"], r["y"]] for r in positions.pca_positions(df).orderBy(F.col("ID").cast("int")).collect()])
    xc = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    for j in range(2):
        v = vt[j]
        if v[np.argmax(np.abs(v))] < 0:
            v = -v
        assert np.allclose(got[:, j], xc @ v, atol=1e-6)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-8)


def test_positions_settled(spark):
    a = spark.createDataFrame([("1", 0.0, 0.0), ("2", 1.0, 1.0)], "ID string, x double, y double")
    b = spark.createDataFrame([("1", 0.005, 0.0), ("2", 1.0, 1.02)], "ID string, x double, y double")
    assert positions.positions_settled(a, a).first()["settled"]
    assert not positions.positions_settled(a, b).first()["settled"]


def test_attach_positions_last_wins_and_duplicate_items(spark):
    it = spark.createDataFrame([("a",), ("a",), ("b",)], "ID string")
    pos = spark.createDataFrame([("p", "a", 1.0, 1.0, 0), ("p", "a", 2.0, 2.0, 1), ("p", "c", 9.0, 9.0, 2)],
                                "algorithm string, ID string, x double, y double, _pord long")
    out = items.attach_positions(it, pos, ["p"], order_col="_pord").collect()
    got = sorted((r["ID"], r["p_x"]) for r in out)
    assert got == [("a", 2.0), ("a", 2.0), ("b", None)]


def test_catalog_merge_and_listing(spark):
    cur = spark.createDataFrame([("wine", "local", "09072025", "feature", None, "f1")], catalog.CATALOG_SCHEMA)
    new = spark.createDataFrame([("wine", "wasm", "09072025", "feature", None, "f2"),
                                 ("wine", "wasm", "10072025", "feature", None, "f3"),
                                 ("cars", "wasm", "01012024", "position", "pca", "f4")], catalog.CATALOG_SCHEMA)
    m = catalog.merge_catalog(cur, new)
    rows = {(r["dataset"], r["time"]): (r["source"], r["path"]) for r in m.collect()}
    assert rows == {("wine", "09072025"): ("local", "f1"), ("wine", "10072025"): ("local", "f3"),
                    ("cars", "01012024"): ("wasm", "f4")}
    assert catalog.timestamps(m, "wine") == ["09072025", "10072025"]
    assert catalog.algorithms(m, "cars") == ["pca"]
    assert catalog.has_data(m) and not catalog.has_data(m.limit(0))
    assert catalog.snapshot_files(m, "nope").count() == 0
    nested = catalog.nested_catalog(m).where("dataset = 'cars'").first()
    assert nested["items"][0]["algorithms"]["position"] == {"pca": "f4"}


def test_discover_reference_file_names(spark, tmpdir_fresh):
    for n in ["wine.09072025.feature.json", "wine.09072025.position.pca.json", "wine.09072025.position.my-algo.json",
              "wine.0907202.meta.json", "wine.10072025.schema.json", "notes.txt"]:
        _write(os.path.join(tmpdir_fresh, n), "[]")
    rows = {(r["dataset"], r["time"], r["kind"], r["subtype"]) for r in files.discover(spark, tmpdir_fresh).collect()}
    assert rows == {("wine", "09072025", "feature", None), ("wine", "09072025", "position", "pca"),
                    ("wine", "10072025", "schema", None)}


def test_read_reference_json_files(spark, tmpdir_fresh):
    feat = [{"defaultcontext": "1", "features": {"1": {"1": 0.5}}, "id": 7, "values": {"1": "x"}}]
    _write(os.path.join(tmpdir_fresh, "d.09072025.feature.json"), json.dumps(feat, indent=4))
    pos = [{"id": 7, "position": {"x": 1.0, "y": 2.0}}]
    _write(os.path.join(tmpdir_fresh, "d.09072025.position.umap.json"), json.dumps(pos, indent=4))
    meta = {"features": {"1": {"histogram": {"0": 1.0}, "max": 1.0, "min": 0.0, "median": 0.5,
                               "variance": 0.1, "deviation": 0.3}}}
    _write(os.path.join(tmpdir_fresh, "d.09072025.meta.json"), json.dumps(meta))
    f = interchange.read_features(spark, os.path.join(tmpdir_fresh, "d.09072025.feature.json")).first()
    assert f["id"] == "7" and f["features"]["1"]["1"] == 0.5
    p = interchange.read_positions(spark, [os.path.join(tmpdir_fresh, "d.09072025.position.umap.json")]).first()
    assert (p["algorithm"], p["ID"], p["x"]) == ("umap", "7", 1.0)
    m = interchange.read_meta(spark, os.path.join(tmpdir_fresh, "d.09072025.meta.json")).first()
    assert m["features"]["1"]["median"] == 0.5


def test_thumbnails_and_archives(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "thumbs")
    os.makedirs(d)
    for n in ["1.jpg", "2.PNG", "3.txt"]:
        with open(os.path.join(d, n), "wb") as f:
            f.write(b"img" + n.encode())
    th = {r["id"]: r["mime"] for r in files.read_thumbnails(spark, d).collect()}
    assert th == {"1": "image/jpeg", "2": "application/octet-stream"}
    z = os.path.join(tmpdir_fresh, "zips")
    os.makedirs(z)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("a/1.jpg", b"first")
        zf.writestr("b/1.jpg", b"second")
        zf.writestr("b/", b"")
        zf.writestr("c/readme.txt", b"t")
    with open(os.path.join(z, "pics.zip"), "wb") as f:
        f.write(buf.getvalue())
    rows = {(r["archive"], r["name"]): bytes(r["content"]) for r in files.unpack_archives(spark, z).collect()}
    assert rows == {("pics", "1.jpg"): b"second", ("pics", "readme.txt"): b"t"}
    assert files.unpack_archives(spark, z, images_only=True).count() == 1


def test_prepare_dataset_end_to_end(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "cars.csv")
    _write(p, "name,hp,weight,lon,lat,umap-x,umap-y\n"
              + "\n".join(f"car{i},{100 + i * 3},{1000 + (i * 37) % 400},{8 + i * 0.1},{48 + i * 0.05},{i},{-i}"
                          for i in range(40)) + "\n")
    out = os.path.join(tmpdir_fresh, "out")
    cat = prepare_dataset(spark, p, out, date=dt.date(2025, 7, 9))
    kinds = {(r["kind"], r["subtype"]) for r in cat.collect()}
    assert kinds == {("feature", None), ("meta", None), ("schema", None), ("position", "pca"),
                     ("position", "epsg"), ("position", "umap")}
    pos = interchange.read_snapshot_positions(spark, out, "cars", "09072025")
    assert pos.where("algorithm = 'umap'").count() == 40
    feats = spark.read.parquet(f"{out}/feature").where("dataset = 'cars'")
    r = feats.where("id = '1'").first()
    assert r["values"]["1"] == "car0" and r["features"]["1"]["2"] == 0.0


def test_streaming_marks_passive(spark, tmpdir_fresh):
    from featurescape.streaming.live import mark_passive_stream, surviving_counts
    src = os.path.join(tmpdir_fresh, "stream")
    hist = spark.createDataFrame([("1", "a", 0.0), ("2", "b", 10.0)], "ID string, kind string, v double")
    model = encode.fit_encoder(hist)
    batch = spark.createDataFrame([("3", "a", 5.0, dt.datetime(2024, 1, 1, 10)),
                                   ("4", "b", 9.0, dt.datetime(2024, 1, 1, 11))],
                                  "ID string, kind string, v double, ts timestamp")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    marked = mark_passive_stream(stream, model, [filters.FeatureFilter("v", 0.4, 0.6)], keep=("ts",))
    q = marked.writeStream.format("memory").queryName("live_marks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["ID"]: r["passive"] for r in spark.sql("select * from live_marks").collect()}
    assert got == {"3": False, "4": True}
    counts = surviving_counts(marked, "ts")
    q2 = counts.writeStream.format("memory").queryName("live_counts").outputMode("complete").start()
    q2.processAllAvailable()
    q2.stop()
    c = spark.sql("select * from live_counts").first()
    assert (c["total"], c["surviving"]) == (2, 1)


def test_ids_follow_file_order_across_splits(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "big.csv")
    _write(p, "v,w\n" + "\n".join(f"{i},{'x' * 20}" for i in range(2000)) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = tables.read_table(spark, p)
        assert df.rdd.getNumPartitions() > 5
        got = sorted((int(r["ID"]), r["v"]) for r in df.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(i + 1, i) for i in range(2000)]


def test_items_round_trip_thumbnails_labels_and_selection(spark, tmpdir_fresh):
    raw = spark.createDataFrame([("1", "red", 2.0), ("2", "blue", 4.0)], "ID string, colour string, size double")
    model = encode.fit_encoder(raw)
    rec = items.to_items(raw, model)
    long = {(r["id"], r["feature_id"]): (r["value"], r["raw"]) for r in items.from_items(rec).collect()}
    assert long[("1", "1")] == (1.0, "red") and long[("2", "2")] == (1.0, "4.0")
    labels = items.labels_frame(raw)
    lab = {r["feature_id"]: r["label"] for r in items.with_labels(
        spark.createDataFrame([("1",), ("9",)], "feature_id string"), labels).collect()}
    assert lab == {"1": "colour", "9": "9"}
    det = items.item_details(rec, labels, id_value="2").collect()
    assert sorted((r["label"], r["value"]) for r in det) == [("colour", "blue"), ("size", "4.0")]
    thumbs = spark.createDataFrame([("1", "/t/1.jpg", "image/jpeg", b"x")],
                                   "id string, path string, mime string, content binary")
    th = {r["ID"]: r["mime"] for r in items.attach_thumbnails(raw, thumbs).collect()}
    assert th == {"1": "image/jpeg", "2": None}
    assert catalog.contexts(items.derive_schema(raw)) == ["1"]
    sch = items.derive_schema(raw).first()
    assert (sch["color"], sch["glyph"], sch["label"]) == ("1", ["1", "2"], {"1": "colour", "2": "size"})
    pos = spark.createDataFrame([("d", "t1", "pca", "1", 0.0, 0.0), ("d", "t1", "umap", "1", 1.0, 1.0),
                                 ("d", "t2", "pca", "1", 5.0, 5.0)],
                                "dataset string, time string, algorithm string, ID string, x double, y double")
    cat = spark.createDataFrame([("d", "local", "t1", "position", "pca", "p"), ("d", "local", "t2", "position", "pca", "q")],
                                catalog.CATALOG_SCHEMA)
    sel = positions.select_positions(pos, cat, "d").collect()
    assert [(r["time"], r["algorithm"], r["x"]) for r in sel] == [("t1", "pca", 0.0)]
    out = os.path.join(tmpdir_fresh, "cat")
    interchange.write_catalog(cat, out)
    assert spark.read.json(out).count() == 2
    assert interchange.snapshot_base("cars", dt.date(2025, 7, 9)) == "cars.09072025"


def test_small_public_operators(spark, tmpdir_fresh):
    from featurescape.functions import view
    from featurescape.operators import cluster
    # FE-2 / FE-4
    df = spark.createDataFrame([("1", "b", 2.0), ("2", "a", 4.0), ("3", None, 6.0)], "ID string, t string, x double")
    coded, dic = encode.label_encode(df, ["t"])
    assert {r["ID"]: r["t"] for r in coded.collect()} == {"1": 2, "2": 1, "3": 0}
    assert {r["ID"]: r["x"] for r in encode.minmax(df, ["x"]).collect()} == {"1": 0.0, "2": 0.5, "3": 1.0}
    # FLT-6 / FLT-10 (Column form) / CL-4 / CAT-2
    a = spark.createDataFrame([("1",), ("2",)], "ID string")
    b = spark.createDataFrame([("2",), ("3",)], "ID string")
    assert sorted(r["ID"] for r in filters.idset_add(a, b).collect()) == ["1", "2", "3"]
    assert sorted(r["ID"] for r in filters.idset_remove(a, b).collect()) == ["1"]
    lo, hi = filters.brush_range_cols(F.lit(0.2137), F.lit(0.5821))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r["lo"], 9), round(r["hi"], 9)) == (0.2, 0.6)
    cl = spark.createDataFrame([("1", True, False), ("2", True, True), ("3", False, False)],
                               "ID string, clustered boolean, representative boolean")
    assert sorted(r["ID"] for r in cluster.aggregated_view(cl).collect()) == ["2", "3"]
    cat = spark.createDataFrame([("d", "local", "t", "feature", None, "p"), ("e", "local", "t", "meta", None, "q"),
                                 ("d", "local", "u", "meta", None, "r")], catalog.CATALOG_SCHEMA)
    assert sorted(r["dataset"] for r in catalog.datasets(cat).collect()) == ["d", "e"]
    # SC-9 round trip, SC-15
    pts = spark.createDataFrame([(3.0, -4.0), (-100.0, 20.0)], "x double, y double")
    sx, sy = view.world_to_screen(F.col("x"), F.col("y"), 1.0, 2.0, 1.5, 1600, 900)
    back = pts.select(sx.alias("sx"), sy.alias("sy")).select(
        *view.screen_to_world(F.col("sx"), F.col("sy"), 1.0, 2.0, 1.5, 1600, 900)).collect()
    assert [(round(p[0], 9), round(p[1], 9)) for p in back] == [(3.0, -4.0), (-100.0, 20.0)]
    z = spark.range(1).select(view.fit_zoom(F.lit(100.0), F.lit(10.0), 1600.0, 900.0)).first()[0]
    assert z == pytest.approx(min(1600 / 110.0, 900 / 11.0))
    # SRC-5
    p = os.path.join(tmpdir_fresh, "d.09072025.schema.json")
    _write(p, json.dumps({"color": "1", "glyph": ["1"], "label": {"1": "a"}, "tooltip": ["1"],
                          "variantcontext": {"1": {"description": "standard context", "id": "1"}}}))
    s = interchange.read_schema(spark, p).first()
    assert s["label"] == {"1": "a"} and catalog.contexts(interchange.read_schema(spark, p)) == ["1"]


def test_snapshot_reads_prune_partitions(spark, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "layout")
    pos = spark.createDataFrame([("pca", str(i), float(i), float(-i)) for i in range(10)],
                                "algorithm string, ID string, x double, y double")
    interchange.write_positions(pos, out, "cars", "09072025")
    interchange.write_positions(pos, out, "cars", "10072025")
    interchange.write_positions(pos.withColumn("algorithm", F.lit("my-algo")), out, "wine", "09072025")
    df = interchange.read_snapshot_positions(spark, out, "cars", "10072025").where(F.col("algorithm") == "pca")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dataset" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert df.count() == 10
    algos = {r["algorithm"] for r in interchange.read_snapshot_positions(spark, out, "wine").collect()}
    assert algos == {"my_algo"}                      # sanitised on write (Q17)


def test_row_numbers_survive_a_change_of_splits(spark, tmpdir_fresh):
    import os

    from featurescape.operators.ids import ensure_id
    from featurescape.sources.tables import read_table

    path = os.path.join(tmpdir_fresh, "big.csv")
    with open(path, "w") as f:
        f.write("name,value\n" + "".join(f"n{i:06d},{i}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for source in ("csv", "parquet"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(400_000))
            if source == "csv":
                table = read_table(spark, path)
            else:
                spark.read.csv(path, header=True).coalesce(1).write.parquet(path + ".parquet")
                table = ensure_id(spark.read.parquet(path + ".parquet"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(300_000))
            rows = table.select("ID", "name").collect()
            assert len(rows) == 60_000
            assert all(r["ID"] == str(int(r["name"][1:]) + 1) for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_second_run_replaces_the_snapshot(spark, tmpdir_fresh):
    import datetime
    import os

    from featurescape.plans.ingest import prepare_dataset

    path = os.path.join(tmpdir_fresh, "cars.csv")
    with open(path, "w") as f:
        f.write("id,a,b\n" + "".join(f"c{i},{i},{i * i}\n" for i in range(20)))
    out = os.path.join(tmpdir_fresh, "out")
    for day in (1, 1, 2):
        prepare_dataset(spark, path, out, datetime.date(2026, 1, day))
    for kind, n in (("feature", 20), ("position", 20)):
        rows = spark.read.parquet(f"{out}/{kind}").groupBy("time").count().collect()
        assert [r["count"] for r in rows] == [n, n]
    assert spark.read.json(f"{out}/meta").count() == 2


def test_scaling_keeps_sets_with_a_null_key(spark, monkeypatch):
    from featurescape.operators import positions
    df = spark.createDataFrame([(None, "a", 0.0, 0.0), (None, "b", 2.0, 4.0), ("p", "c", 1.0, 1.0),
                                ("p", "d", 3.0, 5.0)], "algorithm string, ID string, x double, y double")
    few = sorted(map(str, positions.scale_positions(df, 100.0, 50.0, by=["algorithm"]).collect()))
    monkeypatch.setattr(positions, "LITERAL_SETS", 0)
    many = positions.scale_positions(df, 100.0, 50.0, by=["algorithm"]).collect()
    assert sorted(map(str, many)) == few
    assert {r.ID: (r.x, r.y) for r in many} == {"a": (-50.0, -25.0), "b": (50.0, 25.0),
                                                "c": (-50.0, -25.0), "d": (50.0, 25.0)}


def test_doubled_quotes_in_csv(spark, tmp_path):
    from featurescape.sources import tables
    path = tmp_path / "quoted.csv"
    path.write_text('ID,"the ""name"""\n1,"a ""b"" c"\n2,"x, ""y"""\n3,plain\n')
    df = tables.read_csv_text(spark, str(path))
    assert df.columns[:2] == ["ID", 'the "name"']
    assert [r[1] for r in df.orderBy("ID").collect()] == ['a "b" c', 'x, "y"', "plain"]
