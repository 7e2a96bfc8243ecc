import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from event_log import tasks_of
from featurescape.operators import encode, profile
from featurescape.operators.ids import ensure_id
from featurescape.session import materialize


def test_label_codes_follow_code_point_order_and_nulls_as_zero(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "é"), ("3", None), ("4", "B"), ("5", "a"), ("6", "0")],
                               "ID string, cat string")
    enc, model = encode.encode_features(df)
    got = {r["ID"]: r["cat"] for r in enc.collect()}
    # '0'(and null) < 'B' < 'a' < 'b' < 'é' -> codes 0..4, normalised by 4
    assert got == {"6": 0.0, "3": 0.0, "4": 0.25, "5": 0.5, "1": 0.75, "2": 1.0}
    d = {(r["value"], r["code"]) for r in model.dictionary.collect()}
    assert d == {("0", 0), ("B", 1), ("a", 2), ("b", 3), ("é", 4)}


def test_large_dictionary_path_equals_small_path(spark):
    rows = [(str(i), f"v{(i * 7919) % 257:03d}", f"w{i % 13}") for i in range(600)]
    df = spark.createDataFrame(rows, "ID string, a string, b string")
    specs = [encode.FeatureSpec("1", "a", "text"), encode.FeatureSpec("2", "b", "text")]
    small, _ = encode.build_dictionary(df, specs)
    large, sizes = encode.build_dictionary(df, specs, small_rows=0)
    assert sizes == {"1": 257, "2": 13}
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_constant_threshold_and_booleans(spark):
    df = spark.createDataFrame([("1", 3.0, 0.0, True), ("2", 3.0, 0.0005, False), ("3", 3.0, 1.0, None),
                                ("4", 3.0, 0.5, True)], "ID string, c double, t double, flag boolean")
    enc, _ = encode.encode_features(df)
    got = {r["ID"]: (r["c"], r["t"], r["flag"]) for r in enc.collect()}
    assert all(v[0] == 0.0 for v in got.values())
    assert got["2"][1] == 0.0          # 0.0005 < 1e-3 -> 0
    assert got["4"][1] == 0.5
    assert got["1"][2] == 1.0 and got["3"][2] == 0.0   # null bool -> 0


def test_tiny_values_strict_threshold(spark):
    vals = [0.0, 0.0005, 0.001, 0.0015, 1.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "ID string, t double")
    enc, _ = encode.encode_features(df)
    got = {r["ID"]: r["t"] for r in enc.collect()}
    assert [got[str(i)] for i in range(5)] == [0.0, 0.0, 0.001, 0.0015, 1.0]   # |v| < 1e-3 -> 0


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "a double")
    z = [r["a"] for r in encode.standardize(df, ["a"]).collect()]
    x = np.array([1, 2, 3, 4.0])
    assert np.allclose(z, (x - x.mean()) / x.std())
    c = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert [r["a"] for r in encode.standardize(c, ["a"]).collect()] == [0.0, 0.0]


def test_median_even_and_odd(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    st = profile.profile_stats(df, ["v"])
    assert st[0].median == 2.5
    df = spark.createDataFrame([(1.0,), (2.0,), (30.0,)], "v double")
    assert profile.profile_stats(df, ["v"])[0].median == 2.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_median_matches_numpy_with_duplicates_and_skew(spark, seed):
    rng = np.random.default_rng(seed)
    hot = np.full(400, 7.25)                      # a third of the rows share one value
    vals = np.concatenate([hot, rng.normal(size=500) * 1e6, rng.integers(0, 5, 300).astype(float)])
    rng.shuffle(vals)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(7)
    st = profile.profile_stats(df, ["v"])[0]
    assert st.median == float(np.median(vals))
    assert st.lo == vals.min() and st.hi == vals.max()
    assert math.isclose(st.variance, vals.var(), rel_tol=1e-9)


@pytest.mark.parametrize("seed", [5, 6])
def test_histogram_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.exponential(size=700)
    b = np.round(np.arange(0, 0.1001, 0.01), 2)   # bin edges where the naive formula is off
    b = np.concatenate([b] * 20)
    c = np.full(50, 3.0)                          # constant -> [v-0.5, v+0.5]
    n = max(len(a), len(b), len(c))
    rows = [(float(a[i % len(a)]), float(b[i % len(b)]), float(c[i % len(c)])) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    h = {(r["name"], r["bin"]): (r["count"], r["density"]) for r in profile.histogram(df, ["a", "b", "c"]).collect()}
    for name, i in (("a", 0), ("b", 1), ("c", 2)):
        col = np.array([r[i] for r in rows])
        counts, _ = np.histogram(col, bins=50)
        dens, _ = np.histogram(col, bins=50, density=True)
        for k in range(50):
            assert h[(name, k)][0] == counts[k], (name, k)
            assert math.isclose(h[(name, k)][1], dens[k], rel_tol=1e-12, abs_tol=1e-15)
    assert h[("c", 25)][1] == pytest.approx(50.0)


def test_infinite_values_raise(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    with pytest.raises(profile.NonFiniteValuesError):
        profile.histogram(df, ["v"])


def test_meta_document_integrates_to_one(spark):
    df = spark.createDataFrame([(str(i), float(i % 17), f"t{i % 3}") for i in range(200)],
                               "ID string, x double, s string")
    meta = profile.build_meta(df).collect()[0]["features"]
    assert set(meta) == {"1", "2"}
    f1 = meta["1"]
    assert len(f1["histogram"]) == 50
    width = (f1["max"] - f1["min"]) / 50
    assert sum(f1["histogram"].values()) * width == pytest.approx(1.0)
    # text is coerced to numbers -> all zeros -> constant column
    assert meta["2"]["min"] == 0.0 and meta["2"]["histogram"]["25"] == pytest.approx(50.0)


def test_ensure_id_variants(spark):
    a = spark.createDataFrame([(" 7 ", 1.0)], "` Id ` string, x double")
    assert ensure_id(a).columns == ["ID", "x"]
    b = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    out = ensure_id(b)
    assert out.columns == ["ID", "x", "y"] and out.first()["ID"] == "1"
    c = spark.createDataFrame([(1.0, "a")], "x double, ID string")
    with pytest.raises(ValueError):
        ensure_id(c)
    d = spark.createDataFrame([(3.0, 1.0)], "id double, x double")
    assert ensure_id(d).first()["ID"] == "3"


def test_row_numbers_follow_partition_order(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.col("id").alias("v"))
    out = ensure_id(df)
    assert all(int(r["ID"]) == r["v"] + 1 for r in out.collect())


def test_transform_without_broadcast_matches(spark):
    rows = [(str(i), f"k{(i * 31) % 97}", float(i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "ID string, t string, x double")
    small = encode.fit_encoder(df)
    big = encode.fit_encoder(df, broadcast_rows=0)
    a = sorted(map(tuple, small.transform(df).collect()))
    b_df = big.transform(df)
    assert a == sorted(map(tuple, b_df.collect()))


def test_global_index_is_dense_and_ordered(spark):
    from featurescape.operators.ids import with_global_index
    df = spark.createDataFrame([(f"v{(i * 7) % 500:04d}",) for i in range(500)], "v string").repartition(5)
    out = sorted((r["idx"], r["v"]) for r in with_global_index(df, ["v"], num_partitions=4).collect())
    assert [i for i, _ in out] == list(range(500))
    assert [v for _, v in out] == sorted(v for _, v in out)


def test_underscore_user_columns_are_features(spark):
    df = spark.createDataFrame([("1", 1.0, "a"), ("2", 3.0, "b")], "ID string, _score double, _tag string")
    enc, model = encode.encode_features(df)
    assert [s.name for s in model.features] == ["_score", "_tag"]
    assert sorted(r["_score"] for r in enc.collect()) == [0.0, 1.0]


def test_median_of_a_range_wider_than_a_double(spark):
    from featurescape.operators import profile
    values = [-1.7e308, -1.0, 3.0, 8.0, 1.7e308]
    num = spark.createDataFrame([(v,) for v in values], "f1 double")
    stats = [profile.ColumnStats("1", "v", len(values), min(values), max(values), 0.0, 0.0)]
    assert profile.exact_medians(num, stats) == {"1": 3.0}


@pytest.mark.parametrize("kind", ["lognormal", "ties", "two", "tiny", "spike"])
def test_median_takes_three_scans(spark, kind):
    rng = np.random.default_rng(4)
    x = {"lognormal": rng.lognormal(0, 3, 40001), "ties": rng.integers(0, 3, 40000) * 1.0, "two": np.array([1.0, 2.0]),
         "tiny": rng.normal(size=7), "spike": np.concatenate([rng.uniform(0.5, 0.5 + 1e-9, 30000), [1e12, -1e12]])}[kind]
    df = materialize(spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double"))
    with tasks_of(spark) as stages:
        got = [s.median for s in profile.profile_stats(df, ["a", "b"])]
    assert got == [float(np.median(x)), float(-np.median(x))]
    assert len(x) < 1000 or 2 * len(x) <= sum(stages.scanned) < 3.4 * len(x)   # distinct values are read again


def test_median_when_the_sketch_is_off(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1001)], "a double")
    num = profile.numeric_view(df, ["a"])
    for bracket in ((900.0, 950.0), (3.0, 4.0), (500.0, 500.0), (-5.0, -4.0), None):
        stats = profile.basic_stats(num, ["a"])
        stats[0].bracket = bracket
        assert profile.exact_medians(num, stats) == {"1": 500.0}


@pytest.mark.parametrize("options", [{"broadcast_rows": 0}, {"broadcast_bytes": 0}, {"broadcast_bytes": 260}])
def test_large_text_columns_are_coded_in_one_exchange(spark, options):
    rows = [(str(i % 7), f"v{i % 40:02d}" if i % 5 else None, "hot" if i % 3 else f"w{i}", float(i), f"{i % 2}", i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "ID string, a string, b string, n double, _c1 string, _row long")
    df = df.repartition(5)
    want = sorted(map(tuple, encode.fit_encoder(df).transform(df).collect()))
    model = encode.fit_encoder(df, **options)
    coded = model.transform(df)
    assert coded.columns == ["ID", "a", "b", "n", "_c1", "_row"]
    assert sorted(map(tuple, coded.collect())) == want
    assert model.transform(df.where("false")).collect() == []


def test_wide_rows_move_once_however_many_text_columns(spark):
    """Joins of the wide rows: one, beside the one of their cells with the dictionary."""
    for columns in (3, 8):
        df = spark.range(200).select(F.col("id").cast("string").alias("ID"), *[
            F.concat(F.lit("v"), (F.col("id") * (i + 3) % 150).cast("string")).alias(f"t{i}") for i in range(columns)])
        model = encode.fit_encoder(df, broadcast_bytes=0)
        plan = model.transform(df)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 2
