import math

import pytest
from pyspark.sql import functions as F

from featurescape.functions import colors, glyph, numbers, view
from featurescape.operators import filters
from featurescape.operators.filters import FeatureFilter, FilterMode, IdFilter, TextFilter


@pytest.fixture()
def items(spark):
    rows = [("1", 0.1, 1.0, {"1": "Red", "2": "x"}),
            ("2", 0.5, 0.0, {"1": "blue", "2": "y"}),
            ("3", None, 1.0, {"1": "RED", "2": None}),
            ("4", float("nan"), 0.0, {"1": "green", "2": "z"}),
            ("5", 0.9, 1.0, {"1": "red", "2": "q"}),
            ("6", 0.0, 0.0, {"1": "Blue", "2": "w"})]
    return spark.createDataFrame(rows, "ID string, a double, b double, values map<string,string>")


def passive(df, fs):
    return {r["ID"]: r["passive"] for r in filters.mark_passive(df, fs).collect()}


def test_all_empty_passes_everything(items):
    f = FeatureFilter("a")
    f.clear()
    assert set(passive(items, [f, TextFilter(), IdFilter()]).values()) == {False}
    assert set(passive(items, []).values()) == {False}


def test_range_null_nan_never_pass(items):
    got = passive(items, [FeatureFilter("a", 0.0, 0.5)])
    assert got == {"1": False, "2": False, "3": True, "4": True, "5": True, "6": False}


def test_fresh_feature_filter_is_zero_zero_and_not_empty(items):
    f = FeatureFilter("a")
    assert not f.empty
    assert passive(items, [f]) == {"1": True, "2": True, "3": True, "4": True, "5": True, "6": False}


def test_and_or_composition(items):
    fs = [FeatureFilter("b", 1.0, 1.0), TextFilter(["RED"]),
          IdFilter(["3"]), IdFilter(["5", "1"], mode=FilterMode.OR)]
    got = passive(items, fs)
    # b == 1 AND value 'red' AND (id 3 OR id in {1,5})
    assert [k for k, v in got.items() if not v] == ["1", "3", "5"]


def test_text_filter_whole_value_and_terms(items):
    t = TextFilter(["Re"])
    assert all(passive(items, [t]).values())   # no substring match
    t.add_term("  BLUE ")
    assert t.terms == ["blue", "re"]
    t.remove("re")
    assert [k for k, v in passive(items, [t]).items() if not v] == ["2", "6"]


def test_id_filter_from_dataframe(spark, items):
    ids = spark.createDataFrame([("2",), ("4",), ("4",)], "ID string")
    assert [k for k, v in passive(items, [IdFilter(ids)]).items() if not v] == ["2", "4"]


def test_bounds_validation():
    with pytest.raises(ValueError):
        FeatureFilter("a", -0.1, 0.5)
    with pytest.raises(ValueError):
        FeatureFilter("a").set_range(0.2, 1.5)


def test_brush_range_and_bins(spark):
    assert filters.brush_range(0.2137, 0.5821) == (pytest.approx(0.2), pytest.approx(0.6))
    assert filters.brush_range(0.0, 0.999)[1] == 1.0
    df = spark.range(50).select(F.col("id").alias("bin"))
    sel = [r["bin"] for r in df.where(filters.brushed_bins(F.col("bin"), F.lit(10.2), F.lit(12))).collect()]
    assert sel == [10, 11, 12]


def test_filter_set_clear_and_counts(spark, items):
    s = filters.FilterSet([FeatureFilter("a", 0, 1), TextFilter(["red"]), IdFilter(["1"])])
    s.clear_ids()
    assert s.filters[2].empty
    s.remove_feature("a")
    assert len(s.filters) == 2
    s.clear()
    assert s.filters == []
    c = filters.filter_counts(filters.mark_passive(items, [FeatureFilter("a", 0, 0.5)])).collect()[0]
    assert (c["total"], c["surviving"]) == (6, 3)


def test_idset_toggle_and_same_members(spark):
    a = spark.createDataFrame([("1",), ("2",)], "ID string")
    b = spark.createDataFrame([("2",), ("3",)], "ID string")
    assert sorted(r["ID"] for r in filters.idset_toggle(a, b).collect()) == ["1", "3"]
    assert filters.same_members(a, a) and not filters.same_members(a, b)


def test_to_number_pandas_rules(spark):
    texts = ["5", " 6 ", "1e3", "abc", "5d", "True", "0x10", "1,000", "inf", "-.5", "nan", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(numbers.to_number(F.col("t"))).collect()]
    assert got[:4] == [5.0, 6.0, 1000.0, None]
    assert got[4:8] == [None, None, None, None]
    assert got[8] == math.inf and got[9] == -0.5 and math.isnan(got[10]) and got[11] is None
    zero = [r[0] for r in df.select(numbers.to_number_or_zero(F.col("t"))).collect()]
    assert zero[10] == 0.0 and zero[11] == 0.0


def test_python_float_strings(spark):
    vals = [3.0, 0.0001, 1e-05, 1.5e-05, 1e16, 12345678.9, 0.1, -2.5, float("nan"), None, 1e22]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(numbers.py_float_str(F.col("v"))).collect()]
    assert got == ["3.0", "0.0001", "1e-05", "1.5e-05", "1e+16", "12345678.9", "0.1", "-2.5", "nan", "nan", "1e+22"]


def test_colors(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.1,), (0.3,), (1.0,), (None,)], "v double")
    rows = df.select(colors.continuous_color(F.col("v")).alias("c"), colors.category_color(F.col("v")).alias("k"),
                     colors.category_index(F.col("v")).alias("i")).collect()
    assert rows[0]["c"] == "rgb(25, 143, 189)" and rows[2]["c"] == "rgb(247, 213, 41)"
    assert rows[5]["c"] == "rgb(247, 41, 91)" and rows[6]["c"] is None
    assert rows[1]["c"] == "rgb(136, 178, 115)"
    assert [r["i"] for r in rows[:6]] == [0, 2, 5, 1, 3, 9]
    assert rows[0]["k"] == "rgb(79, 54, 109)"
    assert colors.hex_to_rgb_literal("#abc") == "rgb(170, 187, 204)"
    assert colors.hex_to_rgb_literal(0x00cc88) == "rgb(0, 204, 136)"
    with pytest.raises(ValueError):
        colors.hex_to_rgb_literal("#abcd")
    h = spark.createDataFrame([("#198FBD",), ("fff",)], "h string")
    assert [r[0] for r in h.select(colors.hex_to_rgb(F.col("h"))).collect()] == ["rgb(25, 143, 189)",
                                                                                 "rgb(255, 255, 255)"]
    a = spark.createDataFrame([("rgb(1, 2, 3)",), ("rgba(1,2,3,0.2)",), ("#fff",)], "c string")
    assert [r[0] for r in a.select(colors.with_alpha(F.col("c"), 0.5)).collect()] == [
        "rgba(1,2,3,0.5)", "rgba(1,2,3,0.5)", "#fff"]


def test_view_functions(spark):
    df = spark.createDataFrame([(1.9, 7, "a.png"), (2.0, 0, "b.JPG"), (10.0, 100, "c.jpeg")],
                               "z double, b int, f string")
    rows = df.select(view.zoom_class(F.col("z")).alias("zc"), view.zoom_after_steps(F.col("z"), F.lit(100.0)).alias("zn"),
                     view.bin_label(F.col("b")).alias("bl"), view.mime_type(F.col("f")).alias("m"),
                     view.jitter(F.col("z"), F.col("z")).alias("j")).collect()
    assert [r["zc"] for r in rows] == ["low", "medium", "high"]
    assert [r["zn"] for r in rows] == [50.0, 50.0, 50.0]
    assert [r["bl"] for r in rows] == ["0.14-0.16", "0-0.02", "2-2.02"]
    assert [r["m"] for r in rows] == ["image/png", "application/octet-stream", "image/jpeg"]
    assert all(-1 <= r["j"] <= 1 for r in rows)
    s = spark.createDataFrame([("a b#c-d_e",)], "s string")
    assert s.select(view.sanitize_label(F.col("s"))).first()[0] == "abc-d_e"


def test_jitter_matches_js_semantics(spark):
    # JS: seed = (x*73856093) ^ (y*19349663) ^ (z*83492791) on int32
    def js(x, y, z=0.0):
        def i32(v):
            t = math.trunc(v) % 2 ** 32
            return t - 2 ** 32 if t >= 2 ** 31 else t
        seed = i32(x * 73856093) ^ i32(y * 19349663) ^ i32(z * 83492791)
        rng = math.sin(seed) * 10000
        return (rng - math.floor(rng)) * 2 - 1
    pts = [(1.5, -2.25), (123.4, 56.7), (-1000.0, 3.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = [r[0] for r in df.select(view.jitter(F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([js(x, y) for x, y in pts], abs=1e-9)


def test_glyph_axes_and_flat(spark):
    df = spark.createDataFrame([("a", {"10": 0.5, "2": 1.0, "1": 0.0, "3": 0.7}), ("b", {"1": 0.0, "2": 0.0, "10": 0.0})],
                               "ID string, features map<string,double>")
    ax = glyph.glyph_axes(df, ["1", "2", "10"], radius=2.0).collect()
    a = [r for r in ax if r["ID"] == "a"]
    assert [r["feature_id"] for r in a] == ["1", "2", "10"]
    assert a[2]["angle"] == pytest.approx(2 * 2 * math.pi / 3)
    assert a[2]["length"] == pytest.approx(1.0)   # 0.5 / max 1.0 * radius 2
    b = [r for r in ax if r["ID"] == "b"]
    assert all(r["length"] == 0 for r in b)
    flat = {r["ID"]: (r[1], r[2]) for r in df.select(
        "ID", glyph.is_flat(F.col("features"), ["1", "2", "10"]),
        glyph.is_flat(F.col("features"), [], 0.01, strict=True)).collect()}
    assert flat == {"a": (False, True), "b": (True, True)}


def test_raw_prefilter_is_conservative_and_pushed(spark, tmpdir_fresh):
    import os
    from featurescape.operators import encode
    rows = [(str(i), float(i) if i % 17 else None, i % 9) for i in range(300)]
    rows += [("nan", float("nan"), 3)]
    path = os.path.join(tmpdir_fresh, "t.parquet")
    spark.createDataFrame(rows, "ID string, a double, b int").write.parquet(path)
    raw = spark.read.parquet(path)
    model = encode.fit_encoder(raw)
    for lo, hi in [(0.2, 0.6), (0.0, 0.3), (0.0, 0.0), (0.5, 1.0)]:
        fs = [FeatureFilter("a", lo, hi), FeatureFilter("b", 0.0, 0.5)]
        got = {r["ID"] for r in filters.apply_filters_pushed(raw, model, fs).collect()}
        want = {r["ID"] for r in filters.apply_filters(model.transform(raw), fs).collect()}
        assert got == want, (lo, hi)
    plan = filters.apply_filters_pushed(raw, model, [FeatureFilter("a", 0.2, 0.6)])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), LessThanOrEqual(a" in plan or "LessThanOrEqual(a" in plan


def _python_passive(rows, flt):
    """Set algebra: what survives is in every AND filter's set and, if there are OR
    filters, in one of theirs; empty filters take no part."""
    def hits(f, r):
        if isinstance(f, FeatureFilter):
            return r[f.feature] is not None and f.lo <= r[f.feature] <= f.hi
        if isinstance(f, TextFilter):
            return bool({str(v).lower() for v in r["values"].values()} & set(f.terms))
        return r["ID"] in f.ids

    active = [(f.mode, {r["ID"] for r in rows if hits(f, r)}) for f in flt if not f.empty]
    survive = {r["ID"] for r in rows}.intersection(*[s for mode, s in active if mode == FilterMode.AND])
    either = [s for mode, s in active if mode == FilterMode.OR]
    if either:
        survive &= set().union(*either)
    return {r["ID"]: r["ID"] not in survive for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_random_filter_sets_match_python(spark, seed):
    import random
    rnd = random.Random(seed)
    words = ["Red", "blue", "GREEN", "x", "7"]
    rows = []
    for i in range(40):
        a = rnd.choice([None, float("nan"), 0.0, 1.0, round(rnd.random(), 3)])
        rows.append({"ID": str(i), "a": a, "b": round(rnd.random(), 3),
                     "values": {"1": rnd.choice(words), "2": rnd.choice(words)}})
    df = spark.createDataFrame([(r["ID"], r["a"], r["b"], r["values"]) for r in rows],
                               "ID string, a double, b double, values map<string,string>")
    flt = []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.choice(["feature", "text", "id"])
        mode = rnd.choice([FilterMode.AND, FilterMode.OR])
        if kind == "feature":
            lo = round(rnd.random() * 0.5, 2)
            f = FeatureFilter(rnd.choice(["a", "b"]), lo, round(lo + rnd.random() * 0.5, 2), mode=mode)
            if rnd.random() < 0.2:
                f.clear()
        elif kind == "text":
            f = TextFilter(rnd.sample(words, rnd.randint(0, 2)), mode=mode)
        else:
            f = IdFilter([str(rnd.randint(0, 39)) for _ in range(rnd.randint(0, 6))], mode=mode)
        flt.append(f)
    assert passive(df, flt) == _python_passive(rows, flt)
