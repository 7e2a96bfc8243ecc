"""Registered queries on the driver tables and their DuckDB oracles.

Every query reads whole tables from ``sf_dir`` and runs the engine's
operators; :data:`ORACLE_SQL` holds an independent SQL formulation of the
same result (same column names, doubles rounded to 6 decimals on both
sides, ids as strings, counts as BIGINT).  Queries without SQL (iterative
or order-dependent operators) are checked against brute force in tests.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.functions import colors, glyph, view
from featurescape.operators import catalog as cat
from featurescape.operators import cluster, encode, filters, items, positions, profile, spatial
from featurescape.operators.ids import ensure_id
from featurescape.session import materialize

R = 6  # decimals compared
VIEW_W, VIEW_H = 1600.0, 900.0
RADIUS = 10.0


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c):
    return F.round(c, R)


# ---------------------------------------------------------------- inputs
def part_table(spark, sf_dir, with_order: bool = True) -> DataFrame:
    """part as a user table whose first column is the id (``_ord`` = file
    order, needed only by order-sensitive operators)."""
    return ensure_id(_t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ID"), "p_brand", "p_type", "p_size", "p_retailprice"),
        keep_order_column=with_order)


def part_encoded(spark, sf_dir) -> tuple[DataFrame, encode.EncodeModel]:
    return encode.encode_features(part_table(spark, sf_dir, with_order=False))


def customer_table(spark, sf_dir) -> DataFrame:
    return ensure_id(_t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ID"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def part_positions(spark, sf_dir) -> DataFrame:
    """Positions of part items in a 1600 x 900 view: x = size, y = price."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"),
                                         F.col("p_partkey").alias("_ord"),
                                         F.col("p_size").cast("double").alias("x"),
                                         F.col("p_retailprice").alias("y"))
    return positions.scale_positions(p.withColumn("algorithm", F.lit("size_price")), VIEW_W, VIEW_H,
                                     by=["algorithm"])


_PART_POS_SQL = """
  WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
  b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
  SELECT CAST(p_partkey AS VARCHAR) AS ID, p_partkey AS ord,
    CASE WHEN x0 = x1 OR y0 = y1 THEN 0.0 ELSE ((x - x0) / (x1 - x0) - 0.5) * 1600.0 END AS x,
    CASE WHEN x0 = x1 OR y0 = y1 THEN 0.0 ELSE ((y - y0) / (y1 - y0) - 0.5) * 900.0 END AS y
  FROM p, b
"""


def _encoded_part_sql() -> str:
    return """
  WITH c AS (SELECT p_partkey,
      CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, '0')) - 1 AS DOUBLE) AS cb,
      CAST(dense_rank() OVER (ORDER BY coalesce(p_type, '0')) - 1 AS DOUBLE) AS ct,
      CAST(p_size AS DOUBLE) AS cs, p_retailprice AS cp,
      p_brand, p_type, p_size, p_retailprice FROM part),
  m AS (SELECT *, min(cb) OVER () AS lb, max(cb) OVER () AS hb, min(ct) OVER () AS lt, max(ct) OVER () AS ht,
      min(cs) OVER () AS ls, max(cs) OVER () AS hs, min(cp) OVER () AS lp, max(cp) OVER () AS hp FROM c),
  n AS (SELECT p_partkey, p_brand AS raw_brand, p_type AS raw_type, p_size AS raw_size, p_retailprice AS raw_price,
      CASE WHEN hb = lb THEN 0.0 ELSE (cb - lb) / (hb - lb) END AS nb,
      CASE WHEN ht = lt THEN 0.0 ELSE (ct - lt) / (ht - lt) END AS nt,
      CASE WHEN hs = ls THEN 0.0 ELSE (cs - ls) / (hs - ls) END AS ns,
      CASE WHEN hp = lp THEN 0.0 ELSE (cp - lp) / (hp - lp) END AS np FROM m)
  SELECT p_partkey, raw_brand, raw_type, raw_size, raw_price,
    CASE WHEN abs(nb) < 0.001 THEN 0.0 ELSE nb END AS p_brand,
    CASE WHEN abs(nt) < 0.001 THEN 0.0 ELSE nt END AS p_type,
    CASE WHEN abs(ns) < 0.001 THEN 0.0 ELSE ns END AS p_size,
    CASE WHEN abs(np) < 0.001 THEN 0.0 ELSE np END AS p_retailprice
  FROM n
"""


# ---------------------------------------------------------------- FE
def q_encode_part(spark, sf_dir):
    enc, _ = part_encoded(spark, sf_dir)
    return enc.select("ID", *[_r(F.col(c)).alias(c) for c in ("p_brand", "p_type", "p_size", "p_retailprice")])


SQL_ENCODE_PART = f"""
WITH e AS ({_encoded_part_sql()})
SELECT CAST(p_partkey AS VARCHAR) AS ID, round(p_brand, 6) AS p_brand, round(p_type, 6) AS p_type,
       round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM e
"""


def _whole_table_sql(table: str, key: str, text: list[str], numbers: list[str]) -> str:
    """Every column of a table, encoded."""
    def scaled(v: str, lo: str, hi: str) -> str:
        return (f"CASE WHEN {hi} = {lo} THEN 0.0 WHEN abs(({v} - {lo}) / ({hi} - {lo})) < 0.001 THEN 0.0 "
                f"ELSE ({v} - {lo}) / ({hi} - {lo}) END")
    codes = ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, '0')) - 1 AS DOUBLE) AS {c}" for c in text)
    values = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in numbers)
    out = ", ".join(f"round({scaled(c, f'(min({c}) OVER ())', f'(max({c}) OVER ())')}, 6) AS {c}" for c in text + numbers)
    return f"""
WITH v AS (SELECT CAST({key} AS VARCHAR) AS ID, {codes}, {values} FROM {table})
SELECT ID, {out} FROM v
"""


def _encoded_whole(spark, sf_dir, table: str, key: str) -> DataFrame:
    t = _t(spark, sf_dir, table)
    t = t.select(F.col(key).cast("string").alias("ID"), *[c for c in t.columns if c != key])
    model = encode.fit_encoder(t)
    coded = model.transform(t)
    return coded.select("ID", *[_r(F.col(s.name)).alias(s.name) for s in model.features])


def q_encode_part_whole(spark, sf_dir):
    """FE-6 on every column of part, names included."""
    return _encoded_whole(spark, sf_dir, "part", "p_partkey")


def q_encode_customer(spark, sf_dir):
    """FE-2/FE-6 on a text column with as many values as rows."""
    return _encoded_whole(spark, sf_dir, "customer", "c_custkey")


SQL_ENCODE_PART_WHOLE = _whole_table_sql("part", "p_partkey", ["p_name", "p_brand", "p_type"], ["p_size", "p_retailprice"])
SQL_ENCODE_CUSTOMER = _whole_table_sql("customer", "c_custkey", ["c_name", "c_mktsegment"], ["c_nationkey", "c_acctbal"])


def q_label_dictionary(spark, sf_dir):
    model = encode.fit_encoder(customer_table(spark, sf_dir))
    return model.dictionary.select("feature_id", "name", "value", F.col("code").cast("long").alias("code"))


SQL_LABEL_DICTIONARY = """
SELECT '1' AS feature_id, 'c_name' AS name, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT coalesce(c_name, '0') AS v FROM customer)
UNION ALL
SELECT '4' AS feature_id, 'c_mktsegment' AS name, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT coalesce(c_mktsegment, '0') AS v FROM customer)
"""


def q_standardize_part(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), "p_size", "p_retailprice")
    z = encode.standardize(p, ["p_size", "p_retailprice"])
    return z.select("ID", _r(F.col("p_size")).alias("z_size"), _r(F.col("p_retailprice")).alias("z_price"))


SQL_STANDARDIZE_PART = """
SELECT CAST(p_partkey AS VARCHAR) AS ID,
  round((p_size - avg(CAST(p_size AS DOUBLE)) OVER ()) /
        CASE WHEN stddev_pop(CAST(p_size AS DOUBLE)) OVER () = 0 THEN 1 ELSE stddev_pop(CAST(p_size AS DOUBLE)) OVER () END, 6) AS z_size,
  round((p_retailprice - avg(p_retailprice) OVER ()) /
        CASE WHEN stddev_pop(p_retailprice) OVER () = 0 THEN 1 ELSE stddev_pop(p_retailprice) OVER () END, 6) AS z_price
FROM part
"""


def q_coerce_numbers(spark, sf_dir):
    from featurescape.functions.numbers import to_number_or_zero
    p = _t(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("ID"),
        _r(to_number_or_zero(F.substring_index("p_brand", "#", -1))).alias("brand_no"),
        _r(to_number_or_zero(F.col("p_name"))).alias("name_no"),
        _r(to_number_or_zero(F.concat(F.col("p_size").cast("string"), F.lit("d")))).alias("suffixed_no"),
        _r(to_number_or_zero(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" ")))).alias("price_no"))


_NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL_RE = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def _to_num_sql(x: str) -> str:
    return (f"coalesce(CASE WHEN regexp_matches({x}, '{_NUM_RE}') OR regexp_matches({x}, '{_SPECIAL_RE}') "
            f"THEN CASE WHEN isnan(TRY_CAST(trim({x}) AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(trim({x}) AS DOUBLE) END "
            f"END, 0.0)")


SQL_COERCE_NUMBERS = f"""
SELECT CAST(p_partkey AS VARCHAR) AS ID,
  round({_to_num_sql("split_part(p_brand, '#', 2)")}, 6) AS brand_no,
  round({_to_num_sql("p_name")}, 6) AS name_no,
  round({_to_num_sql("CAST(p_size AS VARCHAR) || 'd'")}, 6) AS suffixed_no,
  round({_to_num_sql("' ' || CAST(p_retailprice AS VARCHAR) || ' '")}, 6) AS price_no
FROM part
"""


# ---------------------------------------------------------------- AGG
PROFILE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax"]
HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_profile_lineitem(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    pr = profile.profile(li, PROFILE_COLS)
    # sums of squares in another order differ in their last digits: seven are compared
    return pr.select("feature_id", "name", *[_r(F.col(c)).alias(c) for c in ("min", "max", "median")],
                     *[F.col(c).cast("float").cast("double").alias(c) for c in ("variance", "deviation")])


def _long_sql(cols: list[str], table: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{i}' AS feature_id, '{c}' AS name, CAST({c} AS DOUBLE) AS v FROM {table}"
        for i, c in enumerate(cols, start=1))


SQL_PROFILE_LINEITEM = f"""
WITH l AS ({_long_sql(PROFILE_COLS, "lineitem")})
SELECT feature_id, name, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median,
       CAST(CAST(var_pop(v) AS FLOAT) AS DOUBLE) AS variance, CAST(CAST(stddev_pop(v) AS FLOAT) AS DOUBLE) AS deviation
FROM l GROUP BY feature_id, name
"""


def q_histogram_lineitem(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    h = profile.histogram(li, HIST_COLS)
    return h.select("feature_id", "name", "bin", "count", _r(F.col("density")).alias("density"),
                    _r(F.col("relative")).alias("relative"))


def _hist_sql(cols: list[str], table: str) -> str:
    return f"""
WITH l AS ({_long_sql(cols, table)}),
s AS (SELECT feature_id, name, min(v) AS mn, max(v) AS mx, count(*) AS n FROM l GROUP BY feature_id, name),
e AS (SELECT feature_id, name, n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS f0,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS f1 FROM s),
b0 AS (SELECT l.feature_id, l.v, e.f0, e.f1, (e.f1 - e.f0) / 50.0 AS st,
              least(CAST(floor((l.v - e.f0) / (e.f1 - e.f0) * 50.0) AS BIGINT), 49) AS i0
       FROM l JOIN e ON l.feature_id = e.feature_id),
b1 AS (SELECT *, CASE WHEN v < (CASE WHEN i0 = 50 THEN f1 ELSE i0 * st + f0 END) THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT feature_id, CASE WHEN v >= (CASE WHEN i1 + 1 = 50 THEN f1 ELSE (i1 + 1) * st + f0 END) AND i1 <> 49
                          THEN i1 + 1 ELSE i1 END AS bin FROM b1),
c AS (SELECT feature_id, bin, count(*) AS cnt FROM b2 GROUP BY feature_id, bin),
g AS (SELECT e.feature_id, e.name, e.n, e.f0, e.f1, r.bin FROM e, (SELECT range AS bin FROM range(50)) r),
d AS (SELECT g.feature_id, g.name, g.bin, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
             coalesce(c.cnt, 0) / ((CASE WHEN g.bin + 1 = 50 THEN g.f1 ELSE (g.bin + 1) * ((g.f1 - g.f0) / 50.0) + g.f0 END)
                                   - (g.bin * ((g.f1 - g.f0) / 50.0) + g.f0)) / g.n AS density
      FROM g LEFT JOIN c ON g.feature_id = c.feature_id AND g.bin = c.bin)
SELECT feature_id, name, CAST(bin AS INTEGER) AS bin, count, round(density, 6) AS density,
       round(density / max(density) OVER (PARTITION BY feature_id), 6) AS relative
FROM d
"""


SQL_HISTOGRAM_LINEITEM = _hist_sql(HIST_COLS, "lineitem")


def q_brush_to_range(spark, sf_dir):
    lo_rel, hi_rel = 0.2137, 0.5821
    lo, hi = filters.brush_range(lo_rel, hi_rel)
    li = _t(spark, sf_dir, "lineitem")
    h = profile.histogram(li, HIST_COLS)
    sel = filters.brushed_bins(F.col("bin"), F.lit(lo_rel * 50), F.floor(F.lit(hi_rel * 50)))
    return h.select("feature_id", "bin", "count", sel.alias("selected"),
                    F.lit(round(lo, R)).alias("lo"), F.lit(round(hi, R)).alias("hi"),
                    view.bin_label(F.col("bin")).alias("label"))


def _bin_label_sql(b: str) -> str:
    def js(cents: str) -> str:
        return (f"CASE WHEN {cents} % 100 = 0 THEN CAST({cents} // 100 AS VARCHAR) "
                f"WHEN {cents} % 10 = 0 THEN CAST({cents} // 100 AS VARCHAR) || '.' || CAST(({cents} % 100) // 10 AS VARCHAR) "
                f"ELSE CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') END")
    lo = f"CAST(floor({b} / 50.0 * 100 + 0.5) AS BIGINT)"
    hi = f"CAST(floor(({b} + 1) / 50.0 * 100 + 0.5) AS BIGINT)"
    return f"({js(lo)} || '-' || {js(hi)})"


SQL_BRUSH_TO_RANGE = f"""
WITH h AS ({_hist_sql(HIST_COLS, "lineitem")})
SELECT feature_id, bin, count, ({0.2137 * 50!r} <= bin + 1 AND bin <= floor({0.5821 * 50!r})) AS selected,
       round(CAST({math.floor(0.2137 / 0.02) * 0.02!r} AS DOUBLE), 6) AS lo,
       round(CAST({min((math.floor(0.5821 / 0.02) + 1) * 0.02, 1.0)!r} AS DOUBLE), 6) AS hi,
       {_bin_label_sql("bin")} AS label
FROM h
"""


# ---------------------------------------------------------------- PRJ / JN-3
def q_item_details(spark, sf_dir):
    cust = customer_table(spark, sf_dir)
    rec = cust.select(F.col("ID").alias("id"), items.raw_values(cust).alias("values"))
    return items.item_details(rec, items.labels_frame(cust))


SQL_ITEM_DETAILS = """
SELECT CAST(c_custkey AS VARCHAR) AS id, '1' AS feature_id, 'c_name' AS label, coalesce(c_name, 'nan') AS value FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), '2', 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), '3', 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), '4', 'c_mktsegment', coalesce(c_mktsegment, 'nan') FROM customer
"""


def q_ensure_id(spark, sf_dir):
    p = ensure_id(_t(spark, sf_dir, "part"))
    return p.select("ID", F.col("p_partkey").cast("string").alias("p_partkey"), "p_name")


SQL_ENSURE_ID = """
SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR) AS ID, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name
FROM part
"""


# ---------------------------------------------------------------- FLT
def q_filter_range(spark, sf_dir):
    raw = part_table(spark, sf_dir, with_order=False)
    model = encode.fit_encoder(raw)
    fs = [filters.FeatureFilter("p_retailprice", 0.2, 0.6), filters.FeatureFilter("p_size", 0.1, 0.9)]
    return filters.apply_filters_pushed(raw, model, fs).select("ID")


SQL_FILTER_RANGE = f"""
WITH e AS ({_encoded_part_sql()})
SELECT CAST(p_partkey AS VARCHAR) AS ID FROM e
WHERE p_retailprice BETWEEN 0.2 AND 0.6 AND p_size BETWEEN 0.1 AND 0.9
"""


def q_filter_text(spark, sf_dir):
    cust = customer_table(spark, sf_dir)
    rec = cust.select("ID", items.raw_values(cust).alias("values"))
    f = filters.TextFilter(["Building", "machinery", "7"])
    return filters.apply_filters(rec, [f]).select("ID")


SQL_FILTER_TEXT = """
SELECT CAST(c_custkey AS VARCHAR) AS ID FROM customer
WHERE lower(coalesce(c_name, 'nan')) IN ('building', 'machinery', '7')
   OR lower(CAST(c_nationkey AS VARCHAR)) IN ('building', 'machinery', '7')
   OR lower(CAST(c_acctbal AS VARCHAR)) IN ('building', 'machinery', '7')
   OR lower(coalesce(c_mktsegment, 'nan')) IN ('building', 'machinery', '7')
"""


def q_filter_ids(spark, sf_dir):
    cust = customer_table(spark, sf_dir)
    big = _t(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).select(
        F.col("o_custkey").cast("string").alias("ID"))
    return filters.apply_filters(cust, [filters.IdFilter(big)]).select("ID")


SQL_FILTER_IDS = """
SELECT CAST(c_custkey AS VARCHAR) AS ID FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
"""


def q_filter_compose(spark, sf_dir):
    raw = part_table(spark, sf_dir, with_order=False)
    model = encode.fit_encoder(raw)
    rec = model.transform(raw.withColumn("values", items.raw_values(raw)), keep=("values",))
    small = _t(spark, sf_dir, "part").where(F.col("p_size") < 10).select(F.col("p_partkey").cast("string").alias("ID"))
    large = _t(spark, sf_dir, "part").where(F.col("p_size") > 45).select(F.col("p_partkey").cast("string").alias("ID"))
    fs = [filters.FeatureFilter("p_retailprice", 0.5, 1.0),
          filters.TextFilter(["ECONOMY", "small"]),
          filters.IdFilter(small), filters.IdFilter(large)]
    return filters.mark_passive(rec, fs).select("ID", "passive")


SQL_FILTER_COMPOSE = f"""
WITH e AS ({_encoded_part_sql()})
SELECT CAST(p_partkey AS VARCHAR) AS ID,
  NOT (p_retailprice BETWEEN 0.5 AND 1.0
       AND (lower(raw_brand) IN ('economy', 'small') OR lower(raw_type) IN ('economy', 'small')
            OR lower(CAST(raw_size AS VARCHAR)) IN ('economy', 'small')
            OR lower(CAST(raw_price AS VARCHAR)) IN ('economy', 'small'))
       AND (raw_size < 10 OR raw_size > 45)) AS passive
FROM e
"""


def q_mark_passive_counts(spark, sf_dir):
    ev = ensure_id(_t(spark, sf_dir, "events").select(F.col("event_id").alias("ID"), "ts", "user_id",
                                                       "event_type", "value"))
    model = encode.fit_encoder(ev)
    carried = ev.withColumn("values", items.raw_values(ev)).withColumn("time", F.date_format("ts", "ddMMyyyy"))
    rec = model.transform(carried, keep=("values", "time"))
    fs = [filters.FeatureFilter("value", 0.25, 0.75), filters.TextFilter(["Click"])]
    marked = filters.mark_passive(rec, fs)
    return filters.filter_counts(marked, ["time"])


SQL_MARK_PASSIVE_COUNTS = """
WITH n AS (SELECT event_id, event_type, strftime(ts, '%d%m%Y') AS time,
              CASE WHEN max(value) OVER () = min(value) OVER () THEN 0.0
                   ELSE (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) END AS nv
           FROM events),
t AS (SELECT *, CASE WHEN abs(nv) < 0.001 THEN 0.0 ELSE nv END AS v FROM n)
SELECT time, count(*) AS total,
       count(*) FILTER (WHERE v BETWEEN 0.25 AND 0.75 AND lower(event_type) = 'click') AS surviving
FROM t GROUP BY time
"""


def q_idset_toggle(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    cur = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("ID"))
    flip = o.where(F.col("o_totalprice") > 300000).select(F.col("o_orderkey").cast("string").alias("ID"))
    return filters.idset_toggle(cur, flip)


SQL_IDSET_TOGGLE = """
WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS ID FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT CAST(o_orderkey AS VARCHAR) AS ID FROM orders WHERE o_totalprice > 300000)
(SELECT ID FROM a EXCEPT SELECT ID FROM b) UNION ALL (SELECT ID FROM b EXCEPT SELECT ID FROM a)
"""


def q_raw_values_long(spark, sf_dir):
    """PRJ-6 and PRJ-7: nested items and back, one row per item and feature."""
    raw = part_table(spark, sf_dir, with_order=False)
    long = items.from_items(items.to_items(raw, encode.fit_encoder(raw)))
    return long.select("id", "feature_id", _r(F.col("value")).alias("value"), "raw")


SQL_RAW_VALUES_LONG = f"""
WITH e AS ({_encoded_part_sql()}),
l AS (SELECT p_partkey, '1' AS feature_id, p_brand AS value, raw_brand AS raw FROM e
      UNION ALL SELECT p_partkey, '2', p_type, raw_type FROM e
      UNION ALL SELECT p_partkey, '3', p_size, CAST(raw_size AS VARCHAR) FROM e
      UNION ALL SELECT p_partkey, '4', p_retailprice, CAST(raw_price AS VARCHAR) FROM e)
SELECT CAST(p_partkey AS VARCHAR) AS id, feature_id, round(value, 6) AS value, raw FROM l
"""


def q_settled_items(spark, sf_dir):
    """POS-9 per item: sizes shift a part's position between two layouts."""
    now = part_positions(spark, sf_dir)
    sizes = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), "p_size")
    then = now.join(sizes, "ID").select("ID", (F.col("x") + F.col("p_size") % 3 * 0.008).alias("x"), "y")
    return positions.settled_items(now, then)


SQL_SETTLED_ITEMS = """
SELECT CAST(p_partkey AS VARCHAR) AS ID, p_size % 3 < 2 AS settled FROM part
"""


def q_select_positions(spark, sf_dir):
    """POS-8: one of two sets by its name, the first by default."""
    part = part_positions(spark, sf_dir).select("algorithm", "ID", "x", "y")
    moved = part.select(F.lit("moved").alias("algorithm"), "ID", (F.col("x") + 7).alias("x"), (F.col("y") + 7).alias("y"))
    both = part.unionByName(moved)
    named, first = positions.select_positions(both, algorithm="size_price"), positions.select_positions(both)
    return named.unionByName(first).select("algorithm", "ID", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


SQL_SELECT_POSITIONS = f"""
WITH s AS ({_PART_POS_SQL})
SELECT 'size_price' AS algorithm, ID, round(x, 6) AS x, round(y, 6) AS y FROM s
UNION ALL SELECT 'moved', ID, round(x + 7, 6), round(y + 7, 6) FROM s
"""


# ---------------------------------------------------------------- POS / AGG-7
def q_scaled_positions(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    return p.select("ID", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


SQL_SCALED_POSITIONS = f"""
WITH s AS ({_PART_POS_SQL}) SELECT ID, round(x, 6) AS x, round(y, 6) AS y FROM s
"""


def q_bounds(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    b = positions.position_bounds(p, ["algorithm"])
    return b.select("algorithm", *[_r(F.col(c)).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


SQL_BOUNDS = f"""
WITH s AS ({_PART_POS_SQL})
SELECT 'size_price' AS algorithm, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x,
       round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM s
"""


def _pair_input(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return ensure_id(p.select(
        F.col("p_partkey").alias("ID"),
        F.col("p_size").alias("Size-X"), F.col("p_retailprice").alias("size-y"),
        F.col("p_name").alias("name-x"), F.col("p_brand").alias("name-y"),
        F.substring_index("p_brand", "#", -1).alias("b-x"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.lit("n/a")).alias("b-y"),
        F.col("p_size").cast("string").alias("foo-x"),
        (F.col("p_retailprice") - 950).alias("Lon"),
        F.when(F.col("p_type") == "STANDARD", F.lit("bad")).otherwise(
            (F.col("p_size") - 25).cast("string")).alias("LAT")))


def q_pair_positions(spark, sf_dir):
    pp = positions.pair_positions(_pair_input(spark, sf_dir))
    return pp.select("algorithm", "ID", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


SQL_PAIR_POSITIONS = f"""
SELECT 'size' AS algorithm, CAST(p_partkey AS VARCHAR) AS ID, round(CAST(p_size AS DOUBLE), 6) AS x,
       round(p_retailprice, 6) AS y FROM part
UNION ALL
SELECT 'b', CAST(p_partkey AS VARCHAR), round(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), 6),
       round(CAST(p_size AS DOUBLE), 6)
FROM part WHERE p_size > 25 AND regexp_matches(split_part(p_brand, '#', 2), '{_NUM_RE}')
"""


def q_geo_positions(spark, sf_dir):
    g = positions.geo_positions(_pair_input(spark, sf_dir))
    return g.select("algorithm", "ID", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


SQL_GEO_POSITIONS = """
SELECT 'epsg' AS algorithm, CAST(p_partkey AS VARCHAR) AS ID, round(p_retailprice - 950, 6) AS x,
       round(CAST(p_size - 25 AS DOUBLE), 6) AS y
FROM part WHERE p_type <> 'STANDARD'
"""


def q_attach_positions(spark, sf_dir):
    inp = _pair_input(spark, sf_dir)
    pos = positions.pair_positions(inp).unionByName(positions.geo_positions(inp))
    it = inp.select("ID", F.col("Size-X").alias("p_size"))
    out = items.attach_positions(it, pos, ["size", "epsg"])
    return out.select("ID", *[_r(F.col(c)).alias(c) for c in ("size_x", "size_y", "epsg_x", "epsg_y")])


SQL_ATTACH_POSITIONS = """
SELECT CAST(p_partkey AS VARCHAR) AS ID, round(CAST(p_size AS DOUBLE), 6) AS size_x, round(p_retailprice, 6) AS size_y,
  CASE WHEN p_type <> 'STANDARD' THEN round(p_retailprice - 950, 6) END AS epsg_x,
  CASE WHEN p_type <> 'STANDARD' THEN round(CAST(p_size - 25 AS DOUBLE), 6) END AS epsg_y
FROM part
"""


def q_select_rect(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    return spatial.select_rect(p, (-400.0, -200.0, 100.0, 150.0))


SQL_SELECT_RECT = f"""
WITH s AS ({_PART_POS_SQL}) SELECT DISTINCT ID FROM s WHERE x BETWEEN -400 AND 100 AND y BETWEEN -200 AND 150
"""


def q_visible_in_view(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    return p.where(spatial.visible_in_view(p, -300.0, 300.0, -200.0, 200.0, 5.0)).select("ID")


SQL_VISIBLE_IN_VIEW = f"""
WITH s AS ({_PART_POS_SQL})
SELECT ID FROM s WHERE x + 5 > -300 AND x - 5 < 300 AND y + 5 > -200 AND y - 5 < 200
"""


def q_lens(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    return spatial.within_radius(p, 16.0, 0.0, 20.0).select("ID")


SQL_LENS = f"""
WITH s AS ({_PART_POS_SQL}) SELECT ID FROM s WHERE sqrt((x - 16) * (x - 16) + (y - 0) * (y - 0)) < 20
"""


def q_nearest_batch(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    probes = p.select(F.col("ID").alias("pid"), (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"))
    nb = spatial.nearest_join(probes, p, 6.0)
    return nb.select("pid", "ID", _r(F.col("dist")).alias("dist"))


SQL_NEAREST_BATCH = f"""
WITH s AS ({_PART_POS_SQL}),
q AS (SELECT ID AS pid, x + 3 AS x, y + 2 AS y FROM s),
c AS (SELECT q.pid, s.ID, s.ord, sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) AS dist FROM q, s),
k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, ord) AS rn FROM c WHERE dist < 6)
SELECT q.pid, k.ID, round(k.dist, 6) AS dist FROM q LEFT JOIN k ON q.pid = k.pid AND k.rn = 1
"""


def q_radius_neighbors(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    nb = spatial.radius_neighbors(p, RADIUS)
    return nb.select("src", "dst", _r(F.col("dist")).alias("dist"))


SQL_RADIUS_NEIGHBORS = f"""
WITH s AS ({_PART_POS_SQL})
SELECT a.ID AS src, b.ID AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist
FROM s a, s b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 10
"""


def _event_positions(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select(F.col("event_id").cast("string").alias("ID"), F.col("event_id").alias("_ord"),
                     (F.hour("ts") + F.minute("ts") / 60.0).alias("x"), F.col("value").alias("y"))


def q_grid_clusters(spark, sf_dir):
    g = cluster.grid_clusters(_event_positions(spark, sf_dir), 2.0)
    return g.select(F.col("cell_x").cast("long").alias("cell_x"), F.col("cell_y").cast("long").alias("cell_y"),
                    F.col("n").cast("long").alias("n"), _r(F.col("centre_x")).alias("centre_x"),
                    _r(F.col("centre_y")).alias("centre_y"), "representative")


SQL_GRID_CLUSTERS = """
WITH p AS (SELECT event_id, hour(ts) + CAST(minute(ts) AS DOUBLE) / 60.0 AS x, value AS y FROM events),
c AS (SELECT *, CAST(floor(x / 2.0) AS BIGINT) AS cell_x, CAST(floor(y / 2.0) AS BIGINT) AS cell_y FROM p),
m AS (SELECT cell_x, cell_y, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM c GROUP BY cell_x, cell_y),
r AS (SELECT c.cell_x, c.cell_y, CAST(c.event_id AS VARCHAR) AS rep,
             row_number() OVER (PARTITION BY c.cell_x, c.cell_y
                                ORDER BY sqrt((c.x - m.cx) * (c.x - m.cx) + (c.y - m.cy) * (c.y - m.cy)), c.event_id) AS rn
      FROM c JOIN m ON c.cell_x = m.cell_x AND c.cell_y = m.cell_y)
SELECT m.cell_x, m.cell_y, CAST(m.n AS BIGINT) AS n, round(m.cx, 6) AS centre_x, round(m.cy, 6) AS centre_y,
       r.rep AS representative
FROM m JOIN r ON m.cell_x = r.cell_x AND m.cell_y = r.cell_y AND r.rn = 1
"""


def q_ball_clusters(spark, sf_dir):
    p = part_positions(spark, sf_dir)
    return cluster.ball_clusters(p, RADIUS).select("ID", "clustered", "representative", "cluster", "visible")


# The greedy pass written sequentially: walk the items in order, carrying the
# visited set and the seeds found so far (a recursive CTE, one step per item).
SQL_BALL_CLUSTERS = f"""
WITH RECURSIVE s AS ({_PART_POS_SQL}),
nb AS (SELECT a.ord AS o, list(b.ord ORDER BY b.ord) AS nbrs
       FROM s a JOIN s b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 10
       GROUP BY a.ord),
seq AS (SELECT row_number() OVER (ORDER BY ord) AS step, ord FROM s),
walk(step, visited, seeds) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.step + 1,
         CASE WHEN list_contains(w.visited, q.ord) OR len(n.nbrs) < 2 THEN w.visited
              ELSE list_concat(w.visited, n.nbrs) END,
         CASE WHEN list_contains(w.visited, q.ord) OR len(n.nbrs) < 2 THEN w.seeds
              ELSE list_append(w.seeds, q.ord) END
  FROM walk w JOIN seq q ON q.step = w.step + 1 JOIN nb n ON n.o = q.ord),
fin AS (SELECT seeds FROM walk WHERE step = (SELECT max(step) FROM walk)),
sd AS (SELECT unnest(seeds) AS seed FROM fin),
mem AS (SELECT sd.seed, unnest(n.nbrs) AS m FROM sd JOIN nb n ON n.o = sd.seed),
mp AS (SELECT mem.seed, mem.m, s.x, s.y FROM mem JOIN s ON s.ord = mem.m),
ctr AS (SELECT seed, avg(x) AS cx, avg(y) AS cy FROM mp GROUP BY seed),
rep AS (SELECT seed, arg_min(m, [sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), m]) AS r
        FROM (SELECT mp.*, ctr.cx, ctr.cy FROM mp JOIN ctr USING (seed)) GROUP BY seed),
lastc AS (SELECT m, max(seed) AS seed FROM mp GROUP BY m),
flags AS (SELECT lastc.m, lastc.seed, rep.r = lastc.m AS representative FROM lastc JOIN rep USING (seed))
SELECT s.ID, flags.m IS NOT NULL AS clustered, coalesce(flags.representative, false) AS representative,
       CAST(flags.seed AS VARCHAR) AS cluster,
       (flags.m IS NULL) OR coalesce(flags.representative, false) AS visible
FROM s LEFT JOIN flags ON flags.m = s.ord
"""


def q_pca_embeddings(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ID"), "embedding")
    pc = positions.pca_positions(emb, vector_col="embedding")
    return pc.select("ID", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


KNN_K = 5


def _pca_sql() -> str:
    """Both axes by repeated squaring of the covariance (the second one after the first is
    taken out), then the projections of the centred rows."""
    def axis(cov: str, name: str) -> str:
        steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {cov}) AS v FROM {cov})"]
        for t in range(18):
            steps.append(f"{name}{t}p AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v "
                         f"FROM {name}{t} a JOIN {name}{t} b ON a.j = b.i GROUP BY a.i, b.j)")
            steps.append(f"{name}{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {name}{t}p) AS v "
                         f"FROM {name}{t}p)")
        last = f"{name}18"
        steps.append(f"{name}c AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = "
                     f"(SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))")
        steps.append(f"{name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM {name}c) * "
                     f"(SELECT CASE WHEN v < 0 THEN -1 ELSE 1 END FROM {name}c ORDER BY abs(v) DESC LIMIT 1) AS v FROM {name}c)")
        return ",\n".join(steps)

    return f"""
WITH e AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS id, generate_subscripts(embedding, 1) AS i,
                               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM e GROUP BY i),
c AS MATERIALIZED (SELECT e.id, e.i, e.x - m.m AS x FROM e JOIN m USING (i)),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (id) GROUP BY a.i, b.i),
{axis("cov", "p")},
lam AS (SELECT sum(a.v * cov.v * b.v) AS l FROM cov JOIN p a ON cov.i = a.i JOIN p b ON cov.j = b.i),
rest AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - lam.l * a.v * b.v AS v
                      FROM cov JOIN p a ON cov.i = a.i JOIN p b ON cov.j = b.i, lam),
{axis("rest", "q")}
SELECT c.id AS ID, round(sum(c.x * p.v), 6) AS x, round(sum(c.x * q.v), 6) AS y
FROM c JOIN p USING (i) JOIN q USING (i) GROUP BY c.id
"""


SQL_PCA_EMBEDDINGS = _pca_sql()


def q_knn_embeddings(spark, sf_dir):
    from featurescape.operators.embed import knn_graph
    emb = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ID"), "embedding")
    g = knn_graph(emb, k=KNN_K, vec_col="embedding")
    return g.select("src", "dst", "rank", _r(F.col("dist")).alias("dist"))


SQL_KNN_EMBEDDINGS = f"""
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS src, b.id AS dst,
             sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist
      FROM e a, e b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM r WHERE rank <= {KNN_K}
"""


def q_neighbor_embedding(spark, sf_dir):
    from featurescape.operators.embed import neighbor_embedding
    emb = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ID"), "embedding")
    return neighbor_embedding(emb, method="umap", vec_col="embedding")


def q_tsne_embedding(spark, sf_dir):
    from featurescape.operators.embed import neighbor_embedding
    emb = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ID"), "embedding")
    return neighbor_embedding(emb, method="tsne", vec_col="embedding", perplexity=30.0)


def q_random_item(spark, sf_dir):
    """SMP-1: one random item for the legend (the limit is the feature)."""
    return items.random_item(part_table(spark, sf_dir, with_order=False)).select("ID")


SQL_RANDOM_ITEM = """
SELECT CAST(p_partkey AS VARCHAR) AS ID FROM part
ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)), CAST(p_partkey AS VARCHAR) LIMIT 1
"""


# ---------------------------------------------------------------- glyph / colour / view
def _part_feature_map(spark, sf_dir):
    enc, _ = part_encoded(spark, sf_dir)
    return enc.select("ID", items.feature_map(enc).alias("features"), "p_retailprice")


def q_glyph_axes(spark, sf_dir):
    fm = _part_feature_map(spark, sf_dir)
    ax = glyph.glyph_axes(fm, ["1", "2", "3", "4"], radius=1.0)
    return ax.select("ID", "feature_id", "idx", *[_r(F.col(c)).alias(c) for c in ("angle", "length", "x", "y")])


def _glyph_sql() -> str:
    return f"""
WITH e AS ({_encoded_part_sql()}),
l AS (SELECT p_partkey, '1' AS feature_id, 0 AS idx, p_brand AS v FROM e
      UNION ALL SELECT p_partkey, '2', 1, p_type FROM e
      UNION ALL SELECT p_partkey, '3', 2, p_size FROM e
      UNION ALL SELECT p_partkey, '4', 3, p_retailprice FROM e),
m AS (SELECT *, max(v) OVER (PARTITION BY p_partkey) AS mx FROM l),
g AS (SELECT p_partkey, feature_id, idx, idx / 4 * (2 * pi()) AS angle,
             v / CASE WHEN mx = 0 THEN 1.0 ELSE mx END AS norm FROM m)
"""


SQL_GLYPH_AXES = _glyph_sql() + """
SELECT CAST(p_partkey AS VARCHAR) AS ID, feature_id, CAST(idx AS INTEGER) AS idx, round(angle, 6) AS angle,
       round(norm * 1.0, 6) AS length, round(cos(angle) * 1.0 * norm, 6) AS x, round(sin(angle) * 1.0 * norm, 6) AS y
FROM g
"""


def q_flat_items(spark, sf_dir):
    fm = _part_feature_map(spark, sf_dir)
    act = ["1", "2", "3", "4"]
    return fm.select("ID", glyph.is_flat(F.col("features"), act).alias("flat"),
                     glyph.is_flat(F.col("features"), act, glyph.FLAT_EPS_LEGEND, strict=True).alias("flat_legend"))


SQL_FLAT_ITEMS = f"""
WITH e AS ({_encoded_part_sql()})
SELECT CAST(p_partkey AS VARCHAR) AS ID,
  (p_brand <= 0.001 AND p_type <= 0.001 AND p_size <= 0.001 AND p_retailprice <= 0.001) AS flat,
  (p_brand < 0.01 AND p_type < 0.01 AND p_size < 0.01 AND p_retailprice < 0.01) AS flat_legend
FROM e
"""


def q_color_scale(spark, sf_dir):
    fm = _part_feature_map(spark, sf_dir)
    v = F.col("p_retailprice")
    return fm.select("ID", colors.continuous_color(v).alias("rgb"), colors.category_color(v).alias("category"),
                     colors.with_alpha(colors.continuous_color(v), 0.5).alias("rgba"))


def _channel_sql(v: str, i: int) -> str:
    stops = [colors._hex_triplet(c)[i] for _, c in colors.RANGE_STOPS]
    a, b, c = stops
    lower = f"({float(a)!r} + ({float(b - a)!r} * (({v} - 0.0) / 0.5)))"
    upper = f"({float(b)!r} + ({float(c - b)!r} * (({v} - 0.5) / 0.5)))"
    raw = f"(CASE WHEN {v} < 0.5 THEN {lower} ELSE {upper} END)"
    return f"CAST(least(greatest(floor({raw} + 0.5), 0.0), 255.0) AS INTEGER)"


def _category_sql(v: str) -> str:
    idx = " + ".join(f"(CASE WHEN {v} >= {k / 10!r} THEN 1 ELSE 0 END)" for k in range(1, 10))
    cases = " ".join(f"WHEN {i} THEN '{colors.hex_to_rgb_literal(h)}'" for i, h in enumerate(colors.CATEGORY_PALETTE))
    return f"(CASE {idx} {cases} END)"


SQL_COLOR_SCALE = f"""
WITH e AS ({_encoded_part_sql()})
SELECT CAST(p_partkey AS VARCHAR) AS ID,
  printf('rgb(%d, %d, %d)', {_channel_sql("p_retailprice", 0)}, {_channel_sql("p_retailprice", 1)}, {_channel_sql("p_retailprice", 2)}) AS rgb,
  {_category_sql("p_retailprice")} AS category,
  printf('rgba(%d,%d,%d,0.5)', {_channel_sql("p_retailprice", 0)}, {_channel_sql("p_retailprice", 1)}, {_channel_sql("p_retailprice", 2)}) AS rgba
FROM e
"""


def q_screen_coords(spark, sf_dir):
    p = part_positions(spark, sf_dir).join(
        _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), "p_size"), "ID")
    sx, sy = view.world_to_screen(F.col("x"), F.col("y"), 0.0, 0.0, 1.5, VIEW_W, VIEW_H)
    zoom = F.col("p_size") / 4.0
    return p.select("ID", _r(sx).alias("sx"), _r(sy).alias("sy"), view.zoom_class(zoom).alias("zoom_class"),
                    _r(view.zoom_after_steps(zoom, F.lit(3.0))).alias("zoom_next"))


SQL_SCREEN_COORDS = f"""
WITH s AS ({_PART_POS_SQL}), p AS (SELECT s.*, part.p_size FROM s JOIN part ON s.ord = part.p_partkey)
SELECT ID, round(((x - 0.0) * {2.0 * 1.5 / VIEW_W!r} + 1) / 2 * {VIEW_W!r} + 0.0, 6) AS sx,
       round((-((y - 0.0) * {2.0 * 1.5 / VIEW_H!r}) + 1) / 2 * {VIEW_H!r} + 0.0, 6) AS sy,
       CASE WHEN p_size / 4.0 < 2 THEN 'low' WHEN p_size / 4.0 < 10 THEN 'medium' ELSE 'high' END AS zoom_class,
       round(least(greatest(p_size / 4.0 * pow(1.1, 3.0), 0.5), 50.0), 6) AS zoom_next
FROM p
"""


# ---------------------------------------------------------------- CAT
def _event_catalog(spark, sf_dir, source: str, where=None) -> DataFrame:
    ev = _t(spark, sf_dir, "events")
    if where is not None:
        ev = ev.where(where)
    snap = ev.select(F.col("event_type").alias("dataset"), F.date_format("ts", "ddMMyyyy").alias("time")).distinct()
    return snap.select("dataset", F.lit(source).alias("source"), "time", F.lit("feature").alias("kind"),
                       F.lit(None).cast("string").alias("subtype"),
                       F.concat_ws(".", "dataset", "time", F.lit("feature.json")).alias("path"))


def q_snapshots_by_day(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("dataset"), F.date_format("ts", "ddMMyyyy").alias("time"))
              .agg(F.count(F.lit(1)).alias("n")))


SQL_SNAPSHOTS_BY_DAY = """
SELECT event_type AS dataset, strftime(ts, '%d%m%Y') AS time, count(*) AS n FROM events GROUP BY 1, 2
"""


def q_merge_catalog(spark, sf_dir):
    cur = _event_catalog(spark, sf_dir, "local", F.month("ts") % 2 == 0)
    new = _event_catalog(spark, sf_dir, "wasm")
    return cat.merge_catalog(cur, new)


SQL_MERGE_CATALOG = """
WITH cur AS (SELECT DISTINCT event_type AS dataset, 'local' AS source, strftime(ts, '%d%m%Y') AS time
             FROM events WHERE month(ts) % 2 = 0),
new AS (SELECT DISTINCT event_type AS dataset, 'wasm' AS source, strftime(ts, '%d%m%Y') AS time FROM events),
srcs AS (SELECT DISTINCT dataset, source FROM cur),
m AS (SELECT dataset, source, time FROM cur
      UNION ALL
      SELECT n.dataset, coalesce(s.source, n.source), n.time FROM new n LEFT JOIN srcs s ON n.dataset = s.dataset
      WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.dataset = n.dataset AND c.time = n.time))
SELECT dataset, source, time, 'feature' AS kind, CAST(NULL AS VARCHAR) AS subtype,
       dataset || '.' || time || '.feature.json' AS path FROM m
"""


def q_catalog_listing(spark, sf_dir):
    """CAT-2, CAT-3, CAT-4 over a catalogue of daily snapshots: the catalogue's
    lists (one row per dataset and time) are what reaches the driver."""
    ev = _t(spark, sf_dir, "events")
    placed = (ev.select(F.col("event_type").alias("dataset"), F.date_format("ts", "ddMMyyyy").alias("time"),
                        F.concat(F.lit("layout"), F.col("user_id") % 3).alias("subtype")).distinct()
              .select("dataset", F.lit("wasm").alias("source"), "time", F.lit("position").alias("kind"), "subtype",
                      F.concat_ws(".", "dataset", "time", F.lit("position"), "subtype", F.lit("json")).alias("path")))
    catalogue = materialize(_event_catalog(spark, sf_dir, "wasm").unionByName(placed))
    rows = []
    for name in sorted(r["dataset"] for r in cat.datasets(catalogue).collect()):
        times = cat.timestamps(catalogue, name)
        algorithms = ",".join(cat.algorithms(catalogue, name))
        rows += [(name, i, t, algorithms) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "dataset string, place long, time string, algorithms string")


SQL_CATALOG_LISTING = """
WITH s AS (SELECT DISTINCT event_type AS dataset, strftime(ts, '%d%m%Y') AS time FROM events),
t AS (SELECT dataset, time, row_number() OVER (PARTITION BY dataset ORDER BY time) - 1 AS place FROM s),
a AS (SELECT DISTINCT event_type AS dataset, strftime(ts, '%d%m%Y') AS time, 'layout' || (user_id % 3) AS subtype
      FROM events),
f AS (SELECT t.dataset, string_agg(a.subtype, ',' ORDER BY a.subtype) AS algorithms
      FROM t JOIN a USING (dataset, time) WHERE t.place = 0 GROUP BY t.dataset)
SELECT t.dataset, CAST(t.place AS BIGINT) AS place, t.time, f.algorithms FROM t JOIN f USING (dataset)
"""


# ---------------------------------------------------------------- registry
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "encode_part": q_encode_part,
    "encode_part_whole": q_encode_part_whole,
    "encode_customer": q_encode_customer,
    "label_dictionary": q_label_dictionary,
    "standardize_part": q_standardize_part,
    "coerce_numbers": q_coerce_numbers,
    "ensure_id": q_ensure_id,
    "profile_lineitem": q_profile_lineitem,
    "histogram_lineitem": q_histogram_lineitem,
    "brush_to_range": q_brush_to_range,
    "item_details": q_item_details,
    "filter_range": q_filter_range,
    "filter_text": q_filter_text,
    "filter_ids": q_filter_ids,
    "filter_compose": q_filter_compose,
    "mark_passive_counts": q_mark_passive_counts,
    "idset_toggle": q_idset_toggle,
    "scaled_positions": q_scaled_positions,
    "bounds": q_bounds,
    "pair_positions": q_pair_positions,
    "geo_positions": q_geo_positions,
    "attach_positions": q_attach_positions,
    "select_rect": q_select_rect,
    "visible_in_view": q_visible_in_view,
    "lens": q_lens,
    "nearest_batch": q_nearest_batch,
    "radius_neighbors": q_radius_neighbors,
    "grid_clusters": q_grid_clusters,
    "ball_clusters": q_ball_clusters,
    "pca_embeddings": q_pca_embeddings,
    "knn_embeddings": q_knn_embeddings,
    "neighbor_embedding": q_neighbor_embedding,
    "tsne_embedding": q_tsne_embedding,
    "random_item": q_random_item,
    "glyph_axes": q_glyph_axes,
    "flat_items": q_flat_items,
    "color_scale": q_color_scale,
    "screen_coords": q_screen_coords,
    "snapshots_by_day": q_snapshots_by_day,
    "merge_catalog": q_merge_catalog,
    "catalog_listing": q_catalog_listing,
    "raw_values_long": q_raw_values_long,
    "settled_items": q_settled_items,
    "select_positions": q_select_positions,
}

ORACLE_SQL: dict[str, str] = {
    "encode_part": SQL_ENCODE_PART,
    "encode_part_whole": SQL_ENCODE_PART_WHOLE,
    "encode_customer": SQL_ENCODE_CUSTOMER,
    "label_dictionary": SQL_LABEL_DICTIONARY,
    "standardize_part": SQL_STANDARDIZE_PART,
    "coerce_numbers": SQL_COERCE_NUMBERS,
    "ensure_id": SQL_ENSURE_ID,
    "profile_lineitem": SQL_PROFILE_LINEITEM,
    "histogram_lineitem": SQL_HISTOGRAM_LINEITEM,
    "brush_to_range": SQL_BRUSH_TO_RANGE,
    "item_details": SQL_ITEM_DETAILS,
    "filter_range": SQL_FILTER_RANGE,
    "filter_text": SQL_FILTER_TEXT,
    "filter_ids": SQL_FILTER_IDS,
    "filter_compose": SQL_FILTER_COMPOSE,
    "mark_passive_counts": SQL_MARK_PASSIVE_COUNTS,
    "idset_toggle": SQL_IDSET_TOGGLE,
    "scaled_positions": SQL_SCALED_POSITIONS,
    "bounds": SQL_BOUNDS,
    "pair_positions": SQL_PAIR_POSITIONS,
    "geo_positions": SQL_GEO_POSITIONS,
    "attach_positions": SQL_ATTACH_POSITIONS,
    "random_item": SQL_RANDOM_ITEM,
    "select_rect": SQL_SELECT_RECT,
    "visible_in_view": SQL_VISIBLE_IN_VIEW,
    "lens": SQL_LENS,
    "nearest_batch": SQL_NEAREST_BATCH,
    "radius_neighbors": SQL_RADIUS_NEIGHBORS,
    "ball_clusters": SQL_BALL_CLUSTERS,
    "grid_clusters": SQL_GRID_CLUSTERS,
    "pca_embeddings": SQL_PCA_EMBEDDINGS,
    "knn_embeddings": SQL_KNN_EMBEDDINGS,
    "glyph_axes": SQL_GLYPH_AXES,
    "flat_items": SQL_FLAT_ITEMS,
    "color_scale": SQL_COLOR_SCALE,
    "screen_coords": SQL_SCREEN_COORDS,
    "snapshots_by_day": SQL_SNAPSHOTS_BY_DAY,
    "merge_catalog": SQL_MERGE_CATALOG,
    "catalog_listing": SQL_CATALOG_LISTING,
    "raw_values_long": SQL_RAW_VALUES_LONG,
    "settled_items": SQL_SETTLED_ITEMS,
    "select_positions": SQL_SELECT_POSITIONS,
}
