"""Column profiles (AGG-1 ... AGG-6, AGG-10).

* min / max / population variance / deviation: one global aggregate over
  all feature columns (partial aggregation per task, one tiny final merge).
* exact median: a mergeable quantile sketch (in the same aggregate) brackets the
  middle rank, a second scan counts what lies below the bracket and its
  sub-bins (map-side aggregate, shuffle bounded by features x bins), and a third
  one groups the values of the one sub-bin that holds the rank, sorts these by range
  and picks the value.  Three scans whatever the distribution; no step buffers
  the values of a column, unlike ``percentile`` whose exact buffer would meet in one task.
* histogram: the numpy equal-width rule with its edge corrections (Q6),
  grouped map-side, zero-filled against a features x bins grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescape.functions.numbers import to_number_or_zero
from featurescape.operators.encode import feature_columns, fill_number, is_numeric_type
from featurescape.session import materialize

# Histogram resolution of the meta document.
HISTOGRAM_BINS = 50
MEDIAN_SUB_BINS = 1024
SKETCH_ACCURACY = 10_000    # relative rank error of the quantile sketch, inverted


class NonFiniteValuesError(ValueError):
    """Q8: infinite values make the equal-width histogram undefined."""


@dataclass
class ColumnStats:
    fid: str
    name: str
    n: int
    lo: float
    hi: float
    variance: float
    deviation: float
    median: float | None = None
    bracket: tuple | None = None        # values around the middle ranks


def numeric_view(df: DataFrame, cols: list[str], encoded: bool = False) -> DataFrame:
    """The values the profile is computed on: numbers filled with 0, text
    coerced with pandas ``to_numeric`` rules (unparseable -> 0, Q10).
    Columns are renamed to their feature ids."""
    dtypes = dict(df.dtypes)
    exprs = []
    for i, c in enumerate(cols, start=1):
        col = F.col(f"`{c}`")
        v = fill_number(col) if (encoded or is_numeric_type(dtypes[c])) else to_number_or_zero(col)
        exprs.append(v.alias(f"f{i}"))
    return df.select(*exprs)


def basic_stats(num: DataFrame, cols: list[str]) -> list[ColumnStats]:
    """AGG-1, AGG-3, AGG-4 and the median's bracket in one aggregate."""
    # The sketch's ranks are off by n / accuracy at most; twice that on either side.
    around = [0.5 - 2 / SKETCH_ACCURACY, 0.5 + 2 / SKETCH_ACCURACY]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(1, len(cols) + 1):
        v = F.col(f"f{i}")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.var_pop(v).alias(f"va{i}"), F.stddev_pop(v).alias(f"sd{i}"),
                 F.percentile_approx(v, around, SKETCH_ACCURACY).alias(f"br{i}")]
    row = num.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols, start=1):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is not None and (abs(lo) == float("inf") or abs(hi) == float("inf")):
            raise NonFiniteValuesError(f"column {c!r} holds infinite values")
        out.append(ColumnStats(str(i), c, int(row["n"]), lo, hi,
                               row[f"va{i}"], row[f"sd{i}"], bracket=tuple(row[f"br{i}"] or ()) or None))
    return out


def _bin_of(v: Column, lo: float, hi: float, bins: int) -> Column:
    if hi - lo == float("inf"):     # halves, so that the width stays finite
        v, lo, hi = v / F.lit(2.0), lo / 2, hi / 2
    return F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("long"),
                   F.lit(bins - 1).cast("long"))


def _counts(num: DataFrame, brackets: list[tuple[str, float, float]], bins: int) -> dict[int, list]:
    """Per bracket (feature, lo, hi): (bin, rows, min, max) in order; bin -1 is all that lies below."""
    parts = []
    for j, (fid, lo, hi) in enumerate(brackets):
        v = F.col(f"f{fid}")
        inside = F.lit(0).cast("long") if lo == hi else _bin_of(v, lo, hi, bins)
        b = F.when(v < F.lit(lo), F.lit(-1).cast("long")).when(v <= F.lit(hi), inside)
        parts.append(F.struct(F.lit(j).alias("j"), b.alias("b"), v.alias("v")))
    rows = (num.select(F.explode(F.array(*parts)).alias("p")).where(F.col("p.b").isNotNull())
            .groupBy("p.j", "p.b").agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("mn"), F.max("p.v").alias("mx"))
            .collect())  # <= brackets x (bins + 1) rows
    found: dict[int, list] = {j: [] for j in range(len(brackets))}
    for r in sorted(rows, key=lambda r: (r["j"], r["b"])):
        found[r["j"]].append((r["b"], r["n"], r["mn"], r["mx"]))
    return found


def _pick(num: DataFrame, wanted: list[tuple[str, float, float, int]]) -> list[float]:
    """The value at a 0-based rank among a feature's values in [lo, hi], for each
    (feature, lo, hi, rank): distinct values with their counts, sorted by range."""
    parts = []
    for j, (fid, lo, hi, _) in enumerate(wanted):
        v = F.col(f"f{fid}")
        parts.append(F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.struct(F.lit(j).alias("j"), v.alias("v"))))
    values = (num.select(F.explode(F.array(*parts)).alias("p")).where(F.col("p").isNotNull())
              .groupBy("p.j", "p.v").agg(F.count(F.lit(1)).alias("n")))
    values = materialize(values.repartitionByRange("j", "v").withColumn("part", F.spark_partition_id()))
    sums: dict[int, list] = {}
    for r in values.groupBy("j", "part").agg(F.sum("n").alias("n")).collect():    # features x partitions rows
        sums.setdefault(r["j"], []).append((r["part"], r["n"]))
    places = []
    for j, (*_, rank) in enumerate(wanted):
        for part, n in sorted(sums[j]):
            if rank < n:
                places.append((j, part, rank))
                break
            rank -= n
    spot = num.sparkSession.createDataFrame(places, "j int, part int, rank long")
    upto = F.sum("n").over(Window.partitionBy("j", "part").orderBy("v"))          # one sorted partition
    rows = (values.join(F.broadcast(spot), ["j", "part"]).withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
            .groupBy("j").agg(F.min("v").alias("v")).collect())
    return [r["v"] for r in sorted(rows, key=lambda r: r["j"])]


def exact_medians(num: DataFrame, stats: list[ColumnStats],
                  sub_bins: int = MEDIAN_SUB_BINS) -> dict[str, float]:
    """AGG-2: exact median (mean of the two middle values) per feature, in two scans
    after the one of :func:`basic_stats`."""
    full = [s for s in stats if s.n and s.lo is not None]
    brackets = [(s.fid, *(s.bracket or (s.lo, s.hi))) for s in full]
    found = _counts(num, brackets, sub_bins) if full else {}
    done: dict[tuple[str, int], float] = {}
    wanted = []
    for j, s in enumerate(full):
        for rank in {(s.n - 1) // 2, s.n // 2}:
            before = 0
            for b, n, mn, mx in found[j]:
                if rank < before + n:
                    if b >= 0 and mn == mx:
                        done[s.fid, rank] = mn
                    else:              # b < 0: the sketch was off, which costs time only
                        wanted.append((s.fid, mn, mx, rank - before, rank))
                    break
                before += n
            else:
                wanted.append((s.fid, s.lo, s.hi, rank, rank))
    if wanted:
        for w, v in zip(wanted, _pick(num, [w[:4] for w in wanted])):
            done[w[0], w[4]] = v
    out: dict[str, float] = {s.fid: None for s in stats}
    for s in full:
        a, b = done[s.fid, (s.n - 1) // 2], done[s.fid, s.n // 2]
        out[s.fid] = a if s.n % 2 else (a + b) / 2
    return out


def profile_stats(df: DataFrame, cols: list[str] | None = None,
                  encoded: bool = False) -> list[ColumnStats]:
    cols = cols if cols is not None else feature_columns(df, df.columns[0])
    num = numeric_view(df, cols, encoded)
    stats = basic_stats(num, cols)
    med = exact_medians(num, stats)
    for s in stats:
        s.median = med[s.fid]
    return stats


def profile(df: DataFrame, cols: list[str] | None = None, encoded: bool = False) -> DataFrame:
    """AGG-1...4: ``(feature_id, name, min, max, median, variance,
    deviation)`` -- one row per feature (the meta statistics)."""
    stats = profile_stats(df, cols, encoded)
    rows = [(s.fid, s.name, _f(s.lo), _f(s.hi), _f(s.median), _f(s.variance), _f(s.deviation))
            for s in stats]
    return df.sparkSession.createDataFrame(
        rows, "feature_id string, name string, min double, max double, median double, "
              "variance double, deviation double")


def _f(x):
    return None if x is None else float(x)


def histogram_edges(lo: float, hi: float) -> tuple[float, float]:
    """numpy's range rule: a constant column gets [v - 0.5, v + 0.5]."""
    if lo == hi:
        return lo - 0.5, hi + 0.5
    return lo, hi


def _edge(k: Column, first: Column, last: Column, bins: int) -> Column:
    step = (last - first) / F.lit(float(bins))
    return F.when(k == bins, last).otherwise(k.cast("double") * step + first)


def _i0(v: Column, first: Column, last: Column, bins: int) -> Column:
    return F.least(F.floor((v - first) / (last - first) * F.lit(float(bins))).cast("long"),
                   F.lit(bins - 1).cast("long"))


def _i1(v: Column, i0: Column, first: Column, last: Column, bins: int) -> Column:
    return F.when(v < _edge(i0, first, last, bins), i0 - 1).otherwise(i0)


def _i2(v: Column, i1: Column, first: Column, last: Column, bins: int) -> Column:
    return F.when((v >= _edge(i1 + 1, first, last, bins)) & (i1 != bins - 1), i1 + 1).otherwise(i1)


def bin_expr(v: Column, first: Column, last: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """Q6: the numpy equal-width bin of ``v`` in [first, last], including
    its edge corrections (floor of the scaled offset, clamp of the last
    edge, one step down/up when the computed edge disagrees).  Single
    expression form; :func:`with_bins` evaluates the steps once each."""
    i0 = _i0(v, first, last, bins)
    return _i2(v, _i1(v, i0, first, last, bins), first, last, bins)


def with_bins(num: DataFrame, edges: list[tuple[str, float, float]], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``b<fid>`` bin columns for ``f<fid>`` value columns.  The three steps
    of :func:`bin_expr` are separate projections so that each intermediate
    is computed once per row (the inlined form repeats the first step ~20
    times and outgrows whole-stage codegen)."""
    vals = [F.col(f"f{fid}") for fid, _, _ in edges]
    s1 = num.select(*vals, *[_i0(F.col(f"f{fid}"), F.lit(a), F.lit(b), bins).alias(f"_a{fid}")
                             for fid, a, b in edges])
    s2 = s1.select(*vals, *[_i1(F.col(f"f{fid}"), F.col(f"_a{fid}"), F.lit(a), F.lit(b), bins).alias(f"_b{fid}")
                            for fid, a, b in edges])
    return s2.select(*[_i2(F.col(f"f{fid}"), F.col(f"_b{fid}"), F.lit(a), F.lit(b), bins).alias(f"b{fid}")
                       for fid, a, b in edges])


def bin_width(b: Column, first: Column, last: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """``np.diff`` of the linspace edges for bin ``b``."""
    step = (last - first) / F.lit(float(bins))
    upper = F.when(b + 1 == bins, last).otherwise((b + 1).cast("double") * step + first)
    return upper - (b.cast("double") * step + first)


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = HISTOGRAM_BINS,
              encoded: bool = False, stats: list[ColumnStats] | None = None) -> DataFrame:
    """AGG-5 + AGG-10: ``(feature_id, name, bin, count, density,
    relative)`` -- density = count / width / n like ``np.histogram(...,
    density=True)``; ``relative`` = density / max density of the feature."""
    cols = cols if cols is not None else feature_columns(df, df.columns[0])
    num = numeric_view(df, cols, encoded)
    stats = stats or basic_stats(num, cols)
    spark = df.sparkSession
    edges = []
    for s in stats:
        if s.n == 0:
            continue
        first, last = histogram_edges(s.lo, s.hi)
        edges.append((s.fid, s.name, first, last, s.n))
    if not edges:
        return spark.createDataFrame([], "feature_id string, name string, bin int, count bigint, "
                                         "density double, relative double")
    binned = with_bins(num, [(fid, a, b) for fid, _, a, b, _ in edges], bins)
    binned = binned.toDF(*[fid for fid, *_ in edges])
    counts = (binned.unpivot([], [fid for fid, *_ in edges], "feature_id", "bin")
                    .groupBy("feature_id", "bin").agg(F.count(F.lit(1)).alias("count")))
    # features x bins grid: bounded by the schema, never by the data
    grid = (spark.createDataFrame(edges, "feature_id string, name string, first double, last double, n bigint")
                 .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))))
    out = (grid.join(counts, ["feature_id", "bin"], "left")
               .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long")))
    width = bin_width(F.col("bin"), F.col("first"), F.col("last"), bins)
    out = out.withColumn("density", F.col("count") / width / F.col("n"))
    w = Window.partitionBy("feature_id")
    out = out.withColumn("relative", F.col("density") / F.max("density").over(w))
    return out.select("feature_id", "name", F.col("bin").cast("int").alias("bin"),
                      "count", "density", "relative")


def build_meta(df: DataFrame, cols: list[str] | None = None, bins: int = HISTOGRAM_BINS,
               encoded: bool = False) -> DataFrame:
    """AGG-6: one row ``features MAP<STRING, STRUCT<histogram MAP<STRING,
    DOUBLE>, max, min, median, variance, deviation>>`` (the meta document)."""
    cols = cols if cols is not None else feature_columns(df, df.columns[0])
    stats = profile_stats(df, cols, encoded)
    hist = histogram(df, cols, bins, encoded, stats)
    spark = df.sparkSession
    st = spark.createDataFrame(
        [(s.fid, _f(s.hi), _f(s.lo), _f(s.median), _f(s.variance), _f(s.deviation)) for s in stats],
        "feature_id string, max double, min double, median double, variance double, deviation double")
    per_feature = (hist.groupBy("feature_id")
                       .agg(F.map_from_entries(F.collect_list(F.struct(
                           F.col("bin").cast("string"), F.col("density")))).alias("histogram")))
    # one row per feature (schema-bounded) collected into the single map row
    merged = st.join(per_feature, "feature_id", "left")
    return merged.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("feature_id"),
        F.struct("histogram", "max", "min", "median", "variance", "deviation")))).alias("features"))
