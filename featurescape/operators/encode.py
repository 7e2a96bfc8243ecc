"""Feature encoding (FE-1 ... FE-8).

``fit_encoder`` learns, with a handful of Spark jobs whose results are
bounded by the number of features, a label dictionary for text columns and
min/max for numeric ones.  ``EncodeModel.transform`` is then a pure, lazy
DataFrame transformation (usable on batch and streaming DataFrames).

Scale notes
-----------
* The dictionary is built from ``distinct`` over an unpivot of the text
  columns: map-side partial aggregation collapses hot values before the
  shuffle, so a value holding a third of all rows costs nothing extra.
* Codes are dense ranks in code-point order.  Small dictionaries (checked
  count) rank with a per-feature window; large ones use the range
  partitioned global index of :mod:`featurescape.operators.ids` -- no single
  task ever sees a whole unbounded dictionary.
* Dictionaries are broadcast, smallest first, while each has at most
  ``broadcast_rows`` rows and together they stay below ``broadcast_bytes``.  One
  column beyond that is a shuffle join that AQE can split on skew.  Several are
  coded in one keyed exchange: their cells (row, feature, value) meet the
  dictionary together and the codes come back as one narrow row per item, so the
  wide rows are shuffled once however many columns there are.  The rows are then
  written first, so that their numbers hold; a stream, which cannot be, is joined
  column by column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescape.operators.ids import BROADCAST_ROW_LIMIT, with_global_index
from featurescape.session import materialize

# Normalised values with |v| below this become 0.0.
SMALL_VALUE_THRESHOLD = 1e-3
# What a missing text value is encoded as.
TEXT_FILL = "0"

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
SMALL_DICTIONARY_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48                  # what a dictionary row takes beside its value


def is_numeric_type(dtype: str) -> bool:
    return dtype in NUMERIC_TYPES or dtype.startswith("decimal")


# Helper columns the engine itself adds (row order, source file/split,
# carried raw values, position file order); user columns are never dropped.
INTERNAL_COLUMNS = frozenset({"_ord", "_src_file", "_src_block", "_values", "_pord"})


def is_internal(c: str) -> bool:
    return c in INTERNAL_COLUMNS or c.startswith("_keep_")


def feature_columns(df: DataFrame, id_col: str = "ID") -> list[str]:
    """PRJ-2: every column after the id except the engine's helper columns."""
    return [c for c in df.columns if c != id_col and not is_internal(c)]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, underlined until no column is called so (Spark ignores case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def fill_number(c: Column) -> Column:
    """FE-1 for numbers: null and NaN -> 0, as double (booleans -> 0/1)."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def fill_text(c: Column) -> Column:
    """FE-1 for text: null -> "0", everything as string."""
    return F.coalesce(c.cast("string"), F.lit(TEXT_FILL))


def minmax_expr(v: Column, lo: float, hi: float) -> Column:
    """FE-4: ``(v - min) / (max - min)``; constant column -> 0.0."""
    if hi - lo == 0:
        return F.lit(0.0)
    return (v - F.lit(lo)) / F.lit(hi - lo)


def threshold_small(v: Column, eps: float = SMALL_VALUE_THRESHOLD) -> Column:
    """FE-5: |v| < eps -> 0.0."""
    return F.when(F.abs(v) < F.lit(eps), F.lit(0.0)).otherwise(v)


@dataclass
class FeatureSpec:
    fid: str
    name: str
    kind: str  # "text" | "number"
    lo: float = 0.0
    hi: float = 0.0
    distinct: int = 0
    size: int = 0               # bytes of its dictionary


@dataclass
class EncodeModel:
    """Fitted encoder.  ``dictionary`` is ``(feature_id, name, value, code)``."""
    id_col: str
    features: list[FeatureSpec]
    dictionary: DataFrame | None
    threshold: float = SMALL_VALUE_THRESHOLD
    broadcast_rows: int = BROADCAST_ROW_LIMIT
    passthrough: list[str] = field(default_factory=list)
    broadcast_bytes: int = BROADCAST_BYTES

    def _broadcast(self) -> set[str]:
        """Ids of the features whose dictionaries are broadcast."""
        found, total = set(), 0
        for spec in sorted((s for s in self.features if s.kind == "text"), key=lambda s: s.size):
            total += spec.size
            if spec.distinct <= self.broadcast_rows and total <= self.broadcast_bytes:
                found.add(spec.fid)
        return found

    def _coded_together(self, df: DataFrame, specs: list[FeatureSpec], code: dict[str, str]) -> DataFrame:
        """``df`` with the code columns of ``specs``."""
        row = free_name("_row", df.columns)
        rows = materialize(df.withColumn(row, F.monotonically_increasing_id()))
        cells = rows.select(row, F.explode(F.array(*[
            F.struct(F.lit(s.fid).alias("feature_id"), fill_text(F.col(f"`{s.name}`")).alias("value"))
            for s in specs])).alias("_cell")).select(row, "_cell.feature_id", "_cell.value")
        coded = cells.join(self.dictionary.select("feature_id", "value", "code"), ["feature_id", "value"])
        codes = coded.groupBy(row).agg(*[
            F.max(F.when(F.col("feature_id") == s.fid, F.col("code"))).alias(code[s.fid]) for s in specs])
        return rows.join(codes, row, "left").drop(row)

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """ID + one normalised double column per feature (same names), plus
        the fitted passthrough columns and ``keep``."""
        out = df
        coded: dict[str, Column] = {}
        small = self._broadcast()
        code = {s.fid: free_name(f"_c{s.fid}", df.columns) for s in self.features}
        large = [s for s in self.features if s.kind == "text" and s.fid not in small]
        together = len(large) > 1 and not df.isStreaming
        if together:
            out = self._coded_together(out, large, code)
        for spec in self.features:
            c = F.col(f"`{spec.name}`")
            if spec.kind == "number":
                v = minmax_expr(fill_number(c), spec.lo, spec.hi)
            else:
                if spec.fid in small or not together:
                    key = free_name(f"_v{spec.fid}", df.columns)
                    d = (self.dictionary.where(F.col("feature_id") == spec.fid)
                             .select(F.col("value").alias(key), F.col("code").alias(code[spec.fid])))
                    if spec.fid in small:
                        d = F.broadcast(d)
                    out = out.join(d, fill_text(c) == F.col(f"`{key}`"), "left")
                v = minmax_expr(F.col(f"`{code[spec.fid]}`").cast("double"), 0.0, float(max(spec.distinct - 1, 0)))
            coded[spec.name] = threshold_small(v, self.threshold)
        extra = [p for p in list(self.passthrough) + list(keep) if p in df.columns]
        extra = [F.col(f"`{p}`").alias(f"_keep_{p}") if p in {s.name for s in self.features} else F.col(f"`{p}`")
                 for p in dict.fromkeys(extra)]
        return out.select(F.col(f"`{self.id_col}`"),
                          *[coded[s.name].alias(s.name) for s in self.features], *extra)

    @property
    def labels(self) -> dict[str, str]:
        return {s.fid: s.name for s in self.features}


def build_dictionary(df: DataFrame, text: list[FeatureSpec],
                     small_rows: int = SMALL_DICTIONARY_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """FE-2/FE-3: ``(feature_id, name, value, code)`` with dense codes in
    code-point order per feature, plus the per-feature distinct counts."""
    spark = df.sparkSession
    if not text:
        empty = spark.createDataFrame([], "feature_id string, name string, value string, code bigint")
        return empty, {}
    wide = df.select(*[fill_text(F.col(f"`{s.name}`")).alias(s.fid) for s in text])
    long = wide.unpivot([], [s.fid for s in text], "feature_id", "value").distinct()
    sizes_rows = long.groupBy("feature_id").agg(F.count(F.lit(1)).alias("count"), F.sum(
        F.octet_length("value") + ROW_BYTES).alias("size")).collect()  # one row per feature
    for s in text:
        s.size = next((int(r["size"]) for r in sizes_rows if r["feature_id"] == s.fid), 0)
    sizes = {r["feature_id"]: int(r["count"]) for r in sizes_rows}
    total = sum(sizes.values())
    if total <= small_rows:
        w = Window.partitionBy("feature_id").orderBy("value")
        coded = long.withColumn("code", (F.dense_rank().over(w) - 1).cast("long"))
    else:
        indexed = with_global_index(long, ["feature_id", "value"], name="_gidx")
        first = indexed.groupBy("feature_id").agg(F.min("_gidx").alias("_first"))
        coded = (indexed.join(F.broadcast(first), "feature_id")
                        .withColumn("code", F.col("_gidx") - F.col("_first"))
                        .drop("_gidx", "_first"))
    names = F.create_map(*[x for s in text for x in (F.lit(s.fid), F.lit(s.name))])
    coded = coded.select("feature_id", F.element_at(names, F.col("feature_id")).alias("name"),
                         "value", "code")
    return coded, sizes


def fit_encoder(df: DataFrame, id_col: str = "ID", threshold: float = SMALL_VALUE_THRESHOLD,
                passthrough: tuple[str, ...] = ("_ord",),
                broadcast_rows: int = BROADCAST_ROW_LIMIT, broadcast_bytes: int = BROADCAST_BYTES) -> EncodeModel:
    """FE-6 fit: text (non-numeric) columns are label encoded, numbers
    (booleans included) filled with 0 and min-max normalised."""
    dtypes = dict(df.dtypes)
    specs = []
    for i, name in enumerate(feature_columns(df, id_col), start=1):
        kind = "number" if is_numeric_type(dtypes[name]) else "text"
        specs.append(FeatureSpec(str(i), name, kind))
    numbers = [s for s in specs if s.kind == "number"]
    text = [s for s in specs if s.kind == "text"]
    if numbers:
        aggs = []
        for s in numbers:
            v = fill_number(F.col(f"`{s.name}`"))
            aggs += [F.min(v).alias(f"lo{s.fid}"), F.max(v).alias(f"hi{s.fid}")]
        row = df.agg(*aggs).collect()[0]  # 2 values per feature
        for s in numbers:
            s.lo = float(row[f"lo{s.fid}"]) if row[f"lo{s.fid}"] is not None else 0.0
            s.hi = float(row[f"hi{s.fid}"]) if row[f"hi{s.fid}"] is not None else 0.0
    dictionary, sizes = build_dictionary(df, text)
    if text:
        # FE-3: the fitted dictionary is a table; transforms join against it
        # instead of re-deriving it from the raw data per text column
        dictionary = materialize(dictionary)
    for s in text:
        s.distinct = sizes.get(s.fid, 0)
    return EncodeModel(id_col, specs, dictionary, threshold, broadcast_rows,
                       [p for p in passthrough if p in df.columns], broadcast_bytes)


def encode_features(df: DataFrame, id_col: str = "ID", **kw) -> tuple[DataFrame, EncodeModel]:
    """FE-6: fit + transform."""
    model = fit_encoder(df, id_col, **kw)
    return model.transform(df), model


def label_encode(df: DataFrame, cols: list[str], id_col: str = "ID") -> tuple[DataFrame, DataFrame]:
    """FE-2: replace ``cols`` by integer codes; returns (df, dictionary)."""
    specs = [FeatureSpec(str(i), c, "text") for i, c in enumerate(cols, start=1)]
    dictionary, sizes = build_dictionary(df, specs)
    out = df
    for s in specs:
        key, code = f"_v{s.fid}", f"_c{s.fid}"
        d = dictionary.where(F.col("feature_id") == s.fid).select(
            F.col("value").alias(key), F.col("code").alias(code))
        if sizes.get(s.fid, 0) <= BROADCAST_ROW_LIMIT:
            d = F.broadcast(d)
        out = (out.join(d, fill_text(F.col(f"`{s.name}`")) == F.col(key), "left")
                  .withColumn(s.name, F.col(code)).drop(key, code))
    return out, dictionary


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """FE-4 on numeric columns (nulls/NaN count as 0)."""
    aggs = []
    for c in cols:
        v = fill_number(F.col(f"`{c}`"))
        aggs += [F.min(v).alias(f"lo_{c}"), F.max(v).alias(f"hi_{c}")]
    row = df.agg(*aggs).collect()[0]
    out = df
    for c in cols:
        lo, hi = (0.0 if row[k] is None else float(row[k]) for k in (f"lo_{c}", f"hi_{c}"))  # no rows
        out = out.withColumn(c, minmax_expr(fill_number(F.col(f"`{c}`")), lo, hi))
    return out


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """FE-8: subtract the mean, divide by the population std (0 -> 1),
    nulls/NaN filled with 0 first."""
    aggs = []
    for c in cols:
        v = fill_number(F.col(f"`{c}`"))
        aggs += [F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"s_{c}")]
    row = df.agg(*aggs).collect()[0]
    out = df
    for c in cols:
        m, s = (0.0 if row[k] is None else float(row[k]) for k in (f"m_{c}", f"s_{c}"))  # no rows
        s = 1.0 if s == 0 else s
        out = out.withColumn(c, (fill_number(F.col(f"`{c}`")) - F.lit(m)) / F.lit(s))
    return out
