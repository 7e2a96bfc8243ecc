"""Schema document, item records and id joins (PRJ-3, PRJ-5 ... PRJ-8,
JN-1 ... JN-3, JN-6).

Wide tables stay wide (column pruning and pushdown keep working); nested
``MAP`` records are built only at the edges (sinks, text filter, glyphs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurescape.functions.numbers import py_str
from featurescape.operators.encode import feature_columns

# Schema document defaults.
GLYPH_AXES = 5
DEFAULT_CONTEXT = "1"
CONTEXT_DESCRIPTION = "standard context"


def derive_schema(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """PRJ-3: one-row schema document ``(color, glyph, label, tooltip,
    variantcontext)`` from the column list (driver-side metadata only)."""
    feats = feature_columns(df, id_col)
    ids = [str(i) for i in range(1, len(feats) + 1)]
    spark = df.sparkSession
    row = {
        "color": ids[0] if ids else None,
        "glyph": ids[:GLYPH_AXES],
        "label": dict(zip(ids, feats)),
        "tooltip": ids,
        "variantcontext": {DEFAULT_CONTEXT: {"description": CONTEXT_DESCRIPTION, "id": DEFAULT_CONTEXT}},
    }
    return spark.createDataFrame(
        [row], "color string, glyph array<string>, label map<string,string>, tooltip array<string>, "
               "variantcontext map<string, struct<description:string, id:string>>")


def labels_frame(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """``(feature_id, label)`` rows of the schema (bounded by the schema)."""
    feats = feature_columns(df, id_col)
    return df.sparkSession.createDataFrame([(str(i), c) for i, c in enumerate(feats, start=1)],
                                           "feature_id string, label string")


def raw_values(df: DataFrame, id_col: str = "ID") -> Column:
    """PRJ-5: ``MAP<feature_id, raw string>`` with pandas ``astype(str)``
    formatting (Q5)."""
    dtypes = dict(df.dtypes)
    feats = feature_columns(df, id_col)
    kv = []
    for i, c in enumerate(feats, start=1):
        kv += [F.lit(str(i)), py_str(F.col(f"`{c}`"), dtypes[c])]
    return F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")


def feature_map(df: DataFrame, id_col: str = "ID") -> Column:
    """``MAP<feature_id, normalised value>`` of an encoded wide table."""
    feats = feature_columns(df, id_col)
    kv = []
    for i, c in enumerate(feats, start=1):
        kv += [F.lit(str(i)), F.col(f"`{c}`").cast("double")]
    return F.create_map(*kv) if kv else F.create_map().cast("map<string,double>")


def to_items(raw: DataFrame, model, id_col: str = "ID", order_col: str | None = "_ord") -> DataFrame:
    """PRJ-6: nested item records ``(id, defaultcontext, features{ctx:
    {fid: v}}, values{fid: raw})``.  The raw-value map is computed before
    encoding and carried through the model's transform, so raw and encoded
    values never need a join on the id."""
    carried = raw.withColumn("_values", raw_values(raw, id_col))
    keep = ("_values",) + ((order_col,) if order_col and order_col in raw.columns else ())
    enc = model.transform(carried, keep=keep)
    fm = F.create_map(*[x for s in model.features for x in (F.lit(s.fid), F.col(f"`{s.name}`").cast("double"))])
    extra = [F.col(order_col)] if order_col and order_col in enc.columns else []
    return enc.select(F.col(id_col).alias("id"), F.lit(DEFAULT_CONTEXT).alias("defaultcontext"),
                      F.create_map(F.lit(DEFAULT_CONTEXT), fm).alias("features"),
                      F.col("_values").alias("values"), *extra)


def from_items(items: DataFrame, context: str = DEFAULT_CONTEXT, long: bool = True) -> DataFrame:
    """PRJ-7: back to long ``(id, feature_id, value, raw)`` rows."""
    ex = items.select("id", F.explode(F.col("features")[context]).alias("feature_id", "value"), "values")
    return ex.select("id", "feature_id", "value", F.col("values")[F.col("feature_id")].alias("raw"))


def item_details(items: DataFrame, labels: DataFrame, id_value: str | None = None,
                 fallback_to_id: bool = True) -> DataFrame:
    """PRJ-8 + JN-3: ``(id, feature_id, label, value)`` with the schema label
    or, missing, the feature id (tooltip) / "" (filter list).  Labels are
    one row per feature, so the join is a broadcast."""
    src = items if id_value is None else items.where(F.col("id") == F.lit(id_value))
    ex = src.select("id", F.explode("values").alias("feature_id", "value"))
    j = ex.join(F.broadcast(labels), "feature_id", "left")
    fb = F.col("feature_id") if fallback_to_id else F.lit("")
    return j.select("id", "feature_id", F.coalesce(F.col("label"), fb).alias("label"), "value")


def with_labels(df: DataFrame, labels: DataFrame, fallback: str = "id") -> DataFrame:
    """JN-3 on any ``feature_id`` table."""
    j = df.join(F.broadcast(labels), "feature_id", "left")
    fb = F.col("feature_id") if fallback == "id" else F.lit("")
    return j.withColumn("label", F.coalesce(F.col("label"), fb))


def dedupe_positions(pos: DataFrame, order_col: str = "_pord", id_col: str = "ID",
                     by: tuple[str, ...] = ("algorithm",)) -> DataFrame:
    """Q9 fix: a later duplicate position of the same id wins.  An
    aggregate (``max`` of ``(order, x, y)``) rather than a window, so a hot
    id with many duplicates is combined map-side instead of sorted in one
    task."""
    last = F.max(F.struct(F.col(order_col).alias("o"), F.col("x").alias("x"), F.col("y").alias("y")))
    return (pos.groupBy(*by, id_col).agg(last.alias("_l"))
               .select(*by, id_col, F.col("_l.x").alias("x"), F.col("_l.y").alias("y"),
                       F.col("_l.o").alias(order_col)))


def attach_positions(items: DataFrame, positions: DataFrame, algorithms: list[str],
                     id_col: str = "ID", order_col: str | None = None) -> DataFrame:
    """JN-1/JN-2: items LEFT JOIN positions, one ``(x, y)`` column pair per
    algorithm.  Duplicate position ids: last wins when ``order_col`` gives the
    file order, else the largest (x, y); positions of unknown ids are ignored; duplicate items
    all receive the position (Q9).  The positions are pivoted by id with a
    fixed algorithm list (no extra pass to discover the pivot values), then
    one equi-join -- sort-merge at scale, AQE may switch to broadcast."""
    pos = positions
    if order_col is not None:
        pos = dedupe_positions(pos, order_col, id_col)
    pos = pos.where(F.col("algorithm").isin(*algorithms))
    piv = (pos.groupBy(F.col(id_col).cast("string").alias("_pid"))
              .pivot("algorithm", algorithms)
              .agg(F.max(F.struct("x", "y"))))              # x and y of one row
    rename = []
    for a in algorithms:
        rename += [F.col(f"`{a}`.x").alias(f"{a}_x"), F.col(f"`{a}`.y").alias(f"{a}_y")]
    piv = piv.select("_pid", *rename)
    out = items.join(piv, F.col(id_col).cast("string") == F.col("_pid"), "left").drop("_pid")
    return out


def attach_thumbnails(items: DataFrame, thumbs: DataFrame, id_col: str = "ID") -> DataFrame:
    """JN-6: items LEFT JOIN thumbnails ``(id, path, mime, content)``."""
    t = thumbs.select(F.col("id").alias("_tid"), "path", "mime", "content")
    return items.join(t, F.col(id_col).cast("string") == F.col("_tid"), "left").drop("_tid")


def random_item(items: DataFrame, seed: int = 42, id_col: str = "ID") -> DataFrame:
    """SMP-1: one random item (for the legend; the limit is the feature): the first
    in the order of a hash of seed and id, whatever the partitions."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    return items.withColumn("_r", key).orderBy("_r", id_col).limit(1).drop("_r")
