"""Per-item glyph geometry on feature maps (PRJ-9, PRJ-10, PRJ-11, AGG-9).

Items carry their context's features as ``MAP<STRING, DOUBLE>`` keyed by
feature id ("1", "2", ...).  Everything is higher-order Column functions:
no explode unless the caller wants one row per axis.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: "flat" thresholds of the 3-D glyph (<=) and the legend (<).
FLAT_EPS_3D = 0.001
FLAT_EPS_LEGEND = 0.01


def active_features(features: Column, active: list[str]) -> Column:
    """PRJ-9: the entries of ``features`` whose id is active."""
    keys = F.array(*[F.lit(str(a)) for a in active]) if active else F.array().cast("array<string>")
    return F.map_filter(features, lambda k, v: F.array_contains(keys, k))


def _sorted_entries(features: Column, active: list[str]) -> Column:
    # JS object keys that look like integers iterate in ascending numeric
    # order: sort by (numeric id, id).
    entries = F.map_entries(active_features(features, active))
    # non-numeric ids sort last (null first field), like JS string keys.
    keyed = F.transform(entries, lambda e: F.struct(
        e["key"].try_cast("long").alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(keyed)


def glyph_values(features: Column, active: list[str]) -> Column:
    """Active values in axis order, ``NaN``/null read as 0 (``+v || 0``)."""
    return F.transform(_sorted_entries(features, active),
                       lambda e: F.coalesce(F.nanvl(e["value"], F.lit(0.0)), F.lit(0.0)))


def row_max(values: Column) -> Column:
    """AGG-9: ``Math.max(...values) || 1`` -- 0, NaN or no values give 1."""
    m = F.array_max(values)
    return F.when(m.isNull() | F.isnan(m) | (m == 0), F.lit(1.0)).otherwise(m)


def glyph_axes(items: DataFrame, active: list[str], radius: float = 1.0,
               linear: bool = False, features_col: str = "features",
               id_col: str = "ID") -> DataFrame:
    """PRJ-10: one row per (item, active feature): axis index, angle
    ``i/n*2pi``, normalised length and end point ``(cos, sin) * r * norm``."""
    ent = _sorted_entries(F.col(features_col), active)
    vals = glyph_values(F.col(features_col), active)
    base = items.select(F.col(id_col), ent.alias("_e"), F.size(ent).alias("_n"), row_max(vals).alias("_mx"))
    ex = base.select(id_col, "_n", "_mx", F.posexplode("_e").alias("idx", "_a"))
    value = F.coalesce(F.nanvl(F.col("_a.value"), F.lit(0.0)), F.lit(0.0))
    norm = value if linear else value / F.col("_mx")
    angle = F.col("idx") / F.col("_n") * F.lit(2 * math.pi)
    return ex.select(
        F.col(id_col), F.col("_a.key").alias("feature_id"), F.col("idx").cast("int").alias("idx"),
        angle.alias("angle"), norm.alias("norm"), (norm * F.lit(radius)).alias("length"),
        (F.cos(angle) * F.lit(radius) * norm).alias("x"),
        (F.sin(angle) * F.lit(radius) * norm).alias("y"))


def is_flat(features: Column, active: list[str], eps: float = FLAT_EPS_3D,
            strict: bool = False) -> Column:
    """PRJ-11: every active value <= eps (``strict``: < eps); an empty set is
    flat; NaN is never small."""
    vals = F.map_values(active_features(features, active))
    if strict:
        return F.forall(vals, lambda v: F.coalesce(v < F.lit(eps), F.lit(False)))
    return F.forall(vals, lambda v: F.coalesce(v <= F.lit(eps), F.lit(False)))
