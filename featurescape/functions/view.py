"""View and formatting Column functions (SC-7 ... SC-15)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zoom thresholds, zoom limits and step factor, fit margin.
ZOOM_LOW_BELOW = 2.0
ZOOM_MEDIUM_BELOW = 10.0
ZOOM_MIN, ZOOM_MAX, ZOOM_STEP = 0.5, 50.0, 1.1
FIT_MARGIN = 1.1

# Jitter hash multipliers.
JITTER_MULTIPLIERS = (73856093, 19349663, 83492791)

# Thumbnail extensions and MIME types.
MIME_BY_SUFFIX = [(".png", "image/png"), (".jpg", "image/jpeg"),
                  (".jpeg", "image/jpeg"), (".webp", "image/webp")]
DEFAULT_MIME = "application/octet-stream"


def zoom_class(zoom: Column) -> Column:
    """SC-7: ``low`` below 2, ``medium`` below 10, else ``high``."""
    return (F.when(zoom < ZOOM_LOW_BELOW, F.lit("low"))
             .when(zoom < ZOOM_MEDIUM_BELOW, F.lit("medium"))
             .otherwise(F.lit("high")))


def zoom_after_steps(zoom: Column, steps: Column) -> Column:
    """SC-8: ``steps`` wheel steps of factor 1.1, clamped to [0.5, 50]."""
    return F.least(F.greatest(zoom * F.pow(F.lit(ZOOM_STEP), steps), F.lit(ZOOM_MIN)), F.lit(ZOOM_MAX))


def world_to_screen(x: Column, y: Column, cx: float, cy: float, zoom: float,
                    width: float, height: float, left: float = 0.0, top: float = 0.0):
    """SC-9: orthographic camera centred at (cx, cy) with frustum
    width x height -> screen pixels (y grows downwards)."""
    ndc_x = (x - F.lit(cx)) * F.lit(2.0 * zoom / width)
    ndc_y = (y - F.lit(cy)) * F.lit(2.0 * zoom / height)
    sx = (ndc_x + 1) / 2 * F.lit(width) + F.lit(left)
    sy = (-ndc_y + 1) / 2 * F.lit(height) + F.lit(top)
    return sx, sy


def screen_to_world(sx: Column, sy: Column, cx: float, cy: float, zoom: float,
                    width: float, height: float, left: float = 0.0, top: float = 0.0):
    ndc_x = (sx - F.lit(left)) / F.lit(width) * 2 - 1
    ndc_y = -((sy - F.lit(top)) / F.lit(height) * 2 - 1)
    return (ndc_x * F.lit(width / (2.0 * zoom)) + F.lit(cx),
            ndc_y * F.lit(height / (2.0 * zoom)) + F.lit(cy))


def sanitize_label(s: Column) -> Column:
    """SC-10: keep ``[a-zA-Z0-9_-]`` only."""
    return F.regexp_replace(s, r"[^a-zA-Z0-9_-]", "")


def _js_hundredths(cents: Column) -> Column:
    # JavaScript prints 0.5 as "0.5", 1 as "1", 0.25 as "0.25".
    whole = F.floor(cents / 100).cast("long").cast("string")
    frac = F.pmod(cents, F.lit(100)).cast("int")
    two = F.lpad(frac.cast("string"), 2, "0")
    return (F.when(frac == 0, whole)
             .when(F.pmod(frac, F.lit(10)) == 0, F.concat(whole, F.lit("."), F.substring(two, 1, 1)))
             .otherwise(F.concat(whole, F.lit("."), two)))


def bin_label(bin_idx: Column, bins: int = 50) -> Column:
    """SC-11: ``lo-hi`` of a histogram bin, rounded to two decimals."""
    lo = F.floor(bin_idx / F.lit(float(bins)) * 100 + 0.5).cast("long")
    hi = F.floor((bin_idx + 1) / F.lit(float(bins)) * 100 + 0.5).cast("long")
    return F.concat(_js_hundredths(lo), F.lit("-"), _js_hundredths(hi))


def _to_int32(v: Column) -> Column:
    # ECMAScript ToInt32: truncate, wrap modulo 2^32 into the signed range.
    t = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(
        F.signum(v) * F.floor(F.abs(v)))
    m = F.pmod(t, F.lit(4294967296.0))
    return F.when(m >= 2147483648.0, m - 4294967296.0).otherwise(m).cast("long").cast("int")


def jitter(x: Column, y: Column, z: Column | None = None) -> Column:
    """SC-12: deterministic value in [-1, 1] from a position (32-bit XOR of
    scaled coordinates, sine hash)."""
    z = z if z is not None else F.lit(0.0)
    a, b, c = (_to_int32(col.cast("double") * F.lit(float(m)))
               for col, m in zip((x, y, z), JITTER_MULTIPLIERS))
    seed = a.bitwiseXOR(b).bitwiseXOR(c)
    rng = F.sin(seed.cast("double")) * 10000
    return (rng - F.floor(rng)) * 2 - 1


def mime_type(name: Column) -> Column:
    """SC-13: MIME type from the (case-sensitive) file extension."""
    out = F.lit(DEFAULT_MIME)
    for suffix, mime in reversed(MIME_BY_SUFFIX):
        out = F.when(name.endswith(suffix), F.lit(mime)).otherwise(out)
    return out


def fit_zoom(width_data: Column, height_data: Column, view_w: float, view_h: float) -> Column:
    """SC-15: zoom that fits the data box plus 10% margin into the view."""
    return F.least(F.lit(view_w) / (width_data * FIT_MARGIN), F.lit(view_h) / (height_data * FIT_MARGIN))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """SC-14: Euclidean distance."""
    return F.hypot(x1 - x2, y1 - y2)


TWO_PI = 2 * math.pi
