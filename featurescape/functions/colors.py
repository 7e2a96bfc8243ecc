"""Colour Column functions (SC-1 ... SC-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Continuous scale stops (domain 0, 0.5, 1).
RANGE_STOPS = [(0.0, "#198FBD"), (0.5, "#F7D529"), (1.0, "#F7295B")]

# Categorical palette over ten equal steps of [0, 1].
CATEGORY_PALETTE = ["#4f366d", "#933765", "#d08f51", "#286367", "#8BC34A",
                    "#FFC107", "#2196F3", "#FF5722", "#607D8B", "#BF3330"]

# Colour without features, passive and highlighted items.
FALLBACK_COLOR = "#00cc88"
PASSIVE_COLOR = "#e0e0e0"
HIGHLIGHT_COLOR = "#e3ccd3"


def _hex_triplet(h: str) -> tuple[int, int, int]:
    h = h.lstrip("#")
    return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)


def _js_round(x: Column) -> Column:
    # JavaScript Math.round: halves go up (towards +inf).
    return F.floor(x + F.lit(0.5))


def _channel(v: Column, idx: int) -> Column:
    (d0, c0), (d1, c1), (d2, c2) = RANGE_STOPS
    a, b, c = _hex_triplet(c0)[idx], _hex_triplet(c1)[idx], _hex_triplet(c2)[idx]
    lower = F.lit(float(a)) + (F.lit(float(b - a)) * ((v - F.lit(d0)) / F.lit(d1 - d0)))
    upper = F.lit(float(b)) + (F.lit(float(c - b)) * ((v - F.lit(d1)) / F.lit(d2 - d1)))
    raw = F.when(v < F.lit(d1), lower).otherwise(upper)
    return F.least(F.greatest(_js_round(raw), F.lit(0.0)), F.lit(255.0)).cast("int")


def continuous_color(v: Column) -> Column:
    """SC-1: piecewise-linear RGB interpolation, ``rgb(r, g, b)``; values
    outside [0, 1] extrapolate and clamp per channel; null -> null."""
    v = v.cast("double")
    txt = F.format_string("rgb(%d, %d, %d)", _channel(v, 0), _channel(v, 1), _channel(v, 2))
    return F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string")).otherwise(txt)


def category_index(v: Column, steps: int = 10) -> Column:
    """0-based bucket of a quantize scale on [0, 1]: the number of
    thresholds k/steps (k = 1..steps-1) that are <= v."""
    v = v.cast("double")
    idx = sum((F.when(v >= F.lit(k / steps), F.lit(1)).otherwise(F.lit(0))
               for k in range(1, steps)), F.lit(0))
    return F.when(v.isNull() | F.isnan(v), F.lit(None).cast("int")).otherwise(idx)


def category_color(v: Column) -> Column:
    """SC-2: categorical colour as ``rgb(r, g, b)`` (hex converted as the
    reference does when the discrete scale is active)."""
    palette = F.array(*[F.lit(hex_to_rgb_literal(h)) for h in CATEGORY_PALETTE])
    return F.element_at(palette, category_index(v) + 1)


def hex_to_rgb_literal(h: str | int) -> str:
    """SC-4 for a driver-side literal: a number, or 3 or 6 hex digits with or without ``#``."""
    digits = f"{h:06x}" if isinstance(h, int) else h.lstrip("#")
    if len(digits) not in (3, 6):
        raise ValueError(f"not a colour of 3 or 6 hex digits: {h!r}")
    size = len(digits) // 3
    channels = [digits[i:i + size] * (2 // size) for i in range(0, len(digits), size)]
    return "rgb({}, {}, {})".format(*[int(c, 16) for c in channels])


def hex_to_rgb(c: Column) -> Column:
    """SC-4 on a Column: optional ``#``, 3 or 6 hex digits; anything else
    raises at runtime."""
    s = F.regexp_replace(c.cast("string"), r"^#", "")
    s6 = F.when(F.length(s) == 3,
                F.concat(*[F.repeat(F.substring(s, i, 1), 2) for i in (1, 2, 3)])).otherwise(s)
    ok = s6.rlike(r"^[0-9a-fA-F]{6}$")
    rgb = F.format_string("rgb(%d, %d, %d)",
                          *[F.conv(F.substring(s6, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])
    return F.when(c.isNull(), F.lit(None).cast("string")).when(ok, rgb).otherwise(
        F.raise_error(F.concat(F.lit("Invalid hex color: "), c.cast("string"))))


def _js_number(alpha: float) -> str:
    return str(int(alpha)) if float(alpha).is_integer() else repr(float(alpha))


def with_alpha(color: Column, alpha: float) -> Column:
    """SC-5: ``rgb(..)``/``rgba(..)`` -> ``rgba(r,g,b,alpha)``; other strings
    unchanged."""
    inner = F.substring_index(F.substring_index(F.trim(color), "(", -1), ")", 1)
    numbers = F.transform(F.split(inner, ","), lambda n: F.trim(n))
    is_color = (F.trim(color).startswith("rgb") & F.trim(color).endswith(")") & F.size(numbers).isin(3, 4)
                & F.forall(numbers, lambda n: n.rlike("^[0-9]+[.]?[0-9]*$")))
    return F.when(is_color, F.concat(F.lit("rgba("), F.array_join(F.slice(numbers, 1, 3), ","),
                                     F.lit(f",{_js_number(alpha)})"))).otherwise(color)


def item_color(value: Column, passive: Column | None = None,
               highlighted: Column | None = None, continuous: bool = True,
               has_features: Column | None = None) -> Column:
    """SC-3/SC-6: highlight > passive > feature colour > fallback."""
    base = continuous_color(value) if continuous else category_color(value)
    if has_features is not None:
        base = F.when(has_features, base).otherwise(F.lit(hex_to_rgb_literal(FALLBACK_COLOR)))
    out = base
    if passive is not None:
        out = F.when(F.coalesce(passive, F.lit(False)), F.lit(hex_to_rgb_literal(PASSIVE_COLOR))).otherwise(out)
    if highlighted is not None:
        out = F.when(F.coalesce(highlighted, F.lit(False)), F.lit(hex_to_rgb_literal(HIGHLIGHT_COLOR))).otherwise(out)
    return out
