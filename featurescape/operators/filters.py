"""Item filters and their composition (FLT-1 ... FLT-12, FLT-16, FLT-17, AGG-8).

A filter is a small driver-side object that yields a null-safe ``Column``
predicate; composition is boolean algebra on Columns, so Catalyst pushes
range predicates on real columns into the Parquet scan.  Id sets that are
themselves DataFrames (selections of any size) are applied with a semi-join
instead of an ``isin`` literal list.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterMode(Enum):
    AND = "and"
    OR = "or"


def _check_bound(bound) -> float:
    """FLT-2: bounds are normalised values."""
    if bound is None or not 0 <= bound <= 1:
        raise ValueError(f"bounds of a feature filter are numbers from 0 to 1, got {bound!r}")
    return float(bound)


@dataclass
class FeatureFilter:
    """FLT-1/2: normalised value of ``feature`` within [lo, hi] (inclusive).
    A fresh filter has bounds 0..0 and is *not* empty (Q19); missing and NaN
    values never pass (Q20)."""
    feature: str
    lo: float | None = 0.0
    hi: float | None = 0.0
    mode: FilterMode = FilterMode.AND

    def __post_init__(self):
        if self.lo is not None:
            self.lo = _check_bound(self.lo)
        if self.hi is not None:
            self.hi = _check_bound(self.hi)

    def set_range(self, lo: float, hi: float) -> "FeatureFilter":
        self.lo, self.hi = _check_bound(lo), _check_bound(hi)
        return self

    @property
    def empty(self) -> bool:
        return self.lo is None or self.hi is None

    def clear(self):
        self.lo = self.hi = None

    def predicate(self) -> Column:
        if self.empty:
            return F.lit(False)
        v = F.col(f"`{self.feature}`")
        return F.coalesce((v >= F.lit(self.lo)) & (v <= F.lit(self.hi)) & ~F.isnan(v), F.lit(False))


def _norm_terms(terms) -> list[str]:
    return sorted({str(t).lower() for t in terms})


@dataclass
class TextFilter:
    """FLT-3/4: some raw value, lower-cased, equals one of the terms (whole
    value).  Terms are always lower-cased, deduplicated and sorted (Q18).
    ``columns`` None reads the ``values`` map; otherwise the named raw
    string columns."""
    terms: list[str] = field(default_factory=list)
    mode: FilterMode = FilterMode.AND
    columns: list[str] | None = None

    def __post_init__(self):
        self.terms = _norm_terms(self.terms)

    @property
    def empty(self) -> bool:
        return len(self.terms) == 0

    def set(self, terms):
        self.terms = _norm_terms(terms)

    def extend(self, terms):
        self.terms = _norm_terms(list(self.terms) + list(terms))

    def add_term(self, text: str):
        """Search box: trimmed, appended if new."""
        t = text.strip()
        if t:
            self.extend([t])

    def remove(self, term: str):
        self.terms = [t for t in self.terms if t != term.lower()]

    def clear(self):
        self.terms = []

    def predicate(self) -> Column:
        if self.empty:
            return F.lit(False)
        lits = [F.lit(t) for t in self.terms]
        if self.columns is None:
            hit = F.exists(F.map_values(F.col("values")), lambda v: F.lower(v).isin(*lits))
            return F.coalesce(hit, F.lit(False))
        hits = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).isin(*lits), F.lit(False))
                for c in self.columns]
        return functools.reduce(lambda a, b: a | b, hits)


@dataclass
class IdFilter:
    """FLT-5/6: id in a set.  Selections default to OR mode (FLT-17).
    ``ids`` may be a Python collection (sorted, deduplicated) or a one-column
    DataFrame of ids of any size (applied by semi-join)."""
    ids: object = field(default_factory=list)
    mode: FilterMode = FilterMode.OR
    id_col: str = "ID"

    def __post_init__(self):
        if not isinstance(self.ids, DataFrame):
            self.ids = sorted({str(i) for i in self.ids})

    @property
    def is_frame(self) -> bool:
        return isinstance(self.ids, DataFrame)

    @property
    def empty(self) -> bool:
        if self.is_frame:
            return self.ids.isEmpty()
        return len(self.ids) == 0

    def add(self, i):
        self.ids = sorted(set(self.ids) | {str(i)})

    def remove(self, i):
        self.ids = [x for x in self.ids if x != str(i)]

    def toggle(self, i):
        s = set(self.ids)
        s ^= {str(i)}
        self.ids = sorted(s)

    def add_multiple(self, ids):
        self.ids = sorted(set(self.ids) | {str(i) for i in ids})

    def replace(self, ids):
        self.ids = sorted({str(i) for i in ids})

    def clear(self):
        self.ids = []

    def predicate(self, flag_col: str | None = None) -> Column:
        if self.is_frame:
            return F.coalesce(F.col(flag_col), F.lit(False))
        return F.col(f"`{self.id_col}`").cast("string").isin(*[F.lit(i) for i in self.ids])


def _prepare(df: DataFrame, filters: list) -> tuple[DataFrame, list[Column], list[Column]]:
    """Attach semi-join flags for DataFrame-backed id sets, split predicates
    by mode, skipping empty filters (FLT-8)."""
    ands, ors = [], []
    out = df
    for n, f in enumerate(filters):
        if f.empty:
            continue
        if isinstance(f, IdFilter) and f.is_frame:
            flag = f"_idset{n}"
            ids = f.ids.select(F.col(f.ids.columns[0]).cast("string").alias(f"_idk{n}")).distinct()
            ids = ids.withColumn(flag, F.lit(True))
            out = out.join(ids, F.col(f"`{f.id_col}`").cast("string") == F.col(f"_idk{n}"), "left").drop(f"_idk{n}")
            p = f.predicate(flag)
        else:
            p = f.predicate()
        (ors if f.mode == FilterMode.OR else ands).append(p)
    return out, ands, ors


def compose(ands: list[Column], ors: list[Column]) -> Column | None:
    """FLT-7: AND of the And filters, AND (OR of the Or filters if any);
    None when every filter is empty (everything passes)."""
    if not ands and not ors:
        return None
    a = functools.reduce(lambda x, y: x & y, ands) if ands else F.lit(True)
    o = functools.reduce(lambda x, y: x | y, ors) if ors else F.lit(True)
    return a & o


def mark_passive(items: DataFrame, filters: list) -> DataFrame:
    """FLT-9: add ``passive = not pass`` instead of dropping rows."""
    out, ands, ors = _prepare(items, filters)
    pred = compose(ands, ors)
    flag = F.lit(False) if pred is None else ~pred
    cols = [c for c in out.columns if not c.startswith("_idset")]
    return out.select(*[F.col(f"`{c}`") for c in cols], flag.alias("passive"))


def apply_filters(items: DataFrame, filters: list) -> DataFrame:
    """Surviving items only (``where`` of the composed predicate)."""
    out, ands, ors = _prepare(items, filters)
    pred = compose(ands, ors)
    res = out if pred is None else out.where(pred)
    return res.select(*[F.col(f"`{c}`") for c in items.columns])


def filter_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-8: total and surviving (non-passive) items per group, e.g. per
    (dataset, time) snapshot (Q13 fix)."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(~F.col("passive")).alias("surviving")]
    return items.groupBy(*(by or [])).agg(*aggs)


@dataclass
class FilterSet:
    """FLT-12: the list of active filters and its clear operations."""
    filters: list = field(default_factory=list)

    def add(self, f):
        if f not in self.filters:
            self.filters.append(f)
        return self

    def clear(self):
        """Removes *all* filters (Q12 fix)."""
        self.filters = []

    def clear_ids(self):
        for f in self.filters:
            if isinstance(f, IdFilter):
                f.clear()

    def remove_feature(self, feature: str):
        self.filters = [f for f in self.filters
                        if not (isinstance(f, FeatureFilter) and f.feature == feature)]


def brush_range(lo_rel: float, hi_rel: float, bins: int = 50) -> tuple[float, float]:
    """FLT-10: brushed pixel interval (relative to the chart width) -> the
    filter range snapped to bins: ``floor(rel*n)/n`` .. ``min((floor+1)/n, 1)``."""
    step = 1 / bins
    lo = math.floor(lo_rel / step) * step
    hi = (math.floor(hi_rel / step) + 1) * step
    return lo, min(hi, 1.0)


def brush_range_cols(lo_rel: Column, hi_rel: Column, bins: int = 50) -> tuple[Column, Column]:
    step = F.lit(1 / bins)
    lo = F.floor(lo_rel / step) * step
    hi = F.least((F.floor(hi_rel / step) + 1) * step, F.lit(1.0))
    return lo, hi


def brushed_bins(bin_col: Column, brush_min: Column, brush_max: Column) -> Column:
    """FLT-11: bin highlighted when ``brush_min <= bin + 1`` and
    ``bin <= brush_max`` (brush in bin units)."""
    return (brush_min <= bin_col + 1) & (bin_col <= brush_max)


def same_members(a: DataFrame, b: DataFrame, id_col: str = "ID") -> bool:
    """FLT-16: the two selections hold the same ids (set comparison by two
    anti joins; only a boolean reaches the driver)."""
    x = a.select(id_col).distinct()
    y = b.select(id_col).distinct()
    return x.join(y, id_col, "left_anti").isEmpty() and y.join(x, id_col, "left_anti").isEmpty()


# FLT-6 on DataFrame id sets (any size).
def idset_add(current: DataFrame, new: DataFrame) -> DataFrame:
    return current.unionByName(new).distinct()


def idset_remove(current: DataFrame, gone: DataFrame, id_col: str = "ID") -> DataFrame:
    return current.join(gone, id_col, "left_anti")


def idset_toggle(current: DataFrame, flip: DataFrame, id_col: str = "ID") -> DataFrame:
    """Symmetric difference: ids in exactly one of the two sets."""
    cur = current.select(id_col).distinct()
    fl = flip.select(id_col).distinct()
    return cur.join(fl, id_col, "left_anti").unionByName(fl.join(cur, id_col, "left_anti"))


def raw_prefilter(raw: DataFrame, flt: list, model) -> Column | None:
    """A predicate on the *raw* columns implied by the AND-mode range
    filters on numeric features, for ``where`` before encoding: it reaches
    the Parquet scan (``PushedFilters``, row-group skipping).  It is
    conservative -- widened for rounding, keeping null/NaN (encoded as 0)
    and values that the small-value threshold maps to 0 -- and the exact
    normalised predicate is still applied afterwards."""
    specs = {s.name: s for s in model.features}
    dtypes = dict(raw.dtypes)
    preds = []
    for f in flt:
        if not isinstance(f, FeatureFilter) or f.empty or f.mode != FilterMode.AND:
            continue
        spec = specs.get(f.feature)
        if spec is None or spec.kind != "number" or spec.hi == spec.lo:
            continue
        span = spec.hi - spec.lo
        eps = 1e-9 * (abs(spec.lo) + abs(spec.hi) + 1.0)
        c = F.col(f"`{f.feature}`")
        cond = c <= F.lit(spec.lo + max(f.hi, model.threshold) * span + eps)
        if f.lo > model.threshold:
            cond = cond & (c >= F.lit(spec.lo + f.lo * span - eps))
        # null and NaN are encoded as 0: keep them only if 0 itself passes
        z = (0.0 - spec.lo) / span
        z = 0.0 if abs(z) < model.threshold else z
        if not (f.lo <= z <= f.hi):
            preds.append(cond)              # NaN > everything in Spark: fails too
        elif dtypes.get(f.feature) in ("double", "float"):
            continue                        # IsNaN is not pushable: no prefilter
        else:
            preds.append(c.isNull() | cond)
    if not preds:
        return None
    return functools.reduce(lambda a, b: a & b, preds)


def apply_filters_pushed(raw: DataFrame, model, flt: list) -> DataFrame:
    """``apply_filters`` on encoded items, with the raw-range prefilter
    pushed below the encoding (and so into the scan)."""
    pre = raw_prefilter(raw, flt, model)
    enc = model.transform(raw if pre is None else raw.where(pre))
    return apply_filters(enc, flt)
