"""Text <-> number Column functions with pandas semantics (FE-7, Q5, Q7).

All functions return ``Column`` expressions: they stay inside whole-stage
codegen, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What pandas ``to_numeric`` accepts as a number (decimal
# notation with optional exponent, plus the inf/nan words), surrounding
# blanks allowed.  Java-style suffixes such as ``5d`` or ``1f`` are rejected
# although Spark's cast would accept them.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL_PATTERN = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"

# pandas' default missing-value tokens for ``read_csv``.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# pandas' default boolean spellings for ``read_csv``.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN) | c.rlike(SPECIAL_PATTERN)


def to_number(c: Column) -> Column:
    """FE-7: parse like ``pd.to_numeric(errors='coerce')``; null if not a
    number.  Non-string inputs are cast directly."""
    s = c.cast("string")
    return F.when(is_number_text(s), F.trim(s).try_cast("double"))


def to_number_or_zero(c: Column) -> Column:
    """``to_numeric(..).fillna(0)``: unparseable, missing and NaN -> 0."""
    v = to_number(c)
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def py_float_str(c: Column) -> Column:
    """Python ``str(float)`` of a double column (Q5).

    Plain notation for 1e-4 <= |x| < 1e16 (via a decimal cast of Java's
    shortest digits), ``1e-05`` / ``1.5e+16`` style outside, ``nan``/``inf``
    words, ``nan`` for null (pandas prints a missing float as ``nan``).
    """
    x = c.cast("double")
    a = F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    java = x.cast("string")
    mant = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exp = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return (F.when(x.isNull() | F.isnan(x), F.lit("nan"))
             .when(x == float("inf"), F.lit("inf"))
             .when(x == float("-inf"), F.lit("-inf"))
             .when(x == 0, F.when(java.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
             .when((a >= 1e-4) & (a < 1e16), plain)
             .otherwise(sci))


def py_str(c: Column, dtype: str) -> Column:
    """``astype(str)`` of one column given its Spark type name (Q5):
    missing -> ``nan``; bools ``True``/``False``; floats as Python prints."""
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return py_float_str(c)
    if dtype == "boolean":
        return F.when(c.isNull(), F.lit("nan")).when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.coalesce(c.cast("string"), F.lit("nan"))
