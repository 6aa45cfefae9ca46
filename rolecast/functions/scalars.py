"""Scalar column expressions and plan-time checks."""

from __future__ import annotations

import datetime as dt
import re
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LARGEST = sys.float_info.max
_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}\z"
# Fixed value: all characters with the Unicode property White_Space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


# -- checks -----------------------------------------------------------------

def require_columns(df: DataFrame, required: Sequence[str], context: str = "") -> DataFrame:
    """The frame, once its schema is known to offer each required field.

    Checked on the analysed schema while the plan is built, so no job starts. All absent
    fields are named in one ``KeyError``, next to those that are there.
    """
    offered = {field.name for field in df.schema}
    if absent := [name for name in dict.fromkeys(required) if name not in offered]:
        raise KeyError(f"{context or 'input'} needs {', '.join(sorted(absent))}; it has {', '.join(sorted(offered))}")
    return df


def require_nonempty(df: DataFrame, context: str = "") -> DataFrame:
    """Raise ``ValueError`` on an empty frame. Runs one short job; opt-in."""
    if df.isEmpty():
        raise ValueError(f"{context or 'input'} has no rows")
    return df


# -- numbers ----------------------------------------------------------------

def number(x: Column) -> Column:
    """Double, or NULL when the value is missing or not a finite number."""
    d = x.try_cast("double")
    return F.when(F.abs(d) <= _LARGEST, d)  # NaN sorts above every number


def safe_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(number(x), F.lit(float(default)))


def whole(x: Column) -> Column:
    """Integer part of a numeric value, NULL when it is not a finite number."""
    return x.try_cast("double").try_cast("bigint")


def clip(x: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lower)), F.lit(upper))


def stable_round(x: Column, digits: int) -> Column:
    """Round half up after dropping binary noise beyond ten decimals.

    The same inputs give the same result whatever the order in which a
    distributed sum was added up.
    """
    return F.round(x.cast("decimal(24,10)"), digits).cast("double")


def minmax_normalise(df: DataFrame, column: str, out: str, eps: float = 1e-10) -> DataFrame:
    """Scale a column to [0, 1]; zeros when its range is below ``eps``.

    The bounds come from a scalar subquery, so there is neither a window over
    the whole table nor a join.
    """
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, span = bounds.getField("lo"), bounds.getField("hi") - bounds.getField("lo")
    return df.withColumn(out, F.when(span < eps, 0.0).otherwise((x - lo) / span))


# -- booleans and optional values -------------------------------------------

# The words that count as true.
TRUE_WORDS = ("true", "1", "yes")


def truth(x: Column) -> Column:
    """Boolean view of a text; NULL stays NULL."""
    return F.lower(strip(x)).isin(*TRUE_WORDS)


def coerce_bool(df: DataFrame, column: str) -> Column:
    """Boolean view of a boolean, numeric or text column; NULL stays NULL."""
    kind = dict(df.dtypes)[column]
    x = F.col(column)
    if kind == "boolean":
        return x
    if kind == "string":
        return truth(x)
    return x.cast("double") != 0


def safe_value(df: DataFrame, column: str) -> Column | None:
    """The column with NaN as NULL, or ``None`` when it does not exist."""
    if column not in df.columns:
        return None
    x = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.when(~F.isnan(x), x)
    return x


def safe_numeric(df: DataFrame, column: str) -> Column | None:
    """The column as a finite double, or ``None`` when it does not exist."""
    return number(F.col(column)) if column in df.columns else None


# -- text -------------------------------------------------------------------

def strip(x: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(x, F.lit(_SPACES))


def text_or(x: Column, default: str) -> Column:
    return F.coalesce(x, F.lit(default))


def blank(x: Column) -> Column:
    return strip(text_or(x, "")) == ""


def contains_any(x: Column, words: Iterable[str]) -> Column:
    """Case-insensitive: does the text contain one of the words?"""
    literal = "|".join(re.escape(w) for w in words)
    return F.lower(text_or(x, "")).rlike(literal) if literal else F.lit(False)


# -- dates ------------------------------------------------------------------

def parse_date(x: Column) -> Column:
    """``YYYY-M-D`` text to a date; NULL for anything else."""
    return F.when(x.rlike(_ISO_DATE), x).try_cast("date")  # much cheaper than a parser with a pattern


def months_between_30(start: Column, end: Column) -> Column:
    """Months from start to end, a day counting as one thirtieth (a fixed value)."""
    return (
        (F.year(end) - F.year(start)) * 12
        + (F.month(end) - F.month(start))
        + (F.dayofmonth(end) - F.dayofmonth(start)) / F.lit(30.0)
    )


def days_inactive(last_active: Column, reference: dt.date, missing: int = 999) -> Column:
    return F.coalesce(F.datediff(F.lit(reference), last_active), F.lit(missing))


def whole_text(x: Column) -> Column:
    """A number as text without decimals, ties going to the even neighbour."""
    return F.bround(x, 0).cast("bigint").cast("string")
