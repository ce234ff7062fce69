"""Scalar expressions shared by the loaders and operators.

Spark 4 runs with ANSI mode on: a plain ``cast("int")`` or ``to_date`` raises
on text such as ``NA``. The lenient helpers use ``try_cast`` / ``try_to_date``
so malformed values become null, which is what the reference's data relied on
under the older non-ANSI default.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Free-text tokens read as boolean true (compared lower-cased).
TRUE_TOKENS = ("true", "t", "yes", "1")


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: str | Column, tokens: Iterable[str] = TRUE_TOKENS) -> Column:
    """True when the lower-cased text is one of ``tokens``; false otherwise, null included."""
    return F.coalesce(F.lower(as_column(c).cast("string")).isin(*[t.lower() for t in tokens]), F.lit(False))


def in_aliases(c: str | Column, aliases: Iterable[str]) -> Column:
    """Case-insensitive exact membership: qualifiers such as "... qualification" do not match."""
    return F.lower(as_column(c)).isin(*[a.lower() for a in aliases])


def pair_label(a: str | Column, b: str | Column, sep: str = ":") -> Column:
    """``a<sep>b`` as text; a null side is skipped (``concat_ws`` semantics)."""
    return F.concat_ws(sep, as_column(a).cast("string"), as_column(b).cast("string"))


_LENIENT_TYPES = {
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
}


# Whole numbers in text: an optional sign, digits, and a fraction that is cut off.
_WHOLE = r"^\s*([+-]?[0-9]*)(?:\.[0-9]*)?\s*$"


def _lenient_whole(col: Column, data_type: T.DataType) -> Column:
    """Text as Spark casts it to a whole number with ANSI mode off: blanks
    around it are ignored, a fraction is cut off (``-0.5`` and ``.5`` give 0),
    and text, exponents and overflow give null. Plain digits, the common case,
    take one cast; only what that rejects meets the patterns."""
    digits = F.regexp_extract(col, _WHOLE, 1)
    # a bare point, or a sign and a point, is 0; a bare sign or nothing is null
    digits = F.when(col.contains(".") & digits.isin("", "+", "-"), F.lit("0")).otherwise(digits)
    return F.coalesce(col.try_cast(data_type), F.when(col.rlike(_WHOLE), digits.try_cast(data_type)))


def lenient(c: str | Column, type_name: str) -> Column:
    """Cast text to ``type_name``; malformed input gives null instead of an error."""
    col = as_column(c)
    if type_name == "date":
        return F.try_to_date(col)
    if type_name == "timestamp":
        return F.try_to_timestamp(col)
    if type_name == "timestamp_ntz":
        return col.try_cast(T.TimestampNTZType())
    if type_name not in _LENIENT_TYPES:
        raise ValueError(f"unsupported lenient type {type_name!r}")
    data_type = _LENIENT_TYPES[type_name]
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        return _lenient_whole(col.cast("string"), data_type)
    return col.try_cast(data_type)


def period_predicate(
    c: str | Column,
    data_type: T.DataType,
    from_year: int | None = None,
    from_date: str | dt.date | None = None,
) -> Column:
    """Inclusive lower bound on a date or timestamp column.

    ``year(c) >= y`` is rewritten as ``c >= y-01-01`` in the column's own type,
    so the bound stays a plain comparison that reaches the Parquet scan as a
    pushed filter (a function of the column would not).
    """
    col = as_column(c)
    bounds = []
    if from_year is not None:
        bounds.append(dt.date(int(from_year), 1, 1))
    if from_date is not None:
        bounds.append(from_date if isinstance(from_date, dt.date) else dt.date.fromisoformat(str(from_date)))
    if not bounds:
        return F.lit(True)
    start = max(bounds).isoformat()
    # literals are cast from text: constant-folded, and free of the Python
    # process's local time zone
    if isinstance(data_type, T.DateType):
        lit = F.lit(start).cast("date")
    elif isinstance(data_type, T.TimestampNTZType):
        lit = F.lit(start).cast("timestamp_ntz")
    elif isinstance(data_type, T.TimestampType):
        lit = F.lit(start).cast("timestamp")
    else:
        # text dates: compare after a lenient parse (not pushable, but correct)
        return F.try_to_date(col) >= F.lit(start).cast("date")
    return col >= lit
