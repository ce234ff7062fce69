"""Row filters: alias membership, period floors, either-side subject."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.functions.scalar import as_column, in_aliases, period_predicate


def alias_filter(df: DataFrame, column: str, aliases: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` equals one of ``aliases`` ignoring case (exact, no prefixes)."""
    return df.where(in_aliases(column, aliases))


def from_period(
    df: DataFrame,
    column: str,
    *,
    from_year: int | None = None,
    from_date: str | dt.date | None = None,
) -> DataFrame:
    """Rows dated on or after Jan 1 of ``from_year`` and/or ``from_date`` (inclusive).

    Null dates drop. The bound is a typed literal on the raw column, so it is
    pushed into the Parquet scan.
    """
    return df.where(period_predicate(column, df.schema[column].dataType, from_year, from_date))


def either_side(df: DataFrame, side_a: str | Column, side_b: str | Column, subject) -> DataFrame:
    """Two-sided rows with ``subject`` on side a or side b (an OR of equalities)."""
    return df.where((as_column(side_a) == F.lit(subject)) | (as_column(side_b) == F.lit(subject)))
