"""Two-sided rows to long form."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.functions.scalar import as_column


def two_sided_to_long(
    df: DataFrame,
    keep: Iterable[str],
    side_a: Mapping[str, str | Column],
    side_b: Mapping[str, str | Column],
    *,
    side_col: str | None = None,
    labels: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Each input row becomes two rows: the side-a view and the side-b view.

    ``side_a`` / ``side_b`` map output column -> input column (or expression)
    and must name the same outputs. One scan feeds both views (an ``inline``
    of a two-element array), instead of two scans and a union; filters on
    ``keep`` columns are still pushed below the generator.
    """
    if list(side_a) != list(side_b):
        raise ValueError("side_a and side_b must map the same output names in the same order")
    def view(mapping, label):
        fields = [as_column(src).alias(out) for out, src in mapping.items()]
        if side_col:
            fields.append(F.lit(label).alias(side_col))
        return F.struct(*fields)
    return df.select(*keep, F.inline(F.array(view(side_a, labels[0]), view(side_b, labels[1]))))
