"""Net balance of one subject against each counterparty, and its extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.functions.scalar import as_column


def net_by_counterparty(
    df: DataFrame,
    subject,
    side_a: str | Column,
    side_b: str | Column,
    score_a: str | Column,
    score_b: str | Column,
    *,
    counterparty: str = "counterparty",
    measure: str = "net",
) -> DataFrame:
    """Sum of (own score - other score) for ``subject`` per counterparty.

    A row counts when the subject is on side a (counterparty = side b, sign +)
    or on side b (counterparty = side a, sign -). Rows with a null score add
    nothing; a counterparty with only null scores gets a null total. The sum is
    one hash aggregate with a map-side partial step, so a counterparty holding
    a large share of rows is combined before the shuffle.
    """
    a, b = as_column(side_a), as_column(side_b)
    sa, sb = as_column(score_a), as_column(score_b)
    on_a = a == F.lit(subject)
    rows = df.where(on_a | (b == F.lit(subject)))
    return rows.groupBy(F.when(on_a, b).otherwise(a).alias(counterparty)).agg(
        F.sum(F.when(on_a, sa - sb).otherwise(sb - sa)).alias(measure)
    )


def extremes(
    df: DataFrame,
    name: str,
    measure: str,
    *,
    labels: tuple[str, str] = ("best", "worst"),
    label_col: str = "kind",
) -> DataFrame:
    """Two labelled rows: the largest and the smallest ``measure``.

    Ties go to the smallest ``name``; null measures are ignored; a single
    candidate is both best and worst; no candidate gives no rows. Each side is
    a distributed top-1 (TakeOrderedAndProject): every partition keeps its own
    best row, so the final merge sees one row per partition.
    """
    valid = df.where(F.col(measure).isNotNull()).select(name, measure)
    best = valid.orderBy(F.col(measure).desc(), F.col(name).asc_nulls_last()).limit(1)
    worst = valid.orderBy(F.col(measure).asc(), F.col(name).asc_nulls_last()).limit(1)
    return best.withColumn(label_col, F.lit(labels[0])).unionByName(
        worst.withColumn(label_col, F.lit(labels[1]))
    )
