"""Group counts, repeats within a group, top N per group and the modal value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TIES = ("named", "dense")
_MODE_TIES = ("named", "all")
_PAIR = "_vs_pair"


def count_per_group(
    df: DataFrame, keys: Iterable[str | Column], count_col: str = "n", *, weight: str | None = None
) -> DataFrame:
    """Row count per key combination (a null key is a group of its own).

    With ``weight`` the rows are already partial counts and are summed, which
    lets a caller count before a join and finish after it.
    """
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(total.alias(count_col))


def repeated_in_group(
    df: DataFrame,
    keys: Iterable[str | Column],
    *,
    min_count: int = 3,
    count_col: str = "n",
    fact_filter: Column | None = None,
) -> DataFrame:
    """Key combinations occurring at least ``min_count`` times (GROUP BY ... HAVING).

    ``fact_filter`` restricts which rows count (for instance excluding own
    goals); by default every row counts. Partial counts are taken before the
    shuffle, so a hot key costs one row per map task.
    """
    src = df if fact_filter is None else df.where(fact_filter)
    return count_per_group(src, keys, count_col).where(F.col(count_col) >= F.lit(min_count))


def _rank_window(group, measure: str, name: str | None) -> Window:
    order = [F.col(measure).desc()]
    if name is not None:
        order.append(F.col(name).asc())
    return Window.partitionBy(*group).orderBy(*order)


def top_n_per_group(
    df: DataFrame,
    group: Iterable[str],
    measure: str,
    name: str,
    *,
    n: int = 2,
    ties: str = "named",
    rank_col: str = "rank",
) -> DataFrame:
    """Rows ranked within ``n`` per ``group`` by ``measure`` descending.

    ``ties="named"`` ranks by (measure desc, name asc) with ``dense_rank``:
    equal measures are ordered by name, so normally ``n`` rows per group; rows
    sharing both measure and name share a rank. ``ties="dense"`` ranks by the
    measure only and keeps every row of the top ``n`` distinct measures.

    The rank filter sits directly on the window, so Spark plans a
    WindowGroupLimit: each map task keeps only its own top ranks before the
    shuffle on ``group``, which bounds what a large group sends to one task.
    Spark does so for ``n`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    (1000 by default); raise it for a larger ``n``.

    With ``ties="dense"`` the ranks are those of the distinct (group, measure)
    pairs, joined back on the pair, so rows that tie never meet in a window:
    at most ``n`` pairs a group are joined, a size Spark checks before it
    broadcasts them.
    """
    if ties not in _TIES:
        raise ValueError(f"ties must be one of {_TIES}")
    group = list(group)
    if ties == "named":
        w = _rank_window(group, measure, name)
        return df.withColumn(rank_col, F.dense_rank().over(w)).where(F.col(rank_col) <= F.lit(n))
    # a struct key: equal structs may hold nulls, as groups may
    pair = F.struct(*[F.col(c) for c in [*group, measure]])
    ranked = (
        df.select(*group, measure)
        .distinct()
        .withColumn(rank_col, F.dense_rank().over(_rank_window(group, measure, None)))
        .where(F.col(rank_col) <= F.lit(n))
        .select(pair.alias(_PAIR), rank_col)
    )
    return df.withColumn(_PAIR, pair).join(ranked, on=_PAIR).select(*df.columns, rank_col)


def mode_per_group(
    df: DataFrame,
    group: Iterable[str],
    value: str,
    *,
    ties: str = "named",
    sep: str = "/",
    out_col: str | None = None,
    count_col: str = "n",
    weight: str | None = None,
) -> DataFrame:
    """The most frequent ``value`` per group, as text, with its count.

    ``ties="named"`` takes the first tied value by name (nulls sort first, and
    a null winner gives an empty string): one ``min_by`` aggregate over the
    counts. ``ties="all"`` joins every tied non-null value, sorted, with
    ``sep``; the rank-1 filter becomes a WindowGroupLimit, but the tied values
    of a group are its output, one text, and grow with their number. ``weight``
    names a column of partial counts to sum instead of counting rows. Counting
    is a partial + final aggregate.
    """
    if ties not in _MODE_TIES:
        raise ValueError(f"ties must be one of {_MODE_TIES}")
    group = list(group)
    out_col = out_col or value
    counts = count_per_group(df, [*group, value], count_col, weight=weight)
    if ties == "named":
        first = F.min_by(F.col(value), F.struct(-F.col(count_col), F.col(value)))
        return counts.groupBy(*group).agg(
            F.coalesce(first.cast("string"), F.lit("")).alias(out_col), F.max(count_col).alias(count_col)
        )
    w = _rank_window(group, count_col, None)
    winners = counts.withColumn("_mode_rank", F.dense_rank().over(w)).where(F.col("_mode_rank") == 1)
    tied = F.transform(F.array_sort(F.collect_set(value)), lambda v: v.cast("string"))
    return winners.groupBy(*group).agg(
        F.array_join(tied, sep).alias(out_col),
        F.max(count_col).alias(count_col),
    )
