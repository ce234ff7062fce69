"""Gaps between consecutive events of an entity, and the longest of them.

``event_gaps`` pairs every event with the entity's previous event (a ``lag``
in (time, tie-break) order) and measures the days between them.

Two physical strategies give the same rows:

* ``"window"``: ``lag`` over ``Window.partitionBy(entity)``. Each entity's
  events go to one task, so it is only right when no entity is large, for
  instance after aggregating to one row per entity and day.
* ``"bucket"`` (default): skew-safe. ``lag`` runs within (entity, time bucket),
  a day unless the caller chooses finer or coarser buckets, so a hot entity
  spreads over as many groups as it has buckets. Only the first event of a
  bucket lacks its predecessor, which is the last event of the entity's
  previous bucket: those last events come from a ``max_by`` aggregate with
  map-side partial steps, ``lead`` hands them to the entity's next bucket, and
  an equi-join on (entity, bucket) fills them in.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_GROUP = "_vs_group"
_HEAD = "_vs_head"
_LAST = "_vs_last"
_COPIES = "_vs_copies"
_STRATEGIES = ("bucket", "window")


def _lag_by_bucket(
    src: DataFrame,
    entity: str,
    keys: Sequence[str],
    lagged: Sequence[str],
    out_names: Sequence[str],
    bucket: Column | None,
) -> DataFrame:
    # One struct key: equal structs may hold nulls, so null entities and times
    # join without null-safe equality, and the join reuses the window's shuffle.
    at = F.to_date(keys[1]) if bucket is None else bucket
    grouped = src.withColumn(_GROUP, F.struct(F.col(entity).alias("entity"), at.alias("at")))
    within = Window.partitionBy(_GROUP).orderBy(*[F.col(k).asc_nulls_first() for k in keys[1:]])
    rows = grouped.select(
        "*",
        *[F.lag(c).over(within).alias(o) for c, o in zip(lagged, out_names)],
        (F.row_number().over(within) == 1).alias(_HEAD),
    )
    last = grouped.groupBy(_GROUP).agg(
        F.max_by(F.struct(*lagged), F.struct(*keys[1:])).alias(_LAST)
    )
    # An entity has one row a bucket here, whatever its events.
    buckets = Window.partitionBy(F.struct(F.col(_GROUP)["entity"])).orderBy(F.col(_GROUP)["at"].asc_nulls_first())
    handoff = last.select(F.lead(_GROUP).over(buckets).alias(_GROUP), _LAST).where(F.col(_GROUP).isNotNull())
    joined = rows.join(handoff, on=_GROUP, how="left")
    patch = F.col(_HEAD) & F.col(_LAST).isNotNull()
    prev = [F.when(patch, F.col(_LAST)[c]).otherwise(F.col(o)).alias(o) for c, o in zip(lagged, out_names)]
    return joined.select(*[F.col(c) for c in src.columns], *prev)


def _lag_by_window(
    src: DataFrame, entity: str, keys: Sequence[str], lagged: Sequence[str], out_names: Sequence[str]
) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*[F.col(k).asc_nulls_first() for k in keys[1:]])
    return src.select(*src.columns, *[F.lag(c).over(w).alias(o) for c, o in zip(lagged, out_names)])


def event_gaps(
    events: DataFrame,
    entity: str,
    time: str,
    *,
    order: Sequence[str] = (),
    carry: Iterable[str] = (),
    event: Column | None = None,
    since: Column | None = None,
    prev_prefix: str = "prev_",
    gap_col: str = "gap_days",
    closed_only: bool = True,
    open_end: str | None = None,
    strategy: str = "bucket",
    bucket: Column | None = None,
    collapse_copies: bool = False,
) -> DataFrame:
    """Each event with the previous event of the same entity and the days between.

    ``time`` is a date or timestamp column; events are ordered by ``time`` then
    the ``order`` tie-break columns, which must make the order total for the
    result to be deterministic. ``event`` selects which rows are events and
    ``since`` is a row predicate applied first (a date floor: a gap straddling
    it is not seen). For ``time`` and each ``carry`` column the previous
    event's value is returned as ``<prev_prefix><column>``. ``gap_col`` is the
    calendar-day difference of the two dates. With ``closed_only`` (default),
    only events that have a previous event are returned, so the run before the
    first event and the run still open after the last are not gaps.
    ``open_end`` (an ISO date) adds, per entity, the run still open after its
    last event: a row dated ``open_end`` (other columns null) whose previous
    event is the entity's last one, if that is not later. The last events come
    from a ``max_by`` aggregate with map-side partial steps, so a hot entity is
    reduced before it is shuffled.

    ``bucket`` (strategy ``"bucket"``) must not decrease with ``time``; it
    defaults to the day. Choose one in which an entity has few enough events
    for one task.

    ``collapse_copies`` is for inputs where one row may be repeated very many
    times: identical copies share entity and bucket, so they reach one task.
    They are first counted by an aggregate whose map-side partial step
    leaves at most one row per copy group per task, the distinct rows are
    lagged, and the copies are restored exactly (each extra copy follows the
    previous identical one, zero days later). It costs one extra shuffle of
    the distinct rows, so it is off by default.

    Output columns: entity, time, order..., carry..., prev_time, prev_carry...,
    gap_col.
    """
    if strategy not in _STRATEGIES:
        raise ValueError(f"strategy must be one of {_STRATEGIES}")
    keys = [entity, time, *order]
    carry = [c for c in dict.fromkeys(carry) if c not in (entity, time)]
    lagged = [time, *carry]
    out_names = [f"{prev_prefix}{c}" for c in lagged]
    src = events
    if since is not None:
        src = src.where(since)
    if event is not None:
        src = src.where(event)
    src = src.select(*dict.fromkeys([*keys, *carry]))
    base = src.groupBy(*src.columns).agg(F.count(F.lit(1)).alias(_COPIES)) if collapse_copies else src
    if strategy == "bucket":
        lagged_df = _lag_by_bucket(base, entity, keys, lagged, out_names, bucket)
    else:
        lagged_df = _lag_by_window(base, entity, keys, lagged, out_names)
    if collapse_copies:
        # copy 1 keeps the computed predecessor; copies 2..k follow their twin
        extra = lagged_df.where(F.col(_COPIES) > 1).select(
            *src.columns,
            *[F.col(c).alias(o) for c, o in zip(lagged, out_names)],
            F.explode(F.sequence(F.lit(2).cast("bigint"), F.col(_COPIES))).alias("_vs_copy"),
        )
        lagged_df = lagged_df.drop(_COPIES).unionByName(extra.drop("_vs_copy"))
    prev_time = f"{prev_prefix}{time}"
    if closed_only:
        lagged_df = lagged_df.where(F.col(prev_time).isNotNull())
    if open_end is not None:
        lagged_df = lagged_df.unionByName(_open_runs(src, entity, keys, lagged, out_names, open_end))
    return lagged_df.withColumn(gap_col, F.datediff(F.to_date(time), F.to_date(prev_time)))


def _open_runs(src, entity, keys, lagged, out_names, open_end) -> DataFrame:
    time = keys[1]
    end = F.lit(str(open_end)).cast(src.schema[time].dataType)
    tails = src.groupBy(entity).agg(
        F.max_by(F.struct(*[F.col(c) for c in lagged]), F.struct(*[F.col(k) for k in keys[1:]])).alias("_vs_tail")
    )
    others = [c for c in src.columns if c not in (entity, time)]
    return tails.where(F.col("_vs_tail").getField(time) <= end).select(
        entity,
        end.alias(time),
        *[F.lit(None).cast(src.schema[c].dataType).alias(c) for c in others],
        *[F.col("_vs_tail").getField(c).alias(o) for c, o in zip(lagged, out_names)],
    )


def longest_gaps(
    gaps: DataFrame,
    *,
    n: int | None = 20,
    gap_col: str = "gap_days",
    order: Sequence[str] = (),
    entity: str | None = None,
    per_entity: bool = False,
) -> DataFrame:
    """The ``n`` longest gaps in the total order (gap desc, ``order`` asc).

    ``order`` must break every tie so the cut at ``n`` is deterministic. The
    top ``n`` is a distributed top-k: each task keeps its own ``n`` best rows.
    With ``per_entity`` each entity first keeps only its own longest gap (same
    tie order), computed as a ``min_by`` aggregate with map-side partial
    steps, so an entity with very many gaps is reduced before any shuffle;
    ``n=None`` then returns one row per entity.
    """
    src = gaps
    if per_entity:
        if entity is None:
            raise ValueError("per_entity needs entity")
        cols = [c for c in gaps.columns if c != entity]
        rank_key = F.struct((-F.col(gap_col)).alias("g"), *[F.col(c) for c in order])
        src = gaps.groupBy(entity).agg(F.min_by(F.struct(*cols), rank_key).alias("_vs_best")).select(
            entity, *[F.col("_vs_best").getField(c).alias(c) for c in cols]
        )
        src = src.select(*gaps.columns)
    if n is None:
        return src
    return src.orderBy(F.col(gap_col).desc(), *[F.col(c).asc() for c in order]).limit(n)
