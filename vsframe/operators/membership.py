"""Member sets and restriction of facts to members."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_set(
    df: DataFrame,
    columns: Iterable[str],
    *,
    name: str = "member",
    where: Column | None = None,
) -> DataFrame:
    """Distinct values found in any of ``columns`` (of rows matching ``where``).

    One scan: the columns are unpivoted with ``explode`` rather than unioned
    projections; the distinct is a partial + final aggregate. A null value is
    kept as a member, as a union-distinct would (it never joins anything).
    """
    src = df if where is None else df.where(where)
    cols = [F.col(c) for c in columns]
    value = cols[0] if len(cols) == 1 else F.explode(F.array(*cols))
    return src.select(value.alias(name)).distinct()


_SALTS = "_vs_salts"
_SALT = "_vs_salt"


def restrict_to_members(
    df: DataFrame,
    members: DataFrame,
    key: str,
    *,
    member_key: str | None = None,
    rows_per_salt: int | None = 2_000_000,
) -> DataFrame:
    """Rows of ``df`` whose ``key`` is a member: a left-semi join.

    Same rows as an inner join to a distinct set, without widening the row.
    Null keys never match. No broadcast hint on the member set: it can grow
    with the data, so Spark checks its size (planner estimate, then AQE with
    the measured size) and broadcasts it only under the threshold; beyond
    that the join sort-merges.

    A sort-merge join sends every row of one key to one task, and AQE cannot
    split it when the member side comes out of an aggregate (a distinct set):
    its skew rule needs a bare shuffle on both sides. So every key with more
    than ``rows_per_salt`` rows, however many such keys there are, is salted.
    They are found by a count per key (map-side partial); fewer than
    ``rows / rows_per_salt`` keys can have so many rows. Neither join to them
    has a hint: Spark broadcasts them if their measured size allows. A hot key with r rows gets ``ceil(r / rows_per_salt)`` salts;
    each of its rows takes a salt from a hash of its partition id and values
    (deterministic under retries), its member row is repeated once per salt,
    and the semi join runs on (key, salt). Every other key is untouched. The
    salt hashes every column of ``df``, so project ``df`` to the columns needed
    downstream first; the key count reads only ``key``.

    ``rows_per_salt=None`` leaves the count and the salts out: for a ``df`` that
    has few rows a key by construction, such as counts per key.
    """
    right = members.select(F.col(member_key or key).alias(key))
    if rows_per_salt is None:
        return df.join(right, on=key, how="left_semi")

    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_vs_rows"))
        .where(F.col("_vs_rows") > F.lit(rows_per_salt))
        .select(key, F.ceil(F.col("_vs_rows") / F.lit(rows_per_salt)).cast("int").alias(_SALTS))
    )
    row_hash = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns])
    left = (
        df.join(hot, on=key, how="left")
        .withColumn(_SALT, F.coalesce(F.pmod(row_hash, F.col(_SALTS)), F.lit(0)).cast("int"))
        .drop(_SALTS)
    )
    spread = F.when(F.col(_SALTS).isNotNull(), F.sequence(F.lit(0), F.col(_SALTS) - 1)).otherwise(F.array(F.lit(0)))
    right = right.join(hot, on=key, how="left").select(key, F.explode(spread).alias(_SALT))
    return left.join(right, on=[key, _SALT], how="left_semi").drop(_SALT).select(*df.columns)
