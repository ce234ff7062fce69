"""event_gaps / longest_gaps: the skew-safe bucket strategy against the window one."""

import datetime as dt
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vsframe.operators import event_gaps, longest_gaps

SCHEMA = "entity string, day date, seq int, val bigint, kind string"


def _gaps(df, strategy, bucket=None, open_end=None):
    return event_gaps(
        df, "entity", "day", order=["seq"], carry=["val", "seq"], event=F.col("kind") == "loss",
        strategy=strategy, bucket=bucket, open_end=open_end,
    )


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


BUCKETS = {
    "day": lambda: None,
    "week": lambda: F.date_trunc("week", "day"),
    "month": lambda: F.trunc("day", "month"),
    "one": lambda: F.lit(1),
}


def _events(seed, n, hot_share):
    rnd = random.Random(seed)
    names = ["hot", "a", "b", "c", None]
    out = []
    for i in range(n):
        ent = "hot" if rnd.random() < hot_share else rnd.choice(names)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(0, 60)) if rnd.random() > 0.05 else None
        out.append((ent, day, i, rnd.choice([None, rnd.randrange(-5, 5)]), rnd.choice(["loss", "loss", "win"])))
    return out


# VSFRAME_EXAMPLES raises the number of random cases for a deeper run.
@settings(max_examples=int(os.environ.get("VSFRAME_EXAMPLES", "12")), deadline=None,
          suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), n=st.integers(0, 80), hot=st.floats(0.0, 0.9), bucket=st.sampled_from(sorted(BUCKETS)))
def test_bucket_equals_window(spark, seed, n, hot, bucket):
    df = spark.createDataFrame(_events(seed, n, hot), SCHEMA)
    assert _sorted(_gaps(df, "bucket", BUCKETS[bucket]())) == _sorted(_gaps(df, "window"))
    end = "2020-02-15"
    assert _sorted(_gaps(df, "bucket", BUCKETS[bucket](), end)) == _sorted(_gaps(df, "window", None, end))


def test_output_columns_and_open_runs(spark):
    df = spark.createDataFrame(
        [("x", dt.date(2020, 1, 1), 1, 10, "loss"), ("x", dt.date(2020, 1, 5), 2, 20, "win"),
         ("x", dt.date(2020, 1, 9), 3, 30, "loss"), ("y", dt.date(2020, 2, 1), 1, 5, "loss")],
        SCHEMA,
    )
    got = _gaps(df, "bucket")
    assert got.columns == ["entity", "day", "seq", "val", "prev_day", "prev_val", "prev_seq", "gap_days"]
    assert [tuple(r) for r in got.collect()] == [("x", dt.date(2020, 1, 9), 3, 30, dt.date(2020, 1, 1), 10, 1, 8)]
    open_runs = event_gaps(df, "entity", "day", order=["seq"], event=F.col("kind") == "loss", closed_only=False)
    assert open_runs.count() == 3 and open_runs.where("gap_days is null").count() == 2


def test_since_applies_before_lag(spark):
    # A gap straddling the floor is not seen
    df = spark.createDataFrame(
        [("x", dt.date(2019, 12, 1), 1, 0, "loss"), ("x", dt.date(2020, 1, 5), 2, 0, "loss"),
         ("x", dt.date(2020, 1, 9), 3, 0, "loss")],
        SCHEMA,
    )
    got = event_gaps(df, "entity", "day", order=["seq"], since=F.col("day") >= F.lit("2020-01-01").cast("date"))
    assert [r["gap_days"] for r in got.collect()] == [4]


def test_timestamp_time_measures_calendar_days(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 23, 0), 1), (1, dt.datetime(2024, 1, 2, 1, 0), 2), (1, dt.datetime(2024, 1, 2, 2, 0), 3)],
        "u bigint, ts timestamp_ntz, id bigint",
    )
    got = event_gaps(df, "u", "ts", order=["id"]).orderBy("id")
    assert [r["gap_days"] for r in got.collect()] == [1, 0]


def test_longest_total_order_and_per_entity(spark):
    df = spark.createDataFrame(
        [("b", 5, 1), ("a", 5, 2), ("a", 5, 1), ("c", 3, 1), ("b", 9, 7), ("c", 3, 0)],
        "entity string, gap_days int, id int",
    )
    # Ties at the cut resolved by (entity, id)
    top = longest_gaps(df, n=3, order=["entity", "id"])
    assert [tuple(r) for r in top.collect()] == [("b", 9, 7), ("a", 5, 1), ("a", 5, 2)]
    per = longest_gaps(df, n=None, per_entity=True, entity="entity", order=["id"])
    assert sorted(tuple(r) for r in per.collect()) == [("a", 5, 1), ("b", 9, 7), ("c", 3, 0)]
    assert per.columns == df.columns


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), n=st.integers(1, 60))
def test_gaps_telescope_to_span(spark, seed, n):
    """Per entity, the closed gaps sum to last event date minus first event date."""
    df = spark.createDataFrame(_events(seed, n, 0.5), SCHEMA).where("day is not null and kind = 'loss'")
    gaps = _gaps(df, "bucket")
    total = {r[0]: r[1] for r in gaps.groupBy("entity").agg(F.sum("gap_days")).collect()}
    span = {
        r["entity"]: r["span"]
        for r in df.groupBy("entity").agg(
            F.datediff(F.max("day"), F.min("day")).alias("span"), F.count("*").alias("k")
        ).where("k > 1").collect()
    }
    assert total == span


@pytest.fixture(params=["true", "false"])
def exchange_reuse(spark, request):
    """Many partitions, with shared exchanges and without."""
    conf = {"spark.sql.exchange.reuse": request.param, "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("copies", [False, True])
def test_many_events_equal_the_window(spark, exchange_reuse, copies):
    """400,000 events of 5 users, a third of them one user's."""
    n = 400_000
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id") % 4)).alias("entity"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=(F.xxhash64("id") % 2_000_000).cast("decimal(18,6)")))
        .cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("seq"),
    )
    df = df.unionAll(df.where("seq = 0 AND entity = 'hot'").limit(50))

    def bag(strategy):
        got = event_gaps(df, "entity", "ts", order=["seq"], strategy=strategy, collapse_copies=copies,
                         bucket=F.date_trunc("hour", "ts") if strategy == "bucket" else None)
        return got.agg(F.count("*"), F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first()

    got, want = bag("bucket"), bag("window")
    assert got == want and got[0] == n + 50 - 5


def test_hot_third_is_spread_over_tasks(spark):
    """One user with a third of all events: no group that a lag task gets is large."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("entity"),
        (F.lit(dt.date(2020, 1, 1)) + (F.col("id") % 700).cast("int")).alias("day"),
        F.col("id").cast("int").alias("seq"),
        F.col("id").alias("val"),
        F.lit("loss").alias("kind"),
    )
    assert df.groupBy("entity", "day").count().agg(F.max("count")).first()[0] < 50
    got = _gaps(df, "bucket")
    assert got.count() == n - 501
    assert got.exceptAll(_gaps(df, "window")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "rangepartitioning" not in plan


@settings(max_examples=int(os.environ.get("VSFRAME_EXAMPLES", "6")), deadline=None,
          suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), n=st.integers(0, 50), copies=st.integers(1, 40))
def test_collapse_copies_is_exact(spark, seed, n, copies):
    rows = _events(seed, n, 0.3)
    hot = ("hot", dt.date(2020, 1, 10), 7, 1, "loss")
    df = spark.createDataFrame(rows + [hot] * copies, SCHEMA)
    want = _sorted(_gaps(df, "window"))
    for strategy in ("bucket", "window"):
        got = event_gaps(
            df, "entity", "day", order=["seq"], carry=["val", "seq"], event=F.col("kind") == "loss",
            strategy=strategy, collapse_copies=True,
        )
        assert _sorted(got) == want


def test_collapse_copies_counts_before_the_shuffle(spark):
    df = spark.createDataFrame([("hot", dt.date(2020, 1, 1), 1, 1, "loss")] * 500, SCHEMA)
    got = event_gaps(df, "entity", "day", order=["seq"], collapse_copies=True)
    assert got.count() == 499 and got.where("gap_days != 0").count() == 0
    assert "partial_count" in got._jdf.queryExecution().executedPlan().toString()
