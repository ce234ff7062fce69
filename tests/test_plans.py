"""Plan shape checks: what Catalyst must produce for the operators to scale."""

import pytest

from vsframe.plans.supplied import QUERIES

SF = "/root/testdata/sf0.001"
GAP_QUERIES = {"event_gaps", "open_gaps", "longest_gaps_top20", "longest_gaps_per_entity"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    key = "spark.sql.maxMetadataStringLength"  # show full filter lists of scans
    old = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        return {name: plan(fn(spark, SF)) for name, fn in QUERIES.items()}
    finally:
        spark.conf.set(key, old)


def test_no_row_at_a_time_python(plans):
    for name, text in plans.items():
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        assert "MapInArrow" not in text and "MapInPandas" not in text, name


def test_top_n_uses_window_group_limit(plans):
    for name in ("period_top_n_named", "period_top_n_ties", "modal_values_ties"):
        assert "WindowGroupLimit" in plans[name] and "Partial" in plans[name], name


def test_named_mode_is_one_aggregate(plans):
    text = plans["modal_value_named"]
    assert "min_by" in text and "collect_set" not in text and "Window" not in text


def test_gap_queries_lag_within_buckets(plans):
    for name in GAP_QUERIES:
        text = plans[name]
        assert "rangepartitioning" not in text, name
        # lag windows are keyed by (entity, bucket), never by the entity alone
        assert "hashpartitioning(_vs_group" in text, name
        for line in text.splitlines():
            if "Window [lag(" in line:
                assert "[_vs_group" in line, line


def test_deficit_gaps_window_is_after_daily_aggregate(plans):
    text = plans["deficit_gaps_top20"]
    assert "MapInArrow" not in text and "Window [lag(" in text


def test_scans_are_pruned_and_pushed(plans):
    trade = plans["counterparty_balance"]
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in trade
    # the fact is one pass: each table scanned once
    for name in ("two_sided_long", "either_side_filter", "counterparty_balance", "deficit_gaps_top20"):
        assert plans[name].count("FileScan parquet") == 4, name
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate," in plans["from_period"]
    assert "GreaterThanOrEqual(ts,2024-01-05" in plans["event_gaps"]
    assert "EqualTo(event_type,error)" in plans["event_gaps"]
    # only the columns the gap query needs are read (no props)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plans["longest_gaps_top20"]


def test_long_form_scans_once(plans):
    # the two sides come from one scan through a generator, not a union of two scans
    text = plans["two_sided_long"]
    assert "Generate inline" in text and "Union" not in text
    assert text.count("FileScan parquet") == 4


def test_extremes_is_top_k(plans):
    assert plans["counterparty_extremes"].count("TakeOrderedAndProject") == 2


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_top_n_and_mode_share_the_customer_join(spark, no_broadcast):
    """Planned as at scale, orders and customers are each shuffled by customer
    once: the mode sums the counts that the ranking uses."""
    df = QUERIES["period_top_n_with_mode"](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "ReusedExchange" in final
    own = [line for line in final.splitlines() if "ReusedExchange" not in line]
    assert sum("hashpartitioning(o_custkey" in line for line in own) == 2


def test_one_lineitem_shuffle_at_default_filter_settings(spark, no_broadcast):
    """Without broadcasts, lineitem is scanned and shuffled by order key once."""
    for name in ("either_side_filter", "counterparty_extremes", "deficit_gaps_top20"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("l_quantity:double") == 1 or name == "counterparty_extremes", name
    final = QUERIES["counterparty_extremes"](spark, SF)
    final.collect()
    scans = [x for x in plan(final).split("== Initial Plan ==")[0].splitlines() if "l_quantity:double" in x]
    assert len(scans) == 1  # both extremes share one aggregate exchange


def test_three_key_join_plan(spark, no_broadcast):
    text = plan(QUERIES["three_key_join"](spark, SF))
    assert "SortMergeJoin [o_custkey" in text and "Inner" in text
    assert "isnotnull(" in text.lower()  # null key parts never travel


@pytest.fixture
def skew_sensitive(spark, no_broadcast):
    """AQE skew thresholds scaled down to test-sized data."""
    conf = {
        "spark.sql.shuffle.partitions": "16",  # enough partitions for a 5x-median outlier
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_supplier_is_split_by_aqe_but_distinct_semi_join_is_not(spark, skew_sensitive):
    from pyspark.sql import functions as F

    from vsframe.operators import member_set, restrict_to_members
    from vsframe.plans.trade import nation_trade
    from vsframe.sources import Tables

    # sf0.1: AQE splits a skewed partition along map-output boundaries, so the
    # stage before it needs several map tasks (thousands at scale)
    t = Tables(spark, "/root/testdata/sf0.1")
    # a third of all lines from one supplier (derived from the supplied table)
    t._cache["lineitem"] = t.lineitem.withColumn(
        "l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey"))
    )
    trade = nation_trade(t)
    trade.collect()
    final = plan(trade).split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final, [l.strip()[:120] for l in final.splitlines() if "Join" in l]

    # a third of all events from one user: a semi join against a distinct set
    # is not split by AQE (its member side is an aggregate) ...
    ev = t.events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    members = member_set(ev, ["user_id"], name="user_id", where=F.col("event_type") == "purchase")
    plain = restrict_to_members(ev.select("user_id", "event_id"), members, "user_id", rows_per_salt=None)
    plain.collect()
    assert "skew=true" not in plan(plain).split("== Initial Plan ==")[0]
    # ... which is what salting is for: the join then runs on (key, salt)
    salted = restrict_to_members(ev.select("user_id", "event_id"), members, "user_id", rows_per_salt=1000)
    salted.collect()
    import re

    assert "hashpartitioning(user_id, _vs_salt" in re.sub(r"#\d+L?", "", plan(salted))
    assert salted.count() == plain.count()
