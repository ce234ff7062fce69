"""Unit tests per operator, on tiny in-line DataFrames (one case per trap)."""

import datetime as dt
import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vsframe import (
    alias_filter,
    apply_types,
    count_per_group,
    either_side,
    extremes,
    from_period,
    member_set,
    mode_per_group,
    net_by_counterparty,
    pair_label,
    repeated_in_group,
    restrict_to_members,
    top_n_per_group,
    truthy,
    two_sided_to_long,
)

MATCH = "a string, b string, sa int, sb int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_truthy_tokens_and_null(spark):
    df = spark.createDataFrame([(v,) for v in ["TRUE", "t", "Yes", "1", "FALSE", "other", "", None]], "v string")
    assert [r[0] for r in df.select(truthy("v")).collect()] == [True] * 4 + [False] * 4
    assert [r[0] for r in df.select(truthy("v", ["other"])).collect()] == [False] * 5 + [True, False, False]


def test_pair_label_skips_null(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (3, None), (None, None)], "x int, y int")
    assert [r[0] for r in df.select(pair_label("x", "y")).collect()] == ["1:2", "2", "3", ""]


def test_alias_filter_exact_case_insensitive(spark):
    df = spark.createDataFrame([("UEFA Euro",), ("uefa euro",), ("UEFA Euro qualification",), (None,)], "t string")
    assert rows(alias_filter(df, "t", ["uefa euro"])) == [("UEFA Euro",), ("uefa euro",)]


def test_from_period_inclusive_and_pushed(spark, tmp_path):
    df = spark.createDataFrame(
        [(dt.date(1989, 12, 31),), (dt.date(1990, 1, 1),), (None,), (dt.date(1991, 5, 1),)], "d date"
    )
    assert rows(from_period(df, "d", from_year=1990)) == [(dt.date(1990, 1, 1),), (dt.date(1991, 5, 1),)]
    assert rows(from_period(df, "d", from_year=1990, from_date="1991-01-01")) == [(dt.date(1991, 5, 1),)]
    path = str(tmp_path / "p")
    df.write.parquet(path)
    plan = from_period(spark.read.parquet(path), "d", from_year=1990)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d," in plan


def test_either_side(spark):
    df = spark.createDataFrame([("S", "X", 1, 0), ("Y", "S", 1, 0), ("Y", "Z", 1, 0)], MATCH)
    assert len(either_side(df, "a", "b", "S").collect()) == 2


def test_net_by_counterparty_signs_and_nulls(spark):
    df = spark.createDataFrame(
        [("S", "X", 3, 1), ("X", "S", 0, 1), ("S", "Y", None, 1), ("S", "Z", None, None), ("Q", "R", 5, 0)], MATCH
    )
    got = rows(net_by_counterparty(df, "S", "a", "b", "sa", "sb"))
    # X: +2 (home) +1 (away win) ; Y: null score adds nothing, total null ; Z: null
    assert got == [("X", 3), ("Y", None), ("Z", None)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("PQRS"), st.sampled_from("PQRS"), st.integers(0, 5), st.integers(0, 5)), max_size=25))
def test_balances_are_antisymmetric(spark, matches):
    """P's balance against Q is minus Q's balance against P."""
    df = spark.createDataFrame([m for m in matches if m[0] != m[1]] or [("P", "Q", 0, 0)], MATCH)
    p = dict(rows(net_by_counterparty(df, "P", "a", "b", "sa", "sb")))
    for other, value in p.items():
        back = dict(rows(net_by_counterparty(df, other, "a", "b", "sa", "sb")))
        assert back["P"] == -value


def test_extremes_ties_single_empty(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", -1), ("d", None)], "n string, m bigint")
    assert [tuple(r) for r in extremes(df, "n", "m").collect()] == [("a", 5, "best"), ("c", -1, "worst")]
    one = spark.createDataFrame([("x", 2)], "n string, m bigint")
    assert [tuple(r) for r in extremes(one, "n", "m").collect()] == [("x", 2, "best"), ("x", 2, "worst")]
    empty = spark.createDataFrame([], "n string, m bigint")
    out = extremes(empty, "n", "m")
    assert out.collect() == [] and out.dtypes == [("n", "string"), ("m", "bigint"), ("kind", "string")]


def test_two_sided_to_long_shape(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "H", "A", 2, 1)], "d date, h string, w string, hs int, ws int")
    long = two_sided_to_long(
        df, ["d"], {"team": "h", "opp": "w", "gf": "hs", "ga": "ws"}, {"team": "w", "opp": "h", "gf": "ws", "ga": "hs"},
        side_col="side", labels=("home", "away"),
    )
    assert long.columns == ["d", "team", "opp", "gf", "ga", "side"]
    assert rows(long) == [
        (dt.date(2020, 1, 1), "A", "H", 1, 2, "away"),
        (dt.date(2020, 1, 1), "H", "A", 2, 1, "home"),
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("PQRS"), st.sampled_from("PQRS"), st.integers(0, 5), st.integers(0, 5)), max_size=20))
def test_long_form_equals_union_form(spark, matches):
    df = spark.createDataFrame(matches or [("P", "Q", 0, 0)], MATCH)
    long = two_sided_to_long(df, [], {"t": "a", "o": "b", "f": "sa", "g": "sb"}, {"t": "b", "o": "a", "f": "sb", "g": "sa"})
    union = df.select(F.col("a").alias("t"), F.col("b").alias("o"), F.col("sa").alias("f"), F.col("sb").alias("g")).unionByName(
        df.select(F.col("b").alias("t"), F.col("a").alias("o"), F.col("sb").alias("f"), F.col("sa").alias("g"))
    )
    assert long.count() == 2 * df.count()
    assert rows(long) == rows(union)


def test_member_set_and_restrict(spark):
    games = spark.createDataFrame(
        [("A", "B", "WC"), ("C", None, "WC"), ("D", "E", "wc"), ("A", "C", "WC")], "h string, w string, t string"
    )
    members = member_set(games, ["h", "w"], name="team", where=F.col("t") == "WC")
    assert rows(members) == [("A",), ("B",), ("C",), (None,)]
    facts = spark.createDataFrame([("A", 1), ("D", 2), (None, 3), ("A", 4)], "team string, v int")
    # Null keys never match; duplicate facts stay (semi join keeps left multiplicity)
    assert rows(restrict_to_members(facts, members, "team")) == [("A", 1), ("A", 4)]


def test_repeated_in_group_threshold_and_filter(spark):
    df = spark.createDataFrame(
        [("m", "x", False), ("m", "x", False), ("m", "x", True), ("m", "y", False), ("m", None, False),
         ("m", None, False), ("m", None, False)],
        "g string, who string, own boolean",
    )
    # A null key is a group of its own in a GROUP BY
    assert rows(repeated_in_group(df, ["g", "who"], min_count=3)) == [("m", "x", 3), ("m", None, 3)]
    assert rows(repeated_in_group(df, ["g", "who"], min_count=3, fact_filter=~F.col("own"))) == [("m", None, 3)]


def test_count_per_group_weight(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "k string, w bigint")
    assert rows(count_per_group(df, ["k"], "n", weight="w")) == [("a", 5), ("b", 1)]
    assert rows(count_per_group(df, ["k"])) == [("a", 2), ("b", 1)]


def test_top_n_named_vs_dense(spark):
    df = spark.createDataFrame(
        [(1, "c", 5), (1, "a", 5), (1, "b", 5), (1, "d", 1), (2, "x", 1)], "y int, name string, goals bigint"
    )
    named = rows(top_n_per_group(df, ["y"], "goals", "name", n=2))
    assert named == [(1, "a", 5, 1), (1, "b", 5, 2), (2, "x", 1, 1)]
    dense = rows(top_n_per_group(df, ["y"], "goals", "name", n=2, ties="dense"))
    assert dense == [(1, "a", 5, 1), (1, "b", 5, 1), (1, "c", 5, 1), (1, "d", 1, 2), (2, "x", 1, 1)]


def test_mode_per_group_ties_and_null(spark):
    df = spark.createDataFrame(
        [(1, "B"), (1, "A"), (1, "B"), (1, "A"), (2, None), (2, None), (2, "Z"), (3, "Q")], "y int, c string"
    )
    assert rows(mode_per_group(df, ["y"], "c")) == [(1, "A", 2), (2, "", 2), (3, "Q", 1)]
    assert rows(mode_per_group(df, ["y"], "c", ties="all")) == [(1, "A/B", 2), (2, "", 2), (3, "Q", 1)]
    nums = spark.createDataFrame([(1, 10), (1, 9)], "y int, v int")
    assert rows(mode_per_group(nums, ["y"], "v", ties="all")) == [(1, "9/10", 1)]


def test_apply_types_lenient_and_idempotent(spark):
    df = spark.createDataFrame(
        [("2020-01-02", "5", "yes", "x"), ("NA", "NA", None, "y"), ("2020-02-30", "1.5", "no", "z")],
        "d string, n string, f string, other string",
    )
    typed = apply_types(df, {"d": "date", "n": "int"}, ["f"])
    assert typed.dtypes == [("d", "date"), ("n", "int"), ("f", "boolean"), ("other", "string")]
    assert [tuple(r) for r in typed.collect()] == [
        (dt.date(2020, 1, 2), 5, True, "x"), (None, None, False, "y"), (None, 1, False, "z"),
    ]
    # typing an already-typed column is a no-op (the reference re-applies to_date)
    assert [tuple(r) for r in apply_types(typed, {"d": "date"}).collect()] == [tuple(r) for r in typed.collect()]


def test_empty_inputs_give_empty_results(spark):
    from vsframe import event_gaps, longest_gaps

    ev = spark.createDataFrame([], "entity string, day date, seq int, val bigint")
    for strategy in ("bucket", "window"):
        gaps = event_gaps(ev, "entity", "day", order=["seq"], carry=["val"], strategy=strategy)
        assert gaps.collect() == []
        assert gaps.columns == ["entity", "day", "seq", "val", "prev_day", "prev_val", "gap_days"]
        assert longest_gaps(gaps, n=5, order=["entity"]).collect() == []
        assert longest_gaps(gaps, n=None, per_entity=True, entity="entity").collect() == []
    counts = spark.createDataFrame([], "y int, name string, goals bigint")
    assert top_n_per_group(counts, ["y"], "goals", "name").collect() == []
    assert mode_per_group(counts, ["y"], "name").collect() == []
    assert member_set(counts, ["name"]).collect() == []
    matches = spark.createDataFrame([], MATCH)
    assert net_by_counterparty(matches, "S", "a", "b", "sa", "sb").collect() == []
    assert repeated_in_group(matches, ["a"]).collect() == []


def test_lenient_whole_numbers(spark):
    """What Spark casts them to with ANSI mode off."""
    from vsframe import lenient

    want = {
        "45.0": 45, "3.7": 3, "-0.5": 0, "-3.9": -3, "+4.2": 4, ".5": 0, "5.": 5, ".": 0, "-.": 0, "-": None, "+": None,
        "1e3": None, "": None, " 7 ": 7, "\t8.2\n": 8, "2147483647.9": 2147483647, "1.2.3": None, "1.a": None,
        "NA": None, "00012": 12, "1 2": None, "3,5": None, "\u0661": None,
    }
    df = spark.createDataFrame([(k,) for k in want] + [("2147483648",), ("9223372036854775808",), (None,)], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select("s", lenient("s", "int"), lenient("s", "bigint")).collect()}
    assert {k: got[k] for k in want} == {k: (v, v) for k, v in want.items()}
    assert got["2147483648"] == (None, 2147483648) and got["9223372036854775808"] == (None, None)
    assert got[None] == (None, None)


def test_lenient_timestamps(spark):
    from vsframe import lenient

    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("nope",)], "s string")
    out = df.select(lenient("s", "timestamp_ntz").alias("ntz"), lenient("s", "timestamp").alias("ltz"))
    assert out.dtypes == [("ntz", "timestamp_ntz"), ("ltz", "timestamp")]
    rows_ = out.collect()
    assert rows_[0]["ntz"] == dt.datetime(2024, 1, 2, 3, 4, 5) and rows_[1]["ntz"] is None and rows_[1]["ltz"] is None


def test_restrict_with_hot_key_salting_is_exact_and_spreads(spark):
    import random

    rnd = random.Random(7)
    keys = ["hot"] * 600 + [rnd.choice(["a", "b", "c", "d", None]) for _ in range(300)]
    facts = spark.createDataFrame([(k, i % 5) for i, k in enumerate(keys)] + [("hot", 1)] * 50, "team string, v int")
    members = spark.createDataFrame([("hot",), ("a",), ("c",), (None,), ("a",)], "team string")
    plain = rows(restrict_to_members(facts, members, "team", rows_per_salt=None))
    salted_df = restrict_to_members(facts, members, "team", rows_per_salt=80)
    assert rows(salted_df) == plain and salted_df.columns == facts.columns
    # the hot key's rows are spread over the salts, not held by one task
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        per_task = salted_df.where("team = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(coalesce, old)
    assert max(r["count"] for r in per_task) < 650 / 2


def test_every_hot_key_is_salted(spark):
    """More hot keys than any fixed number of them would take."""
    facts = spark.range(20_000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    members = spark.range(0, 200, 2).select(F.col("id").alias("k"))
    got = restrict_to_members(facts, members, "k", rows_per_salt=50)
    assert got.count() == 10_000 and got.where("k % 2 = 1").count() == 0
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        tasks = got.groupBy("k", F.spark_partition_id().alias("p")).count()
        spread = tasks.groupBy("k").count()
        assert spread.count() == 50 and spread.agg(F.min("count")).first()[0] > 1
    finally:
        spark.conf.set(coalesce, old)


@settings(max_examples=int(os.environ.get("VSFRAME_EXAMPLES", "8")), deadline=None,
          suppress_health_check=list(HealthCheck))
@given(
    facts=st.lists(st.tuples(st.sampled_from(["h", "a", "b", None]), st.integers(0, 3)), max_size=60),
    members=st.lists(st.sampled_from(["h", "a", "z", None]), max_size=6),
    per_salt=st.integers(1, 20),
)
def test_salted_restrict_equals_plain(spark, facts, members, per_salt):
    f = spark.createDataFrame(facts, "k string, v int")
    m = spark.createDataFrame([(x,) for x in members], "k string")
    plain = rows(restrict_to_members(f, m, "k", rows_per_salt=None))
    assert rows(restrict_to_members(f, m, "k", rows_per_salt=per_salt)) == plain


def test_less_used_branches(spark):
    import pytest

    from vsframe import event_gaps, longest_gaps, period_predicate
    from pyspark.sql import types as T

    # truthy tokens per column
    df = spark.createDataFrame([("Y", "on"), ("n", "off")], "a string, b string")
    typed = apply_types(df, truthy_columns={"a": ["y"], "b": ["on"]})
    assert [tuple(r) for r in typed.collect()] == [(True, True), (False, False)]
    # period bound on text dates (parsed leniently) and on timestamps with a zone
    text = spark.createDataFrame([("1990-01-01",), ("1989-12-31",), ("junk",)], "d string")
    assert [r[0] for r in from_period(text, "d", from_year=1990).collect()] == ["1990-01-01"]
    ts = spark.createDataFrame([(dt.datetime(1990, 1, 1, 0, 0),), (dt.datetime(1989, 12, 31, 23, 0),)], "t timestamp")
    pred = period_predicate("t", T.TimestampType(), from_year=1990)
    assert ts.where(pred).count() == 1
    assert spark.range(1).where(period_predicate("id", T.LongType())).count() == 1  # no bound: keep all
    # argument checks
    with pytest.raises(ValueError):
        two_sided_to_long(df, [], {"x": "a"}, {"y": "b"})
    with pytest.raises(ValueError):
        top_n_per_group(df, ["a"], "b", "a", ties="other")
    with pytest.raises(ValueError):
        mode_per_group(df, ["a"], "b", ties="other")
    with pytest.raises(ValueError):
        event_gaps(df, "a", "b", strategy="other")
    with pytest.raises(ValueError):
        longest_gaps(df, per_entity=True)
    with pytest.raises(ValueError):
        apply_types(df, {"missing": "int"})
    from vsframe import lenient
    from vsframe.sources import Tables

    with pytest.raises(ValueError):
        lenient("a", "interval")
    with pytest.raises(AttributeError):
        Tables(spark, "/root/testdata/sf0.001")._missing
