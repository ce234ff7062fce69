"""Driver queries on the supplied tables (oracle SQL in ``supplied_sql``).

Every query is a composition of the public operators, reads the supplied
tables in full and returns a lazy DataFrame. Column names and types match the
oracle SQL exactly (counts bigint, years and ranks int, day gaps int).

Analogues of the reference's football questions:

* two-sided fact: trade between nations (``plans.trade``), the subject
  nation playing the part of the subject team;
* event history: ``events``, error events standing in for losses and early
  purchasers for the member set;
* top scorers per tournament year: customers by order count per order year;
* host country per tournament: the busiest customer nation per order year.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vsframe.functions.scalar import pair_label, period_predicate, truthy
from vsframe.operators import (
    alias_filter,
    count_per_group,
    either_side,
    event_gaps,
    extremes,
    from_period,
    longest_gaps,
    member_set,
    mode_per_group,
    net_by_counterparty,
    repeated_in_group,
    restrict_to_members,
    top_n_per_group,
    two_sided_to_long,
)
from vsframe.plans.trade import nation_trade
from vsframe.session import shared_dir
from vsframe.sources import Tables, apply_types, read_typed_csv, write_csv

# Fixed parameters of the driver queries.
SUBJECT_NATION = 3
MEMBER_STATUS = "F"
MEMBER_BEFORE = "1995-01-05"
PRIORITY_ALIASES = ("1-urgent", "2-high")
FULFILLED_TOKENS = ("f",)
FROM_YEAR = 1997
FROM_DATE = "1997-03-15"
TOP_FROM_YEAR = 1996
TOP_N = 2
TOP_LABEL = "orders since 1996"
PURCHASE_BEFORE = "2024-01-03"
GAPS_SINCE = "2024-01-05"
DEFICIT_SINCE = "1996-01-01"
LONGEST_N = 20
# Texts whose whole-number reading has a rule of its own.
ODD_NUMBERS = ("45.0", "3.7", "-0.5", ".5", "5.", ".", "-", "1e3", "", "  ", "2147483647.9", "2147483648", "1.2.3")
# Rows of one user that one task of a membership join takes.
ROWS_PER_SALT = 2_000_000
OPEN_END = "2024-02-10"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# -- two-sided fact: balance against each counterparty ------------------------

def either_side_filter(spark: SparkSession, d: str) -> DataFrame:
    trade = nation_trade(Tables(spark, d))
    return (
        either_side(trade, "seller_nation", "buyer_nation", SUBJECT_NATION)
        .groupBy("seller_nation", "buyer_nation")
        .agg(F.sum("n_lines").alias("n_lines"), F.sum("quantity").alias("quantity"))
    )


def _balance(t: Tables) -> DataFrame:
    return net_by_counterparty(
        nation_trade(t),
        SUBJECT_NATION,
        "seller_nation",
        "buyer_nation",
        F.col("quantity"),
        F.lit(0).cast("bigint"),
        counterparty="counterparty",
        measure="net_quantity",
    )


def counterparty_balance(spark: SparkSession, d: str) -> DataFrame:
    return _balance(Tables(spark, d))


def counterparty_extremes(spark: SparkSession, d: str) -> DataFrame:
    return extremes(_balance(Tables(spark, d)), "counterparty", "net_quantity", labels=("best", "worst"))


def _long_trade(trade: DataFrame, keep=()) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return two_sided_to_long(
        trade,
        keep,
        {"nation": "seller_nation", "counterparty": "buyer_nation", "sold": "quantity", "bought": zero, "lines": "n_lines"},
        {"nation": "buyer_nation", "counterparty": "seller_nation", "sold": zero, "bought": "quantity", "lines": "n_lines"},
    )


def two_sided_long(spark: SparkSession, d: str) -> DataFrame:
    return (
        _long_trade(nation_trade(Tables(spark, d)))
        .groupBy("nation")
        .agg(F.sum("sold").alias("sold"), F.sum("bought").alias("bought"), F.sum("lines").alias("n_lines"))
    )


# -- membership ---------------------------------------------------------------

def _early_final() -> Column:
    return (F.col("o_orderstatus") == F.lit(MEMBER_STATUS)) & (F.col("o_orderdate") < _ts(MEMBER_BEFORE))


def _member_nations(t: Tables) -> DataFrame:
    return member_set(nation_trade(t, order_where=_early_final()), ["seller_nation", "buyer_nation"], name="nation")


def member_nations(spark: SparkSession, d: str) -> DataFrame:
    return _member_nations(Tables(spark, d))


def _early_purchasers(t: Tables) -> DataFrame:
    ev = t.events
    return member_set(
        ev,
        ["user_id"],
        name="user_id",
        where=(F.col("event_type") == F.lit("purchase")) & (F.col("ts") < _ts(PURCHASE_BEFORE)),
    )


def restrict_members(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    errors = t.events.where(F.col("event_type") == F.lit("error")).select("user_id")
    # the count commutes with the semi join: one row a user is left to join
    counts = count_per_group(errors, ["user_id"], "n_errors")
    return restrict_to_members(counts, _early_purchasers(t), "user_id", rows_per_salt=None)


# -- repeats within a group ---------------------------------------------------

def _repeats(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), on="l_partkey"
    )
    return repeated_in_group(lines, ["l_orderkey", "p_brand"], min_count=3, count_col="n_lines")


def repeat_in_group(spark: SparkSession, d: str) -> DataFrame:
    return _repeats(Tables(spark, d))


def repeat_in_group_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Repeats among the lines that were not returned."""
    t = Tables(spark, d)
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), on="l_partkey"
    )
    return repeated_in_group(
        lines,
        ["l_orderkey", "p_brand"],
        min_count=2,
        count_col="n_lines",
        fact_filter=F.col("l_returnflag") != F.lit("R"),
    )


def three_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Counts per (customer, year, priority) joined to each such order.

    Priority 5-LOW is made null: null key parts group together but never join.
    The order side repeats keys, which multiplies the counts' rows.
    """
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    orders = Tables(spark, d).orders.select(
        "o_custkey", F.year("o_orderdate").alias("order_year"), priority.alias("priority"), "o_orderkey", "o_orderstatus"
    )
    keys = ["o_custkey", "order_year", "priority"]
    facts = count_per_group(orders.where(F.col("o_orderstatus") != F.lit("P")), keys, "n_orders")
    return facts.join(orders, on=keys, how="inner")


def repeat_in_group_enriched(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    urgent = alias_filter(t.orders, "o_orderpriority", PRIORITY_ALIASES).select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.to_date("o_orderdate").alias("order_date"),
        "o_orderstatus",
        "o_orderpriority",
    )
    return _repeats(t).join(urgent, on="l_orderkey").orderBy("order_date", "l_orderkey", "p_brand")


def alias_filter_count(spark: SparkSession, d: str) -> DataFrame:
    orders = alias_filter(Tables(spark, d).orders, "o_orderpriority", PRIORITY_ALIASES)
    return count_per_group(orders, ["o_orderpriority"], "n_orders")


def truthy_flag(spark: SparkSession, d: str) -> DataFrame:
    orders = Tables(spark, d).orders
    return count_per_group(
        orders.select(truthy("o_orderstatus", FULFILLED_TOKENS).alias("is_fulfilled")), ["is_fulfilled"], "n_orders"
    )


def from_period_count(spark: SparkSession, d: str) -> DataFrame:
    orders = Tables(spark, d).orders
    since_year = from_period(orders, "o_orderdate", from_year=FROM_YEAR)
    since_date = period_predicate("o_orderdate", orders.schema["o_orderdate"].dataType, from_date=FROM_DATE)
    return since_year.groupBy(F.year("o_orderdate").alias("order_year")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count(F.when(since_date, F.lit(1))).alias("n_from_date"),
    )


def pair_label_query(spark: SparkSession, d: str) -> DataFrame:
    lines = Tables(spark, d).lineitem.select(
        "l_orderkey", "l_returnflag", F.col("l_quantity").cast("int").alias("qty")
    )
    returned = F.col("l_returnflag") == F.lit("R")
    per_order = lines.groupBy("l_orderkey").agg(
        F.sum(F.when(~returned, F.col("qty"))).alias("kept"),
        F.sum(F.when(returned, F.col("qty"))).alias("returned"),
    )
    return per_order.select("l_orderkey", pair_label("kept", "returned").alias("label"))


# -- top N and mode per period ------------------------------------------------

def _orders_by_year(t: Tables) -> DataFrame:
    """(o_custkey, order_year) of the orders since the period floor.

    Joined to customers before counting: orders per (customer, year) are too
    few for a count ahead of the join to shrink the data, and it would add a
    second shuffle by customer key. A customer with very many orders is still
    safe: both join sides are plain shuffles, so AQE splits its partition, and
    the count that follows combines map-side. The year is stated non-null
    (already implied by the floor), so the filter that a join on ``order_year``
    infers adds nothing and both halves of ``period_top_n_with_mode`` share one
    plan up to these counts.
    """
    orders = from_period(t.orders, "o_orderdate", from_year=TOP_FROM_YEAR)
    year = F.year("o_orderdate")
    return orders.where(year.isNotNull()).select("o_custkey", year.alias("order_year"))


def _customer_counts(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    joined = _orders_by_year(t).join(customers, on="o_custkey")
    return count_per_group(joined, ["order_year", "c_name", "c_nationkey"], "n_orders")


def period_top_n_named(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(
        _customer_counts(Tables(spark, d)), ["order_year"], "n_orders", "c_name", n=TOP_N, ties="named", rank_col="rnk"
    )


def period_top_n_ties(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(
        _customer_counts(Tables(spark, d)), ["order_year"], "n_orders", "c_name", n=TOP_N, ties="dense", rank_col="rnk"
    )


def _modal(named: DataFrame, ties: str, out_col: str, weight: str | None = None) -> DataFrame:
    return mode_per_group(
        named, ["order_year"], "n_name", ties=ties, out_col=out_col, count_col="n_orders", weight=weight
    )


def _orders_by_nation(t: Tables) -> DataFrame:
    """One (order_year, n_name) row an order; its count by these combines
    map-side to a few dozen rows a year and task, so that is the only shuffle
    after the join."""
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = t.nation.select("n_nationkey", "n_name")
    return _orders_by_year(t).join(customers, on="o_custkey").join(nations, on="n_nationkey").select("order_year", "n_name")


def modal_value_named(spark: SparkSession, d: str) -> DataFrame:
    return _modal(_orders_by_nation(Tables(spark, d)), "named", "modal_nation")


def modal_values_ties(spark: SparkSession, d: str) -> DataFrame:
    return _modal(_orders_by_nation(Tables(spark, d)), "all", "modal_nations")


def period_top_n_with_mode(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    counts = _customer_counts(t)  # one plan for both halves: its exchange is reused
    top = top_n_per_group(counts, ["order_year"], "n_orders", "c_name", n=TOP_N, ties="named", rank_col="rnk")
    # null-safe, though no nation has a null key: an equality would put a null
    # filter into this half's scan of customers and keep the halves apart
    nations = t.nation.select("n_nationkey", "n_name").where("n_nationkey IS NOT NULL")
    named = counts.join(nations, F.col("c_nationkey").eqNullSafe(F.col("n_nationkey")))
    mode = _modal(named, "named", "modal_nation", weight="n_orders").select("order_year", "modal_nation")
    return (
        top.withColumn("label", F.lit(TOP_LABEL))
        .join(mode, on="order_year", how="left")
        .select("c_name", "c_nationkey", "n_orders", "rnk", "order_year", "label", "modal_nation")
        .orderBy("order_year", F.col("n_orders").desc(), "c_name")
    )


# -- gaps between events ------------------------------------------------------

def _error_gaps(t: Tables, members: DataFrame | None = None, open_end: str | None = None) -> DataFrame:
    events = t.events
    # filter first, so the membership join and its hot-key count see only the
    # error events since the floor (both pushed into the scan)
    errors = events.where(
        (F.col("event_type") == F.lit("error"))
        & period_predicate("ts", events.schema["ts"].dataType, from_date=GAPS_SINCE)
    ).select("user_id", "ts", "event_id", "value")
    if members is not None:
        errors = restrict_to_members(errors, members, "user_id", rows_per_salt=ROWS_PER_SALT)
    gaps = event_gaps(
        errors,
        "user_id",
        "ts",
        order=["event_id"],
        carry=["event_id", "value"],
        bucket=F.date_trunc("hour", "ts"),
        open_end=open_end,
    )
    return gaps.select(
        "user_id",
        "event_id",
        F.to_date("ts").alias("event_date"),
        "value",
        F.to_date("prev_ts").alias("prev_event_date"),
        "prev_event_id",
        "prev_value",
        "gap_days",
    )


def event_gaps_query(spark: SparkSession, d: str) -> DataFrame:
    return _error_gaps(Tables(spark, d))


def open_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Closed gaps, and each user's run still open at an as-of date."""
    return _error_gaps(Tables(spark, d), open_end=OPEN_END)


def longest_gaps_top20(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return longest_gaps(
        _error_gaps(t, _early_purchasers(t)), n=LONGEST_N, order=["user_id", "event_date", "event_id"]
    )


def longest_gaps_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return longest_gaps(
        _error_gaps(Tables(spark, d)), n=None, per_entity=True, entity="user_id", order=["event_date", "event_id"]
    )


def deficit_gaps_top20(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    early, recent = _early_final(), F.col("o_orderdate") >= _ts(DEFICIT_SINCE)
    trade = nation_trade(
        t,
        order_cols=[F.to_date("o_orderdate").alias("order_date"), early.alias("early"), recent.alias("recent")],
        order_where=early | recent,
    )
    # one pass over the trade gives both the daily sums and the members
    daily = (
        _long_trade(trade, keep=["order_date", "early", "recent"])
        .groupBy("nation", "order_date", "recent")
        .agg(F.sum("sold").alias("sold"), F.sum("bought").alias("bought"), F.max("early").alias("early"))
        .withColumn("member", F.max("early").over(Window.partitionBy("nation")))
        .where(F.col("member") & F.col("recent"))
    )
    # One row per (nation, day) here, so a nation's window is bounded by the
    # number of days, not by data volume: the plain window strategy is safe.
    gaps = event_gaps(
        daily,
        "nation",
        "order_date",
        carry=["bought"],
        event=F.col("bought") > F.col("sold"),
        strategy="window",
    )
    out = gaps.select(
        "nation",
        F.col("order_date").alias("deficit_date"),
        "bought",
        F.col("prev_order_date").alias("prev_deficit_date"),
        "prev_bought",
        "gap_days",
    )
    return longest_gaps(out, n=LONGEST_N, order=["nation", "deficit_date"])


# -- loading ------------------------------------------------------------------

def _order_text(t: Tables) -> DataFrame:
    """Order columns as text, some deliberately malformed."""
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        F.when(prio == F.lit("5-LOW"), F.lit("NA"))
        .when((status == F.lit("P")) & (prio == F.lit("4-NOT SPECIFIED")), F.lit("1999-13-45"))
        .otherwise(F.to_date("o_orderdate").cast("string"))
        .alias("order_date"),
        F.when(prio == F.lit("3-MEDIUM"), F.concat(F.lit("#"), F.col("o_custkey").cast("string")))
        .when(prio == F.lit("2-HIGH"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .when(prio == F.lit("1-URGENT"), F.concat(F.lit(" -"), F.col("o_custkey").cast("string"), F.lit(".7 ")))
        .when(status == F.lit("P"), F.element_at(F.array(*map(F.lit, ODD_NUMBERS)), F.expr(f"CAST(o_orderkey % {len(ODD_NUMBERS)} AS INT) + 1")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("custkey"),
        F.when(status == F.lit("F"), F.lit("TRUE")).when(status == F.lit("O"), F.lit("yes")).alias("fulfilled"),
    )


def typed_load(spark: SparkSession, d: str) -> DataFrame:
    return apply_types(_order_text(Tables(spark, d)), {"order_date": "date", "custkey": "int"}, ["fulfilled"])


_CSV_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "order_date", "o_orderpriority", "note"]


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as CSV into the shared folder and read back, typed.

    ``note`` holds a comma, doubled quotes and a newline. This query writes
    when called (the write is its point); the read back is lazy.
    """
    orders = Tables(spark, d).orders
    src = orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.to_date("o_orderdate").alias("order_date"),
        "o_orderpriority",
        F.concat(F.col("o_orderpriority"), F.lit(', "'), F.col("o_orderstatus"), F.lit('"\nend')).alias("note"),
    )
    path = shared_dir(spark, "csv_round_trip")
    write_csv(src, path)
    return read_typed_csv(
        spark,
        path,
        {"o_orderkey": "bigint", "o_custkey": "bigint", "order_date": "date"},
        columns=_CSV_COLUMNS,
        multi_line=True,
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "either_side_filter": either_side_filter,
    "counterparty_balance": counterparty_balance,
    "counterparty_extremes": counterparty_extremes,
    "two_sided_long": two_sided_long,
    "member_set": member_nations,
    "restrict_to_members": restrict_members,
    "repeat_in_group": repeat_in_group,
    "repeat_in_group_enriched": repeat_in_group_enriched,
    "repeat_in_group_filtered": repeat_in_group_filtered,
    "three_key_join": three_key_join,
    "alias_filter": alias_filter_count,
    "truthy_flag": truthy_flag,
    "from_period": from_period_count,
    "pair_label": pair_label_query,
    "period_top_n_named": period_top_n_named,
    "period_top_n_ties": period_top_n_ties,
    "modal_value_named": modal_value_named,
    "modal_values_ties": modal_values_ties,
    "period_top_n_with_mode": period_top_n_with_mode,
    "event_gaps": event_gaps_query,
    "open_gaps": open_gaps,
    "longest_gaps_top20": longest_gaps_top20,
    "deficit_gaps_top20": deficit_gaps_top20,
    "longest_gaps_per_entity": longest_gaps_per_entity,
    "typed_load": typed_load,
    "csv_round_trip": csv_round_trip,
}
