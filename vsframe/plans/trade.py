"""Trade between nations: the two-sided fact built from the supplied tables.

A line item is a trade from the supplier's nation (seller, side a) to the
ordering customer's nation (buyer, side b). Domestic lines (seller = buyer)
are left out. Quantities are whole numbers stored as double; they are summed
as integers so totals are exact.

Join order is chosen for size: orders meet customer first (one key lookup per
order), so lineitem is shuffled by order key once; the joined lines then meet
the supplier, and only after that are they summed per (seller nation, buyer
nation, carried order columns), whose map-side partial step leaves at most a
few hundred rows per task. Summing per supplier before the supplier join was
tried and dropped: after the order-key join a supplier's lines are spread
over all tasks, so that partial step combined almost nothing and added a
shuffle. A hot supplier or customer is split by AQE, since every join here
has a plain shuffle on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.sources.tables import Tables


def _orders(t: Tables, order_cols, order_where) -> tuple[DataFrame, list[str]]:
    carried = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    orders = t.orders
    if order_where is not None:
        orders = orders.where(order_where)
    orders = orders.select("o_orderkey", "o_custkey", *carried)
    return orders, [c for c in orders.columns if c not in ("o_orderkey", "o_custkey")]


def _customers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("buyer_nation"))


def _sellers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("seller_nation"))


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_suppkey",
        F.col("l_quantity").cast("int").alias("qty"),
    )


def nation_trade(
    t: Tables,
    order_cols: Sequence[str | Column] = (),
    order_where: Column | None = None,
) -> DataFrame:
    """(seller_nation, buyer_nation, *order_cols, quantity bigint, n_lines bigint).

    One row per (seller, buyer, carried values); consumers sum ``quantity``
    and ``n_lines`` further as they need. ``order_cols`` are columns or named
    expressions over ``orders`` carried into the grain; ``order_where``
    filters orders, and is pushed into their scan.
    """
    orders, carried = _orders(t, order_cols, order_where)
    buyers = orders.join(_customers(t), on="o_custkey").drop("o_custkey")
    lines = (
        _lines(t)
        .join(buyers, on="o_orderkey")
        .join(_sellers(t), on="l_suppkey")
        .where(F.col("seller_nation") != F.col("buyer_nation"))
    )
    return lines.groupBy("seller_nation", "buyer_nation", *carried).agg(
        F.sum("qty").alias("quantity"), F.count(F.lit(1)).alias("n_lines")
    )


# Oracle-side definition of the same fact at line grain (DuckDB SQL).
TRADE_SQL = """
SELECT s.s_nationkey AS seller_nation, c.c_nationkey AS buyer_nation,
       CAST(l.l_quantity AS INTEGER) AS qty, o.o_orderdate, o.o_orderstatus
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE s.s_nationkey <> c.c_nationkey
"""
