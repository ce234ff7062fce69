"""DuckDB oracle SQL for the driver queries in ``supplied`` (same keys).

Each statement computes, from the supplied tables, exactly what the Spark
query computes, with the same column names and types (counts BIGINT, years
and ranks INTEGER, day gaps INTEGER).
"""

from __future__ import annotations

from vsframe.plans.supplied import (
    DEFICIT_SINCE,
    FROM_DATE,
    FROM_YEAR,
    GAPS_SINCE,
    LONGEST_N,
    MEMBER_BEFORE,
    MEMBER_STATUS,
    ODD_NUMBERS,
    OPEN_END,
    PRIORITY_ALIASES,
    PURCHASE_BEFORE,
    SUBJECT_NATION,
    TOP_FROM_YEAR,
    TOP_LABEL,
    TOP_N,
)
from vsframe.plans.trade import TRADE_SQL

_TRADE = f"trade AS ({TRADE_SQL})"

_BALANCE = f"""
WITH {_TRADE},
balance AS (
  SELECT CASE WHEN seller_nation = {SUBJECT_NATION} THEN buyer_nation ELSE seller_nation END AS counterparty,
         CAST(SUM(CASE WHEN seller_nation = {SUBJECT_NATION} THEN qty ELSE -qty END) AS BIGINT) AS net_quantity
  FROM trade WHERE seller_nation = {SUBJECT_NATION} OR buyer_nation = {SUBJECT_NATION}
  GROUP BY 1)
"""

_MEMBERS = f"""
members AS (
  SELECT DISTINCT nation FROM (
    SELECT seller_nation AS nation FROM trade
    WHERE o_orderstatus = '{MEMBER_STATUS}' AND o_orderdate < TIMESTAMP '{MEMBER_BEFORE}'
    UNION ALL
    SELECT buyer_nation FROM trade
    WHERE o_orderstatus = '{MEMBER_STATUS}' AND o_orderdate < TIMESTAMP '{MEMBER_BEFORE}'))
"""

_PURCHASERS = f"""
purchasers AS (
  SELECT DISTINCT user_id FROM events
  WHERE event_type = 'purchase' AND ts < TIMESTAMP '{PURCHASE_BEFORE}')
"""

_REPEATS = """
repeats AS (
  SELECT l.l_orderkey, p.p_brand, COUNT(*) AS n_lines
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2 HAVING COUNT(*) >= 3)
"""

_ALIASES = ", ".join(f"'{a}'" for a in PRIORITY_ALIASES)

_CUSTOMER_COUNTS = f"""
cc AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS order_year, c.c_name, c.c_nationkey, COUNT(*) AS n_orders
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate >= TIMESTAMP '{TOP_FROM_YEAR}-01-01'
  GROUP BY 1, 2, 3)
"""

_TOP_NAMED = f"""
top_named AS (
  SELECT * FROM (
    SELECT *, CAST(dense_rank() OVER (PARTITION BY order_year ORDER BY n_orders DESC, c_name ASC NULLS FIRST) AS INTEGER) AS rnk
    FROM cc) WHERE rnk <= {TOP_N})
"""

_NATION_COUNTS = f"""
nc AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS order_year, n.n_name, COUNT(*) AS n_orders
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderdate >= TIMESTAMP '{TOP_FROM_YEAR}-01-01'
  GROUP BY 1, 2)
"""

_MODAL_NAMED = """
modal AS (
  SELECT order_year, n_name AS modal_nation, n_orders FROM (
    SELECT *, dense_rank() OVER (PARTITION BY order_year ORDER BY n_orders DESC, n_name ASC NULLS FIRST) AS rk
    FROM nc) WHERE rk = 1)
"""


def _gaps_sql(restrict: bool) -> str:
    member_clause = "AND user_id IN (SELECT user_id FROM purchasers)" if restrict else ""
    return f"""
errs AS (
  SELECT user_id, event_id, ts, value FROM events
  WHERE event_type = 'error' AND ts >= TIMESTAMP '{GAPS_SINCE}' {member_clause}),
lagged AS (
  SELECT user_id, event_id, CAST(ts AS DATE) AS event_date, value,
         lag(ts) OVER w AS prev_ts, lag(event_id) OVER w AS prev_event_id, lag(value) OVER w AS prev_value
  FROM errs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
gaps AS (
  SELECT user_id, event_id, event_date, value, CAST(prev_ts AS DATE) AS prev_event_date, prev_event_id, prev_value,
         CAST(date_diff('day', CAST(prev_ts AS DATE), event_date) AS INTEGER) AS gap_days
  FROM lagged WHERE prev_ts IS NOT NULL)
"""


_ODD = "[" + ", ".join(f"'{x}'" for x in ODD_NUMBERS) + "]"

ORACLE_SQL: dict[str, str] = {
    "either_side_filter": f"""
WITH {_TRADE}
SELECT seller_nation, buyer_nation, COUNT(*) AS n_lines, CAST(SUM(qty) AS BIGINT) AS quantity
FROM trade WHERE seller_nation = {SUBJECT_NATION} OR buyer_nation = {SUBJECT_NATION}
GROUP BY 1, 2
""",
    "counterparty_balance": _BALANCE + "SELECT counterparty, net_quantity FROM balance",
    "counterparty_extremes": _BALANCE + """
SELECT * FROM (SELECT counterparty, net_quantity, 'best' AS kind FROM balance
               WHERE net_quantity IS NOT NULL ORDER BY net_quantity DESC, counterparty LIMIT 1)
UNION ALL
SELECT * FROM (SELECT counterparty, net_quantity, 'worst' AS kind FROM balance
               WHERE net_quantity IS NOT NULL ORDER BY net_quantity ASC, counterparty LIMIT 1)
""",
    "two_sided_long": f"""
WITH {_TRADE}
SELECT nation, CAST(SUM(sold) AS BIGINT) AS sold, CAST(SUM(bought) AS BIGINT) AS bought, COUNT(*) AS n_lines
FROM (SELECT seller_nation AS nation, qty AS sold, 0 AS bought FROM trade
      UNION ALL SELECT buyer_nation AS nation, 0 AS sold, qty AS bought FROM trade)
GROUP BY nation
""",
    "member_set": f"WITH {_TRADE}, {_MEMBERS} SELECT nation FROM members",
    "restrict_to_members": f"""
WITH {_PURCHASERS}
SELECT user_id, COUNT(*) AS n_errors FROM events
WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM purchasers)
GROUP BY user_id
""",
    "repeat_in_group": f"WITH {_REPEATS} SELECT l_orderkey, p_brand, n_lines FROM repeats",
    "repeat_in_group_enriched": f"""
WITH {_REPEATS}
SELECT r.l_orderkey, r.p_brand, r.n_lines, CAST(o.o_orderdate AS DATE) AS order_date, o.o_orderstatus, o.o_orderpriority
FROM repeats r JOIN orders o ON r.l_orderkey = o.o_orderkey
WHERE lower(o.o_orderpriority) IN ({_ALIASES})
ORDER BY order_date, r.l_orderkey, r.p_brand
""",
    "repeat_in_group_filtered": """
SELECT l.l_orderkey, p.p_brand, COUNT(*) AS n_lines
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag <> 'R' GROUP BY 1, 2 HAVING COUNT(*) >= 2
""",
    "three_key_join": """
WITH k AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS order_year,
                  NULLIF(o_orderpriority, '5-LOW') AS priority, o_orderkey, o_orderstatus FROM orders),
f AS (SELECT o_custkey, order_year, priority, COUNT(*) AS n_orders FROM k WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3)
SELECT f.o_custkey, f.order_year, f.priority, f.n_orders, k.o_orderkey, k.o_orderstatus
FROM f JOIN k ON f.o_custkey = k.o_custkey AND f.order_year = k.order_year AND f.priority = k.priority
""",
    "alias_filter": f"""
SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders
WHERE lower(o_orderpriority) IN ({_ALIASES}) GROUP BY 1
""",
    "truthy_flag": """
SELECT COALESCE(lower(o_orderstatus) IN ('f'), false) AS is_fulfilled, COUNT(*) AS n_orders
FROM orders GROUP BY 1
""",
    "from_period": f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, COUNT(*) AS n_orders,
       COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{FROM_DATE}') AS n_from_date
FROM orders WHERE o_orderdate >= TIMESTAMP '{FROM_YEAR}-01-01' GROUP BY 1
""",
    "pair_label": """
SELECT l_orderkey,
       concat_ws(':',
         CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INTEGER) END) AS VARCHAR),
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) END) AS VARCHAR)) AS label
FROM lineitem GROUP BY l_orderkey
""",
    "period_top_n_named": f"WITH {_CUSTOMER_COUNTS}, {_TOP_NAMED} SELECT * FROM top_named",
    "period_top_n_ties": f"""
WITH {_CUSTOMER_COUNTS}
SELECT * FROM (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY order_year ORDER BY n_orders DESC) AS INTEGER) AS rnk FROM cc)
WHERE rnk <= {TOP_N}
""",
    "modal_value_named": f"WITH {_NATION_COUNTS}, {_MODAL_NAMED} SELECT * FROM modal",
    "modal_values_ties": f"""
WITH {_NATION_COUNTS},
mx AS (SELECT order_year, MAX(n_orders) AS n_orders FROM nc GROUP BY 1)
SELECT nc.order_year, string_agg(nc.n_name, '/' ORDER BY nc.n_name) AS modal_nations, mx.n_orders
FROM nc JOIN mx ON nc.order_year = mx.order_year AND nc.n_orders = mx.n_orders
GROUP BY nc.order_year, mx.n_orders
""",
    "period_top_n_with_mode": f"""
WITH {_CUSTOMER_COUNTS}, {_TOP_NAMED}, {_NATION_COUNTS}, {_MODAL_NAMED}
SELECT t.c_name, t.c_nationkey, t.n_orders, t.rnk, t.order_year, '{TOP_LABEL}' AS label, m.modal_nation
FROM top_named t LEFT JOIN modal m ON t.order_year = m.order_year
ORDER BY t.order_year, t.n_orders DESC, t.c_name
""",
    "event_gaps": "WITH " + _gaps_sql(False) + " SELECT * FROM gaps",
    "open_gaps": "WITH " + _gaps_sql(False) + f"""
SELECT * FROM gaps UNION ALL
SELECT user_id, NULL, DATE '{OPEN_END}', NULL, CAST(ts AS DATE), event_id, value,
       CAST(date_diff('day', CAST(ts AS DATE), DATE '{OPEN_END}') AS INTEGER)
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM errs)
WHERE rn = 1 AND ts <= TIMESTAMP '{OPEN_END}'
""",
    "longest_gaps_top20": f"WITH {_PURCHASERS}, " + _gaps_sql(True) + f"""
SELECT * FROM gaps ORDER BY gap_days DESC, user_id, event_date, event_id LIMIT {LONGEST_N}
""",
    "deficit_gaps_top20": f"""
WITH {_TRADE}, {_MEMBERS},
daily AS (
  SELECT nation, order_date, CAST(SUM(sold) AS BIGINT) AS sold, CAST(SUM(bought) AS BIGINT) AS bought FROM (
    SELECT seller_nation AS nation, CAST(o_orderdate AS DATE) AS order_date, qty AS sold, 0 AS bought
    FROM trade WHERE o_orderdate >= TIMESTAMP '{DEFICIT_SINCE}'
    UNION ALL
    SELECT buyer_nation AS nation, CAST(o_orderdate AS DATE) AS order_date, 0 AS sold, qty AS bought
    FROM trade WHERE o_orderdate >= TIMESTAMP '{DEFICIT_SINCE}')
  WHERE nation IN (SELECT nation FROM members)
  GROUP BY 1, 2),
lagged AS (
  SELECT nation, order_date, bought,
         lag(order_date) OVER w AS prev_deficit_date, lag(bought) OVER w AS prev_bought
  FROM daily WHERE bought > sold
  WINDOW w AS (PARTITION BY nation ORDER BY order_date))
SELECT nation, order_date AS deficit_date, bought, prev_deficit_date, prev_bought,
       CAST(date_diff('day', prev_deficit_date, order_date) AS INTEGER) AS gap_days
FROM lagged WHERE prev_deficit_date IS NOT NULL
ORDER BY gap_days DESC, nation, deficit_date LIMIT {LONGEST_N}
""",
    "longest_gaps_per_entity": "WITH " + _gaps_sql(False) + """
SELECT user_id, event_id, event_date, value, prev_event_date, prev_event_id, prev_value, gap_days FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap_days DESC, event_date, event_id) AS rn FROM gaps)
WHERE rn = 1
""",
    "typed_load": """
SELECT o_orderkey,
  TRY_CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 'NA'
                WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN '1999-13-45'
                ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS order_date,
  CASE WHEN regexp_full_match(custtext, '\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]*)\\s*')
       THEN TRY_CAST(CASE WHEN regexp_full_match(custtext, '\\s*[+-]?\\..*') THEN '0'
                          ELSE regexp_extract(custtext, '[+-]?[0-9]+') END AS INTEGER) END AS custkey,
  COALESCE(lower(CASE WHEN o_orderstatus = 'F' THEN 'TRUE' WHEN o_orderstatus = 'O' THEN 'yes' END)
           IN ('true', 't', 'yes', '1'), false) AS fulfilled
FROM (SELECT *, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '#' || o_custkey
                     WHEN o_orderpriority = '2-HIGH' THEN o_custkey || '.0'
                     WHEN o_orderpriority = '1-URGENT' THEN ' -' || o_custkey || '.7 '
                     WHEN o_orderstatus = 'P' THEN """ + _ODD + """[o_orderkey % """ + str(len(ODD_NUMBERS)) + """ + 1]
                     ELSE CAST(o_custkey AS VARCHAR) END AS custtext FROM orders)
""",
    "csv_round_trip": """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority,
       o_orderpriority || ', "' || o_orderstatus || '"' || chr(10) || 'end' AS note
FROM orders
""",
}
