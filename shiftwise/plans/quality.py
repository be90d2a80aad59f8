"""Driver queries for data-quality validators (section 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import quality as qc
from shiftwise.operators.sets import union_reasons
from shiftwise.plans.common import c
from shiftwise.plans.registry import query
from shiftwise.sources.tables import Tables


@query("constraint_report", """
SELECT 'pk_orders' AS check_name, CAST(COALESCE(SUM(CASE WHEN k IS NULL THEN n WHEN n > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations
FROM (SELECT o_orderkey AS k, COUNT(*) AS n FROM orders GROUP BY o_orderkey) x
UNION ALL
SELECT 'pk_lineitem', CAST(COALESCE(SUM(CASE WHEN a IS NULL OR b IS NULL THEN n WHEN n > 1 THEN 1 ELSE 0 END), 0) AS BIGINT)
FROM (SELECT l_orderkey AS a, l_linenumber AS b, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) y
UNION ALL
SELECT 'fk_orders_customer', CAST(COUNT(*) AS BIGINT) FROM orders o
WHERE o.o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL
SELECT 'fk_lineitem_orders', CAST(COUNT(*) AS BIGINT) FROM lineitem l
WHERE l.l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'fk_lineitem_part', CAST(COUNT(*) AS BIGINT) FROM lineitem l
WHERE l.l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
UNION ALL
SELECT 'not_null_l_shipdate', CAST(SUM(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem
UNION ALL
SELECT 'not_null_l_quantity', CAST(SUM(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem
UNION ALL
SELECT 'domain_o_orderstatus', CAST(SUM(CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P') THEN 1 ELSE 0 END) AS BIGINT) FROM orders
UNION ALL
SELECT 'length_c_name_25', CAST(SUM(CASE WHEN length(c_name) > 25 THEN 1 ELSE 0 END) AS BIGINT) FROM customer
UNION ALL
SELECT 'json_events_props', CAST(SUM(CASE WHEN props IS NOT NULL AND NOT json_valid(props) THEN 1 ELSE 0 END) AS BIGINT) FROM events
""")
def constraint_report(spark, sf):
    t = Tables(spark, sf)
    # a table is read once for all its checks, and once more where others refer to it
    parts = [
        qc.check_table(t.orders, ("pk_orders", ["o_orderkey"]), {"domain_o_orderstatus": qc.outside("o_orderstatus", ["F", "O", "P"])},
                       [("fk_orders_customer", "o_custkey", t.customer, "c_custkey")]),
        qc.check_table(t.lineitem, ("pk_lineitem", ["l_orderkey", "l_linenumber"]),
                       {"not_null_l_shipdate": qc.not_null("l_shipdate"), "not_null_l_quantity": qc.not_null("l_quantity")},
                       [("fk_lineitem_part", "l_partkey", t.part, "p_partkey"), ("fk_lineitem_orders", "l_orderkey", t.orders, "o_orderkey")]),
        qc.check_table(t.customer, checks={"length_c_name_25": qc.too_long("c_name", 25)}),
        qc.check_table(t.events, checks={"json_events_props": qc.invalid_json("props")}),
    ]
    return union_reasons(*parts)


# Entries of one employee-day in insertion order; (line number, part,
# supplier) is unique within an order in the test data.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def _candidates(t: Tables):
    """Timesheet candidates: one line = one entry; employee-day = order.

    Daily contract hours come through two hops (order -> customer -> nation):
    40 + 10 * region key.
    """
    nations = t.nation.select("n_nationkey", "n_regionkey")
    cust = t.customer.select("c_custkey", "c_nationkey").join(nations, c("c_nationkey") == c("n_nationkey"))
    limits = t.orders.select("o_orderkey", "o_custkey").join(cust, c("o_custkey") == c("c_custkey")).select(
        "o_orderkey", (F.lit(40) + F.lit(10) * c("n_regionkey")).cast("long").alias("daily_limit"))
    flag = c("l_returnflag")
    lines = t.lineitem.select(
        "l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey",
        F.when(flag == "N", "REG").when(flag == "A", "OVT").otherwise("TRV").alias("time_type"),
        c("l_quantity").cast("long").alias("hours"), "l_shipdate")
    return lines.join(limits, c("l_orderkey") == c("o_orderkey")).drop("o_orderkey")


_RULES_SQL = """
WITH t AS (
  SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_partkey, l.l_suppkey,
         CASE l.l_returnflag WHEN 'N' THEN 'REG' WHEN 'A' THEN 'OVT' ELSE 'TRV' END AS time_type,
         CAST(l.l_quantity AS BIGINT) AS hours, l.l_shipdate,
         CAST(40 + 10 * n.n_regionkey AS BIGINT) AS daily_limit
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
r AS (
  SELECT *, CAST(COALESCE(SUM(CASE WHEN time_type = 'REG' THEN hours END) OVER (
              PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS existing_hours
  FROM t),
e AS (
  SELECT *, CAST(CASE WHEN time_type = 'REG' AND hours > daily_limit THEN 20001
                      WHEN time_type = 'REG' AND {cumul} THEN 20002
                      WHEN time_type = 'OVT' AND hours > 30 THEN 20003 END AS BIGINT) AS error_code
  FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, time_type, hours, daily_limit, existing_hours, error_code,
       CASE error_code
         WHEN 20001 THEN 'Inserted regular hours (' || CAST(hours AS VARCHAR) || ') exceed daily limit of '
                         || CAST(daily_limit AS VARCHAR) || ' hours of employment contract.'
         WHEN 20002 THEN 'This user is already recorded with ' || CAST(existing_hours AS VARCHAR) || ' regular hours on '
                         || strftime(l_shipdate, '%Y-%m-%d') || ', so you cannot add your new ' || CAST(hours AS VARCHAR) || ' hours.'
         WHEN 20003 THEN 'No more than 30 hours overtime per day' END AS message
FROM e
"""


def _rules(spark, sf, mode):
    checked = qc.timesheet_rules(_candidates(Tables(spark, sf)), group=["l_orderkey"], order=LINE_ORDER,
                                 hours="hours", time_type="time_type", limit="daily_limit",
                                 overtime_cap=30, mode=mode, day="l_shipdate")
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "time_type", "hours", "daily_limit",
                          "existing_hours", "error_code", "message")


@query("daily_limit_strict", _RULES_SQL.format(cumul="existing_hours + hours > daily_limit"))
def daily_limit_strict(spark, sf):
    return _rules(spark, sf, "strict")


@query("daily_limit_compat", _RULES_SQL.format(
    cumul="existing_hours - hours > 0 AND existing_hours + hours > daily_limit"))
def daily_limit_compat(spark, sf):
    return _rules(spark, sf, "compat")


_SEQ_SQL = """
WITH RECURSIVE t AS (
  SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_partkey, l.l_suppkey,
         CASE l.l_returnflag WHEN 'N' THEN 'REG' WHEN 'A' THEN 'OVT' ELSE 'TRV' END AS time_type,
         CAST(l.l_quantity AS BIGINT) AS hours, CAST(40 + 10 * n.n_regionkey AS BIGINT) AS daily_limit
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM t),
s AS (
  SELECT l_orderkey, rn, l_linenumber, l_partkey, l_suppkey, time_type, hours, daily_limit,
         CAST(0 AS BIGINT) AS existing_hours,
         CASE WHEN time_type = 'REG' AND hours > daily_limit THEN 20001
              WHEN time_type = 'OVT' AND hours > 30 THEN 20003 END AS error_code,
         CAST(CASE WHEN time_type = 'REG' AND hours <= daily_limit THEN hours ELSE 0 END AS BIGINT) AS recorded
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.l_orderkey, r.rn, r.l_linenumber, r.l_partkey, r.l_suppkey, r.time_type, r.hours, r.daily_limit,
         s.recorded,
         CASE WHEN r.time_type = 'REG' AND r.hours > r.daily_limit THEN 20001
              WHEN r.time_type = 'REG' AND s.recorded + r.hours > r.daily_limit THEN 20002
              WHEN r.time_type = 'OVT' AND r.hours > 30 THEN 20003 END,
         s.recorded + CASE WHEN r.time_type = 'REG' AND s.recorded + r.hours <= r.daily_limit THEN r.hours ELSE 0 END
  FROM s JOIN r ON r.l_orderkey = s.l_orderkey AND r.rn = s.rn + 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, time_type, hours, daily_limit, existing_hours,
       CAST(error_code AS BIGINT) AS error_code
FROM s
"""


@query("daily_limit_sequential", _SEQ_SQL)
def daily_limit_sequential(spark, sf):
    """Insert-by-insert form (rejected rows do not count); recursive-CTE oracle."""
    cand = _candidates(Tables(spark, sf)).drop("l_shipdate")
    res = qc.sequential_rules(cand, group=["l_orderkey"], order=LINE_ORDER, hours="hours",
                              time_type="time_type", limit="daily_limit", overtime_cap=30)
    return res.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "time_type", "hours",
                      "daily_limit", "existing_hours", "error_code")
