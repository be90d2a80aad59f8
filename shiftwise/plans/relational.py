"""Relational driver queries: timesheet selects, views, reports (sections 2.3-2.6, 2.11).

Mapping onto the test tables: employee = customer, employee-project link =
order, timesheet row = lineitem (hours = ``l_quantity``, time type =
``l_returnflag`` with 'R' as regular, 'A' as overtime, 'R' as vacation in the
activity report), project = part brand, day of work = ``l_shipdate``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import aggregates as agg
from shiftwise.operators import joins, windows
from shiftwise.operators.warehouse import date_dimension, seed_dimension
from shiftwise.plans.common import c, day_text, money, ts_range, ts_text
from shiftwise.plans.registry import query
from shiftwise.sources.tables import Tables

MAY = ("1996-05-01", "1996-06-01")
JUNE = ("1996-06-01", "1996-07-01")
YEAR = ("1996-01-01", "1997-01-01")
ONE_DAY = ("1996-06-05", "1996-06-06")


def _reg_hours_per_customer(t: Tables):
    """REG hours per employee, pre-aggregated per order before the order join."""
    per_order = agg.hours_by_key(t.lineitem, ["l_orderkey"], "l_quantity",
                                 where=c("l_returnflag") == "R", out="h")
    return (per_order.join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
            .groupBy("o_custkey").agg(F.sum("h").alias("h")))


@query("regular_totals", """
SELECT c.c_custkey AS employee_id, c.c_name AS full_name,
       CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_reg_hours
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE l.l_returnflag = 'R'
GROUP BY c.c_custkey, c.c_name
""")
def regular_totals(spark, sf):
    t = Tables(spark, sf)
    per_cust = _reg_hours_per_customer(t)
    res = per_cust.join(t.customer.select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"))
    return res.select(c("c_custkey").alias("employee_id"), c("c_name").alias("full_name"),
                      money("h").alias("total_reg_hours"))


@query("left_join_default", """
SELECT c.c_custkey AS employee_id, c.c_name AS full_name,
       CAST(COALESCE(SUM(CAST(l.l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS hours_on_day
FROM customer c
LEFT JOIN orders o ON c.c_custkey = o.o_custkey
LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
     AND l.l_shipdate >= TIMESTAMP '1996-06-05' AND l.l_shipdate < TIMESTAMP '1996-06-06'
GROUP BY c.c_custkey, c.c_name
""")
def left_join_default(spark, sf):
    t = Tables(spark, sf)
    lines = t.lineitem.select("l_orderkey", "l_shipdate", "l_quantity").join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    # the day is part of ON: customers without lines on it stay
    res = joins.left_join_filtered(t.customer.select("c_custkey", "c_name"), lines, c("c_custkey") == c("o_custkey"), ts_range("l_shipdate", *ONE_DAY))
    hours = res.groupBy("c_custkey", "c_name").agg(agg.exact_sum("l_quantity").alias("h"))
    return hours.select(c("c_custkey").alias("employee_id"), c("c_name").alias("full_name"),
                        money(F.coalesce(c("h"), F.lit(0).cast("decimal(18,2)"))).alias("hours_on_day"))


@query("rank_totals", """
SELECT CAST(RANK() OVER (ORDER BY total_regular_hours DESC NULLS FIRST) AS BIGINT) AS regular_hours_rank,
       employee_id, total_regular_hours
FROM (SELECT o.o_custkey AS employee_id,
             CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_regular_hours
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      WHERE l.l_returnflag = 'R'
      GROUP BY o.o_custkey) t
""")
def rank_totals(spark, sf):
    t = Tables(spark, sf)
    totals = _reg_hours_per_customer(t).select(c("o_custkey").alias("employee_id"),
                                               money("h").alias("total_regular_hours"))
    ranked = windows.global_rank(totals, [c("total_regular_hours").desc_nulls_first()], "rank",
                                 "regular_hours_rank")
    return ranked.select("regular_hours_rank", "employee_id", "total_regular_hours")


@query("entries_view", """
SELECT c.c_custkey AS employee_id, c.c_name AS employee,
       strftime(l.l_shipdate, '%Y-%m-%d') AS day_of_record, l.l_returnflag AS type_of_record,
       l.l_quantity AS hours_per_day, p.p_brand AS project_name, s.s_name AS supplier_name,
       l.l_orderkey AS orderkey, CAST(l.l_linenumber AS BIGINT) AS linenumber
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")
def entries_view(spark, sf):
    t = Tables(spark, sf)
    fact = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                             "l_returnflag", "l_quantity")
    res = joins.star_join(fact, [
        (t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")),
        (t.customer.select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey")),
        (t.part.select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")),
        (t.supplier.select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey")),
    ])
    return res.select(c("c_custkey").alias("employee_id"), c("c_name").alias("employee"),
                      day_text("l_shipdate").alias("day_of_record"), c("l_returnflag").alias("type_of_record"),
                      c("l_quantity").alias("hours_per_day"), c("p_brand").alias("project_name"),
                      c("s_name").alias("supplier_name"), c("l_orderkey").alias("orderkey"),
                      c("l_linenumber").cast("long").alias("linenumber"))


def project_hours_frame(t: Tables):
    """A2 / materialized view body: hours per employee x project."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(
        t.part.select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey"))
    lines = lines.join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    per_emp = agg.hours_by_key(lines, ["o_custkey", "p_brand"], "l_quantity", out="h")
    named = per_emp.join(t.customer.select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"))
    return named.select(c("o_custkey").alias("employee_id"), c("c_name").alias("full_name"),
                        c("p_brand").alias("project_id"), money("h").alias("total_hours"))


@query("project_hours", """
SELECT o.o_custkey AS employee_id, c.c_name AS full_name, p.p_brand AS project_id,
       CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_hours
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_custkey, c.c_name, p.p_brand
""")
def project_hours(spark, sf):
    return project_hours_frame(Tables(spark, sf))


@query("people_by_code", """
SELECT o.o_orderstatus AS code, CAST(COUNT(DISTINCT c.c_custkey) AS BIGINT) AS people
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus IS NOT NULL
GROUP BY o.o_orderstatus
""")
def people_by_code(spark, sf):
    t = Tables(spark, sf)
    facts = t.orders.select(c("o_custkey").alias("custkey"), F.trim(c("o_orderstatus")).alias("code"))
    dim = t.customer.select(c("c_custkey").alias("custkey"))
    joined = joins.join_using(facts, dim, "custkey")
    counted = agg.people_by_code(joined, "code", "custkey")
    return counted.orderBy(c("people").desc(), c("code"))


@query("people_by_code_sketch", """
SELECT event_type AS code, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS people, true AS close
FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY event_type
""")
def people_by_code_sketch(spark, sf):
    """A3 from daily sketches, merged over a period: within 5 % (three standard errors) of the exact count."""
    ev = Tables(spark, sf).events.select("event_type", F.to_date("ts").alias("day"), "user_id", "ts")
    period = c("day") < F.lit("2024-01-15").cast("date")
    told = agg.people_of_period(agg.people_sketches(ev, "event_type", "day", "user_id"), "event_type", period, out="about")
    exact = agg.people_by_code(ev.where(ts_range("ts", "2000-01-01", "2024-01-15")), "event_type", "user_id")
    both = exact.join(told, "event_type")
    return both.select(c("event_type").alias("code"), "people", (F.abs(c("about") - c("people")) <= 0.05 * c("people")).alias("close"))


@query("session_details", """
SELECT event_type || ' ' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS session_name,
       upper(strftime(CAST(ts AS DATE), '%d-%b-%y')) AS session_date,
       strftime(min(ts), '%H:%M:%S') AS start_time,
       strftime(max(ts), '%H:%M:%S') AS end_time,
       CAST(count(*) AS BIGINT) AS participants,
       CAST(count(DISTINCT user_id) AS BIGINT) AS distinct_users
FROM events
GROUP BY event_type, CAST(ts AS DATE)
""")
def session_details(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.select("event_type", "user_id", "ts", F.to_date("ts").alias("day"))
    s = ev.groupBy("event_type", "day").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.count(F.lit(1)).alias("participants"), F.count_distinct("user_id").alias("distinct_users"))
    return s.select(F.concat_ws(" ", c("event_type"), day_text("day")).alias("session_name"),
                    F.upper(F.date_format("day", "dd-MMM-yy")).alias("session_date"),
                    F.date_format("t0", "HH:mm:ss").alias("start_time"),
                    F.date_format("t1", "HH:mm:ss").alias("end_time"),
                    c("participants").cast("long").alias("participants"),
                    c("distinct_users").cast("long").alias("distinct_users"))


@query("missed_with_reason", """
WITH attended AS (
  SELECT DISTINCT o_custkey FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-07-01'),
reasons AS (
  SELECT o_custkey AS custkey, 'P' AS code, 'pending order' AS description FROM orders
  WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1996-06-01'
  UNION ALL
  SELECT o.o_custkey, 'R', 'returned item' FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_returnflag = 'R' AND l.l_shipdate >= TIMESTAMP '1996-06-01' AND l.l_shipdate < TIMESTAMP '1996-07-01')
SELECT c.c_custkey AS employee_id, c.c_name AS full_name,
       array_to_string(list_sort(list_distinct(list(r.code || ':' || r.description))), '; ') AS reasons
FROM customer c JOIN reasons r ON r.custkey = c.c_custkey
WHERE c.c_acctbal > 0
  AND NOT EXISTS (SELECT 1 FROM attended a WHERE a.o_custkey = c.c_custkey)
GROUP BY c.c_custkey, c.c_name
""")
def missed_with_reason(spark, sf):
    t = Tables(spark, sf)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    attended = orders.where(ts_range("o_orderdate", *JUNE)).select(c("o_custkey").alias("custkey"))
    pending = (orders.where((c("o_orderstatus") == "P") & ts_range("o_orderdate", *MAY))
               .select(c("o_custkey").alias("custkey"), F.lit("P").alias("code"),
                       F.lit("pending order").alias("description")))
    returned = (t.lineitem.where((c("l_returnflag") == "R") & ts_range("l_shipdate", *JUNE))
                .select("l_orderkey").join(orders.select("o_orderkey", "o_custkey"),
                                           c("l_orderkey") == c("o_orderkey"))
                .select(c("o_custkey").alias("custkey"), F.lit("R").alias("code"),
                        F.lit("returned item").alias("description")))
    from shiftwise.operators.sets import union_reasons
    reasons = union_reasons(pending, returned)
    expected = t.customer.where(c("c_acctbal") > 0).select(c("c_custkey").alias("custkey"), "c_name")
    missed = joins.missed_with_reason(expected, attended, reasons, "custkey")
    listed = reasons.groupBy("custkey").agg(
        agg.collect_sorted(F.concat_ws(":", "code", "description")).alias("reasons"))
    return missed.join(listed, "custkey").select(c("custkey").alias("employee_id"),
                                                 c("c_name").alias("full_name"), "reasons")


def activity_frame(t: Tables, start: str, end: str):
    """R4 flagship: per employee worked / overtime / vacation hours + attended sessions.

    One pass over the period's lines with three conditional sums (A5),
    pre-aggregated per order before the join to orders; sessions are the
    bounded set of order priorities in the period (A8).
    """
    flag = c("l_returnflag")
    lines = t.lineitem.where(ts_range("l_shipdate", start, end)).select("l_orderkey", "l_returnflag", "l_quantity")
    buckets = {"worked": ~flag.isin("R", "A"), "overtime": flag == "A", "vacation": flag == "R"}
    per_order = agg.bucketed_sums(lines, ["l_orderkey"], "l_quantity", buckets)
    per_emp = (per_order.join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
               .groupBy("o_custkey").agg(*[F.sum(b).alias(b) for b in buckets]))
    sessions = (t.orders.where(ts_range("o_orderdate", start, end))
                .groupBy("o_custkey").agg(agg.collect_sorted(c("o_orderpriority")).alias("sessions")))
    emp = t.customer.select("c_custkey", "c_name")
    res = (emp.join(per_emp, c("c_custkey") == per_emp["o_custkey"], "left")
              .join(sessions, c("c_custkey") == sessions["o_custkey"], "left"))
    zero = F.lit(0).cast("decimal(18,2)")
    return res.select(c("c_custkey").alias("employee_id"), c("c_name").alias("full_name"),
                      money(F.coalesce(c("worked"), zero)).alias("worked_hours"),
                      money(F.coalesce(c("overtime"), zero)).alias("overtime_hours"),
                      money(F.coalesce(c("vacation"), zero)).alias("vacation_hours"),
                      F.coalesce(c("sessions"), F.lit("")).alias("sessions"))


ACTIVITY_SQL = """
WITH lines AS (
  SELECT o.o_custkey AS custkey,
    SUM(CASE WHEN l.l_returnflag NOT IN ('R', 'A') THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS worked,
    SUM(CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS overtime,
    SUM(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS vacation
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_shipdate >= TIMESTAMP '1996-01-01' AND l.l_shipdate < TIMESTAMP '1997-01-01'
  GROUP BY o.o_custkey),
sess AS (
  SELECT o_custkey AS custkey,
         array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS sessions
  FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
  GROUP BY o_custkey)
SELECT c.c_custkey AS employee_id, c.c_name AS full_name,
       CAST(COALESCE(l.worked, 0) AS DOUBLE) AS worked_hours,
       CAST(COALESCE(l.overtime, 0) AS DOUBLE) AS overtime_hours,
       CAST(COALESCE(l.vacation, 0) AS DOUBLE) AS vacation_hours,
       COALESCE(s.sessions, '') AS sessions
FROM customer c
LEFT JOIN lines l ON l.custkey = c.c_custkey
LEFT JOIN sess s ON s.custkey = c.c_custkey
"""


@query("activity_report", ACTIVITY_SQL)
def activity_report(spark, sf):
    return activity_frame(Tables(spark, sf), *YEAR)


@query("date_dimension", """
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_id, strftime(d, '%Y-%m-%d') AS full_date,
       CAST(day(d) AS BIGINT) AS day, CAST(month(d) AS BIGINT) AS month, CAST(year(d) AS BIGINT) AS year,
       dayname(d) AS day_of_week, CASE WHEN isodow(d) IN (6, 7) THEN 'Y' ELSE 'N' END AS is_weekend
FROM (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders) b) g
""")
def date_dimension_q(spark, sf):
    t = Tables(spark, sf)
    bounds = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("s"), F.max(F.to_date("o_orderdate")).alias("e"))
    dim = date_dimension(bounds, "s", "e")
    return dim.select("date_id", day_text("full_date").alias("full_date"),
                      *[c(x).cast("long").alias(x) for x in ("day", "month", "year")],
                      "day_of_week", "is_weekend")


@query("cross_calendar", """
SELECT t.c_custkey AS employee_id, t.c_mktsegment AS unit, strftime(d, '%Y-%m-%d') AS work_date,
       CAST(8.0 AS DOUBLE) AS worked_hours, 'PRJ-BENCH' AS project, 'R' AS code
FROM (SELECT c_custkey, c_mktsegment,
             ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn
      FROM customer) t,
     (SELECT CAST(unnest(generate_series(DATE '1996-06-01', DATE '1996-07-31', INTERVAL 1 DAY)) AS DATE) AS d) days
WHERE t.rn <= 5
""")
def cross_calendar(spark, sf):
    t = Tables(spark, sf)
    top = windows.top_k_per_group(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"),
                                  ["c_mktsegment"], [c("c_acctbal").desc(), c("c_custkey")], 5)
    days = joins.calendar_rows(top, "1996-06-01", "1996-07-31", "d")
    return days.select(c("c_custkey").alias("employee_id"), c("c_mktsegment").alias("unit"),
                       day_text("d").alias("work_date"), F.lit(8.0).cast("double").alias("worked_hours"),
                       F.lit("PRJ-BENCH").alias("project"), F.lit("R").alias("code"))


@query("top_k_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS BIGINT) AS rn
FROM (SELECT o_custkey, o_orderkey, o_totalprice,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
      FROM orders) t
WHERE rn <= 5
""")
def top_k_per_group(spark, sf):
    t = Tables(spark, sf)
    top = windows.top_k_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"),
                                  ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")], 5, rank_col="rn")
    return top.withColumn("rn", c("rn").cast("long"))


@query("assign_keys", """
SELECT p_partkey,
       CAST(ROW_NUMBER() OVER (ORDER BY p_name, p_partkey)
            + (SELECT COALESCE(MAX(p_partkey), 0) FROM part WHERE p_size <= 25) AS BIGINT) AS new_id
FROM part WHERE p_size > 25
""")
def assign_keys_q(spark, sf):
    t = Tables(spark, sf)
    stored = t.part.where(c("p_size") <= 25)
    base = windows.next_key(stored, "p_partkey").scalar()
    incoming = t.part.where(c("p_size") > 25).select("p_partkey", "p_name")
    keyed = windows.assign_keys(incoming, ["p_name", "p_partkey"], "new_id", start_after=base)
    return keyed.select("p_partkey", "new_id")


@query("insert_new", """
SELECT p_partkey, p_name, p_brand
FROM (SELECT p_partkey, p_name, p_brand,
             ROW_NUMBER() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn
      FROM part WHERE p_size > 25) i
WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM part s WHERE s.p_size <= 25
                  AND s.p_name IS NOT DISTINCT FROM i.p_name AND s.p_brand IS NOT DISTINCT FROM i.p_brand)
""")
def insert_new_q(spark, sf):
    t = Tables(spark, sf)
    stored = t.part.where(c("p_size") <= 25).select("p_name", "p_brand")
    incoming = t.part.where(c("p_size") > 25).select("p_partkey", "p_name", "p_brand")
    return joins.insert_new(stored, incoming, ["p_name", "p_brand"], ["p_partkey"])


def _resolve(spark, sf):
    t = Tables(spark, sf)
    europe = t.region.where(c("r_name") == "EUROPE").select("r_regionkey")
    nations = t.nation.join(europe, c("n_regionkey") == c("r_regionkey")).select("n_nationkey")
    cust = t.customer.join(nations, c("c_nationkey") == c("n_nationkey"), "left_semi").select("c_custkey")
    dim_cust = windows.assign_keys(cust, ["c_custkey"], "cust_sk")
    dim_date = (t.orders.where(ts_range("o_orderdate", "1995-01-01", "2000-01-01"))
                .select(F.to_date("o_orderdate").alias("d")).distinct()
                .withColumn("date_id", F.date_format("d", "yyyyMMdd").cast("long")))
    prios = t.orders.where(c("o_orderpriority") != "5-LOW").select("o_orderpriority").distinct()
    dim_prio = windows.global_rank(prios, ["o_orderpriority"], "dense_rank", "priority_id")
    fact = t.orders.select("o_orderkey", c("o_custkey").alias("c_custkey"),
                           F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    return joins.resolve_keys(fact, [(dim_cust, ["c_custkey"], "cust_sk"),
                                     (dim_date, ["d"], "date_id"),
                                     (dim_prio, ["o_orderpriority"], "priority_id")])


_RESOLVE_DIMS = """
WITH dc AS (SELECT c.c_custkey, ROW_NUMBER() OVER (ORDER BY c.c_custkey) AS cust_sk
            FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
            JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE'),
dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders
       WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'),
dp AS (SELECT o_orderpriority, DENSE_RANK() OVER (ORDER BY o_orderpriority) AS priority_id
       FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW') x)
"""


@query("resolve_keys", _RESOLVE_DIMS + """
SELECT o.o_orderkey, CAST(dc.cust_sk AS BIGINT) AS cust_sk,
       CAST(strftime(dd.d, '%Y%m%d') AS BIGINT) AS date_id, CAST(dp.priority_id AS BIGINT) AS priority_id
FROM orders o
JOIN dc ON o.o_custkey = dc.c_custkey
JOIN dd ON CAST(o.o_orderdate AS DATE) = dd.d
JOIN dp ON o.o_orderpriority = dp.o_orderpriority
""")
def resolve_keys_q(spark, sf):
    resolved, _ = _resolve(spark, sf)
    return resolved.select("o_orderkey", "cust_sk", "date_id", "priority_id")


@query("resolve_rejects", _RESOLVE_DIMS + """
SELECT o.o_orderkey,
       CASE WHEN dc.cust_sk IS NULL THEN 'no cust_sk'
            WHEN dd.d IS NULL THEN 'no date_id'
            ELSE 'no priority_id' END AS reject_reason
FROM orders o
LEFT JOIN dc ON o.o_custkey = dc.c_custkey
LEFT JOIN dd ON CAST(o.o_orderdate AS DATE) = dd.d
LEFT JOIN dp ON o.o_orderpriority = dp.o_orderpriority
WHERE dc.cust_sk IS NULL OR dd.d IS NULL OR dp.priority_id IS NULL
""")
def resolve_rejects_q(spark, sf):
    _, rejected = _resolve(spark, sf)
    return rejected.select("o_orderkey", "reject_reason")


@query("left_lookup_last", """
SELECT c.c_custkey AS employee_id, e.event_type AS last_event_type,
       strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS last_event_ts
FROM customer c
LEFT JOIN (SELECT user_id, event_type, ts,
                  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
           FROM events) e
  ON e.user_id = c.c_custkey AND e.rn = 1
""")
def left_lookup_last(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.select(c("user_id").alias("c_custkey"), "event_type", "ts", "event_id")
    looked = joins.left_lookup(t.customer.select("c_custkey"), ev, ["c_custkey"],
                               F.struct("ts", "event_id"), ["event_type", "ts"])
    return looked.select(c("c_custkey").alias("employee_id"), c("event_type").alias("last_event_type"),
                         ts_text("ts").alias("last_event_ts"))


@query("seed_dimension", """
WITH derived AS (SELECT DISTINCT event_type AS code FROM events WHERE event_type IS NOT NULL),
codes AS (
  SELECT code, upper(substr(code, 1, 1)) || lower(substr(code, 2)) AS description FROM derived
  UNION ALL
  SELECT v.code, v.description FROM (VALUES ('S', 'Sick'), ('R', 'Regular'), ('OVT', 'Overtime')) v(code, description)
  WHERE v.code NOT IN (SELECT code FROM derived))
SELECT CAST(ROW_NUMBER() OVER (ORDER BY code) AS BIGINT) AS code_id, code, description FROM codes
""")
def seed_dimension_q(spark, sf):
    t = Tables(spark, sf)
    derived = (agg.distinct_rows(t.events, ["event_type"])
               .select(c("event_type").alias("code"), F.initcap("event_type").alias("description")))
    fixed = spark.createDataFrame([("S", "Sick"), ("R", "Regular"), ("OVT", "Overtime")],
                                  "code string, description string")
    empty = spark.createDataFrame([], "code_id long, code string, description string")
    return seed_dimension(empty, derived, fixed, "code", "code_id")
