"""Report lines (R1, R2, R4, S11), the day window with the hour rules (Q6, Q11), embedding prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.functions import scalars as sc
from shiftwise.operators import quality as qc
from shiftwise.operators import reports
from shiftwise.plans.common import c, day_text, money, ts_range
from shiftwise.plans.quality import _RULES_SQL, LINE_ORDER, _candidates
from shiftwise.plans.registry import query
from shiftwise.plans.relational import ACTIVITY_SQL, YEAR, activity_frame
from shiftwise.plans.relational import session_details as session_frame
from shiftwise.sources.tables import Tables


@query("missed_report", """
WITH s AS (SELECT CAST(m AS BIGINT) AS m, '1996-' || lpad(CAST(m AS VARCHAR), 2, '0') AS month, 'Training ' || CAST(m AS VARCHAR) AS session FROM range(1, 14) t(m)),
attended AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
reasons AS (SELECT DISTINCT o.o_custkey AS custkey, strftime(l.l_shipdate, '%Y-%m') AS month, l.l_returnflag AS code, 'line of ' || strftime(l.l_shipdate, '%Y-%m') AS description
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
            WHERE l.l_returnflag IN ('R', 'A') AND l.l_shipdate >= TIMESTAMP '1996-01-01' AND l.l_shipdate < TIMESTAMP '1997-01-01'),
missed AS (SELECT s.session, c.c_name AS name, r.code, r.description FROM s JOIN reasons r ON r.month = s.month JOIN customer c ON c.c_custkey = r.custkey AND c.c_acctbal > 0
           WHERE NOT EXISTS (SELECT 1 FROM attended a WHERE a.o_custkey = c.c_custkey AND a.month = s.month)),
n AS (SELECT session, CAST(4 + ROW_NUMBER() OVER (PARTITION BY session ORDER BY name, code, description) AS BIGINT) AS line_no,
             rpad(name, CAST(greatest(30, length(name)) AS INTEGER), ' ') || '  ' || rpad(code, CAST(greatest(4, length(code)) AS INTEGER), ' ') || '  ' || description AS line FROM missed)
SELECT * FROM n
UNION ALL SELECT session, CAST(1 AS BIGINT), 'Training “' || session || '”' FROM s UNION ALL SELECT session, CAST(2 AS BIGINT), '' FROM s
UNION ALL SELECT session, CAST(3 AS BIGINT), CASE WHEN session IN (SELECT session FROM missed) THEN rpad('Employee', 30, ' ') || '       Code            Reason' ELSE 'No employee missed the training' END FROM s
UNION ALL SELECT session, CAST(4 AS BIGINT), repeat('-', 70) FROM s WHERE session IN (SELECT session FROM missed)
""")
def missed_report_q(spark, sf):
    """R1 as lines: thirteen monthly sessions (the last one of no month); who placed no order in the month and has a returned or accepted line in it."""
    t = Tables(spark, sf)
    month = lambda col: F.date_format(col, "yyyy-MM")
    sessions = spark.range(1, 14).select(F.concat(F.lit("Training "), c("id").cast("string")).alias("session"), F.concat(F.lit("1996-"), F.lpad(c("id").cast("string"), 2, "0")).alias("month"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    attended = orders.where(ts_range("o_orderdate", *YEAR)).select(c("o_custkey").alias("person"), month("o_orderdate").alias("month")).distinct()
    lines = t.lineitem.where(c("l_returnflag").isin("R", "A") & ts_range("l_shipdate", *YEAR)).select("l_orderkey", "l_returnflag", month("l_shipdate").alias("month"))
    reasons = lines.join(orders, c("l_orderkey") == c("o_orderkey")).select(
        c("o_custkey").alias("person"), "month", c("l_returnflag").alias("code"), F.concat(F.lit("line of "), c("month")).alias("description")).distinct()
    people = t.customer.where(c("c_acctbal") > 0).select(c("c_custkey").alias("person"), c("c_name").alias("name"))
    missed = reasons.join(attended, ["person", "month"], "left_anti").join(people, "person").join(sessions, "month")
    return reports.missed_lines(sessions, missed.select("session", "name", "code", "description"), "session")


@query("session_lines", """
WITH s AS (SELECT event_type || ' ' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS session_name, CAST(ts AS DATE) AS day, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE)),
l AS (SELECT session_name, [repeat(' ', 28) || '~ ' || session_name || ' ~', '', 'Data: ' || upper(strftime(day, '%d-%b-%y')), 'Inceput la ora: ' || strftime(t0, '%H:%M:%S'),
      'Finalizat la ora: ' || strftime(t1, '%H:%M:%S'), 'Numar participanti: ' || CAST(n AS VARCHAR)] AS lines FROM s)
SELECT session_name, CAST(unnest(range(1, 7)) AS BIGINT) AS line_no, unnest(lines) AS line FROM l
""")
def session_lines_q(spark, sf):
    """R2 as lines."""
    s = session_frame(spark, sf)
    out = reports.session_lines(s, "session_name", "session_date", "start_time", "end_time", "participants")
    return out.select("session_name", c("line_no").cast("long").alias("line_no"), "line")


_MISSED_SQL = """
SELECT DISTINCT o.o_custkey AS custkey, 'Training ' || strftime(l.l_shipdate, '%Y-%m') AS session, l.l_returnflag AS code
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag IN ('R', 'A') AND l.l_shipdate >= TIMESTAMP '1996-01-01' AND l.l_shipdate < TIMESTAMP '1997-01-01' AND day(l.l_shipdate) = 1
"""


@query("activity_lines", f"""
WITH a AS ({ACTIVITY_SQL}), m AS ({_MISSED_SQL}),
g AS (SELECT custkey, list('A lipsit de la trainingul ' || session || ' din motivul că a avut codul ' || code || '.' ORDER BY session, code) AS missed FROM m GROUP BY custkey),
l AS (SELECT employee_id, list_concat([full_name, 'A înregistrat în perioada 1996-01-01 - 1996-12-31 ' || CAST(CAST(worked_hours AS BIGINT) AS VARCHAR) || ' ore.'],
        CASE WHEN overtime_hours > 0 THEN ['A avut ore suplimentare în numar de: ' || CAST(CAST(overtime_hours AS BIGINT) AS VARCHAR) || ' ore.'] ELSE [] END,
        CASE WHEN vacation_hours > 0 THEN ['A avut concediu în numar de: ' || CAST(CAST(vacation_hours AS BIGINT) AS VARCHAR) || ' ore.'] ELSE [] END,
        CASE WHEN sessions <> '' THEN list_concat(['A participat la trainingurile:'], list_transform(string_split(sessions, '; '), lambda x: '• ' || x)) ELSE [] END, coalesce(g.missed, [])) AS lines
      FROM a LEFT JOIN g ON g.custkey = a.employee_id)
SELECT employee_id, CAST(unnest(range(1, len(lines) + 1)) AS BIGINT) AS line_no, unnest(lines) AS line FROM l
""")
def activity_lines_q(spark, sf):
    """R4 as lines, with the trainings missed: one on the first of each month, absences are returned or accepted lines of that day."""
    t = Tables(spark, sf)
    lines = t.lineitem.where(c("l_returnflag").isin("R", "A") & ts_range("l_shipdate", *YEAR)).select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("day"))
    absences = lines.join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("employee_id"), "day", c("l_returnflag").alias("code"))
    days = spark.range(1, 13).select(F.make_date(F.lit(1996), c("id").cast("int"), F.lit(1)).alias("day"))
    sessions = days.select("day", F.concat(F.lit("Training "), F.date_format("day", "yyyy-MM")).alias("session"))
    missed = reports.missed_trainings(sessions, absences, "employee_id", "day", "session", "code")
    activity = activity_frame(t, *YEAR).withColumns({x: c(x).cast("long") for x in ("worked_hours", "overtime_hours", "vacation_hours")})
    out = reports.activity_lines(activity, missed, "employee_id", "full_name", "1996-01-01", "1996-12-31")
    return out.select("employee_id", c("line_no").cast("long").alias("line_no"), "line")


def _window_sql() -> str:
    """The rules' SQL with the day window as the first rule."""
    text = _RULES_SQL.format(cumul="existing_hours + hours > daily_limit")
    outside = "(CAST(l_shipdate AS DATE) < DATE '1996-06-23' OR CAST(l_shipdate AS DATE) > DATE '1998-06-23')"
    text = text.replace("CAST(CASE WHEN time_type = 'REG' AND hours > daily_limit THEN 20001", f"{outside} AS outside, CAST(CASE WHEN {outside} OR (time_type = 'REG' AND hours > daily_limit) THEN 20001")
    return text.replace("CASE error_code\n", "CASE WHEN outside THEN 'The day of work must be between today and the past 730 days' ELSE CASE error_code\n").replace("overtime per day' END AS message", "overtime per day' END END AS message")


@query("validate_timesheets", _window_sql())
def validate_timesheets_q(spark, sf):
    """Q11: the day window (Q6) comes first, then the hour rules."""
    checked = qc.timesheet_rules(_candidates(Tables(spark, sf)), group=["l_orderkey"], order=LINE_ORDER, hours="hours", time_type="time_type", limit="daily_limit",
                                 overtime_cap=30, day="l_shipdate", as_of="1998-06-23", window_days=730)
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "time_type", "hours", "daily_limit", "existing_hours", "error_code", "message")


@query("embedding_cost", """
SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(COALESCE(text, ''), '\\s+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens,
       CAST(ROUND(CAST(floor(len(list_filter(string_split_regex(COALESCE(text, ''), '\\s+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE)) AS DECIMAL(18,0)) * CAST(0.00000002 AS DECIMAL(16,12)), 6) AS DOUBLE) AS usd_cost
FROM documents
""")
def embedding_cost_q(spark, sf):
    """P22 with the price of embeddings."""
    docs = Tables(spark, sf).documents.select("doc_id", sc.estimate_tokens("text").alias("tokens"))
    return docs.select("doc_id", "tokens", money(sc.embedding_cost("tokens", "0.00002")).alias("usd_cost"))
