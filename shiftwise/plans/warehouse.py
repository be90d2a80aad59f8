"""Driver queries for warehouse maintenance (section 2.7): SCD2, upserts, audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.functions.scalars import divide_error, module_label, safe_divide
from shiftwise.operators import warehouse as wh
from shiftwise.operators.windows import assign_keys
from shiftwise.plans.common import c, money, ts_text
from shiftwise.plans.registry import query
from shiftwise.sources.tables import Tables

SCD_ATTRS = ["c_name", "c_nationkey", "c_mktsegment"]


@query("scd2_apply", """
WITH hist AS (
  SELECT c_custkey + 1 AS history_id, c_custkey, c_name, c_nationkey, c_mktsegment,
         TIMESTAMP '1995-01-01 00:00:00' AS start_ts, CAST(NULL AS TIMESTAMP) AS end_ts, 'Y' AS is_active
  FROM customer WHERE c_nationkey <> 0),
snap AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment
  FROM customer),
cmp AS (
  SELECT s.*, CASE WHEN h.history_id IS NULL THEN 'new'
                   WHEN s.c_name IS DISTINCT FROM h.c_name OR s.c_nationkey IS DISTINCT FROM h.c_nationkey
                        OR s.c_mktsegment IS DISTINCT FROM h.c_mktsegment THEN 'changed'
                   ELSE 'same' END AS status
  FROM snap s LEFT JOIN (SELECT * FROM hist WHERE is_active = 'Y') h ON s.c_custkey = h.c_custkey),
res AS (
  SELECT h.history_id, h.c_custkey, h.c_name, h.c_nationkey, h.c_mktsegment, h.start_ts,
         CASE WHEN x.c_custkey IS NOT NULL AND h.is_active = 'Y' THEN TIMESTAMP '1996-01-01 00:00:00'
              ELSE h.end_ts END AS end_ts,
         CASE WHEN x.c_custkey IS NOT NULL AND h.is_active = 'Y' THEN 'N' ELSE h.is_active END AS is_active
  FROM hist h LEFT JOIN (SELECT c_custkey FROM cmp WHERE status = 'changed') x ON h.c_custkey = x.c_custkey
  UNION ALL
  SELECT (SELECT COALESCE(MAX(history_id), 0) FROM hist) + ROW_NUMBER() OVER (ORDER BY c_custkey),
         c_custkey, c_name, c_nationkey, c_mktsegment, TIMESTAMP '1996-01-01 00:00:00', CAST(NULL AS TIMESTAMP), 'Y'
  FROM cmp WHERE status IN ('new', 'changed'))
SELECT CAST(history_id AS BIGINT) AS history_id, c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       c_mktsegment, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
       strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, is_active
FROM res
""")
def scd2_apply_q(spark, sf):
    t = Tables(spark, sf)
    cust = t.customer
    history = cust.where(c("c_nationkey") != 0).select(
        (c("c_custkey") + 1).alias("history_id"), "c_custkey", *SCD_ATTRS,
        F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("start_ts"),
        F.lit(None).cast("timestamp_ntz").alias("end_ts"), F.lit("Y").alias("is_active"))
    snapshot = cust.select("c_custkey", "c_name", "c_nationkey",
                           F.when(c("c_acctbal") < 0, "DEBTOR").otherwise(c("c_mktsegment")).alias("c_mktsegment"))
    res = wh.scd2_apply(history, snapshot, ["c_custkey"], SCD_ATTRS, "1996-01-01 00:00:00")
    return res.select(c("history_id").cast("long").alias("history_id"), "c_custkey", "c_name",
                      c("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment",
                      ts_text("start_ts").alias("start_ts"), ts_text("end_ts").alias("end_ts"), "is_active")


@query("scd2_versions", """
WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment, TIMESTAMP '1995-01-01 00:00:00' AS ts FROM customer WHERE c_nationkey <> 0),
s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment, TIMESTAMP '1996-01-01 00:00:00' AS ts FROM customer
  UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_nationkey END, c_mktsegment, TIMESTAMP '1997-01-01 00:00:00' FROM customer WHERE c_mktsegment <> 'BUILDING'),
u AS (SELECT *, true AS stored FROM a UNION ALL SELECT *, false FROM s),
g AS (SELECT *, lag(ROW(c_nationkey, c_mktsegment)) OVER (PARTITION BY c_custkey ORDER BY ts) AS old FROM u),
k AS (SELECT * FROM g WHERE old IS NULL OR old IS DISTINCT FROM ROW(c_nationkey, c_mktsegment))
SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, strftime(ts, '%Y-%m-%d') AS start_day,
       strftime(lead(ts) OVER (PARTITION BY c_custkey ORDER BY ts), '%Y-%m-%d') AS end_day, stored FROM k
""")
def scd2_versions_q(spark, sf):
    """D1 for two snapshots at once."""
    cust = Tables(spark, sf).customer
    day = lambda x: F.lit(f"{x} 00:00:00").cast("timestamp_ntz")
    active = cust.where(c("c_nationkey") != 0).select("c_custkey", "c_nationkey", "c_mktsegment", day("1995-01-01").alias("start_ts"))
    first = cust.select("c_custkey", "c_nationkey", F.when(c("c_acctbal") < 0, "DEBTOR").otherwise(c("c_mktsegment")).alias("c_mktsegment"), day("1996-01-01").alias("at"))
    second = cust.where(c("c_mktsegment") != "BUILDING").select("c_custkey", F.when(c("c_acctbal") <= 5000, c("c_nationkey")).alias("c_nationkey"), "c_mktsegment", day("1997-01-01").alias("at"))
    res = wh.scd2_versions(active, first.unionByName(second), ["c_custkey"], ["c_nationkey", "c_mktsegment"], "at")
    return res.select("c_custkey", c("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment", F.date_format("start_ts", "yyyy-MM-dd").alias("start_day"),
                      F.date_format("end_ts", "yyyy-MM-dd").alias("end_day"), "stored")


@query("upsert", """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_mktsegment <> 'BUILDING'
  AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
UNION ALL
SELECT c_custkey, c_name, c_acctbal + 100 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def upsert_q(spark, sf):
    cust = Tables(spark, sf).customer
    current = cust.where(c("c_mktsegment") != "BUILDING").select("c_custkey", "c_name", "c_acctbal")
    incoming = (cust.where(c("c_mktsegment").isin("BUILDING", "MACHINERY"))
                .select("c_custkey", "c_name", (c("c_acctbal") + 100).alias("c_acctbal")))
    return wh.upsert(current, incoming, ["c_custkey"])


@query("partial_update", """
SELECT s.s_suppkey, COALESCE(p.s_name, s.s_name) AS s_name,
       CAST(COALESCE(p.s_nationkey, s.s_nationkey) AS BIGINT) AS s_nationkey,
       COALESCE(p.s_acctbal, s.s_acctbal) AS s_acctbal
FROM supplier s
LEFT JOIN (SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_name, 0 AS s_nationkey, CAST(0.0 AS DOUBLE) AS s_acctbal
           FROM supplier WHERE s_acctbal < 0) p ON s.s_suppkey = p.s_suppkey
""")
def partial_update_q(spark, sf):
    sup = Tables(spark, sf).supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    patch = sup.where(c("s_acctbal") < 0).select(
        "s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0).alias("s_nationkey"),
        F.lit(0.0).alias("s_acctbal"))
    res = wh.partial_update(sup, patch, ["s_suppkey"])
    return res.withColumn("s_nationkey", c("s_nationkey").cast("long"))


def _tags(labels, with_quality=True):
    tags = F.array(F.lit("labelled"), F.when(c("quality") == 1, F.lit("quality")),
                   F.when(c("toxic") == 1, F.lit("toxic")))
    return labels.select("doc_id", F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("tag"))


@query("replace_set", """
WITH cur AS (
  SELECT doc_id, 'labelled' AS tag FROM labels
  UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
inc AS (
  SELECT doc_id, 'reviewed' AS tag FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'reviewed' FROM labels WHERE toxic = 1)
SELECT doc_id, tag FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM inc)
UNION ALL
SELECT DISTINCT doc_id, tag FROM inc
""")
def replace_set_q(spark, sf):
    labels = Tables(spark, sf).labels
    current = _tags(labels)
    toxic = labels.where(c("toxic") == 1)
    incoming = toxic.select("doc_id", F.explode(F.array(F.lit("reviewed"), F.lit("toxic"), F.lit("reviewed")))
                            .alias("tag"))
    return wh.replace_set(current, incoming, ["doc_id"])


@query("insert_unique", """
WITH RECURSIVE inc AS (
  SELECT c_custkey, lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey % 11 AS VARCHAR) AS username,
         'supplier#' || lpad(CAST(c_custkey % 450 AS VARCHAR), 9, '0') || '@corp.test' AS email,
         ROW_NUMBER() OVER (ORDER BY c_custkey) AS rn
  FROM customer),
cur AS (SELECT list('u' || CAST(s_nationkey AS VARCHAR)) AS users, list(lower(s_name) || '@corp.test') AS mails FROM supplier),
s AS (
  SELECT CAST(0 AS BIGINT) AS rn, users, mails, CAST(NULL AS VARCHAR) AS reason FROM cur
  UNION ALL
  SELECT inc.rn, CASE WHEN x.reason IS NULL THEN list_append(s.users, inc.username) ELSE s.users END,
         CASE WHEN x.reason IS NULL THEN list_append(s.mails, inc.email) ELSE s.mails END, x.reason
  FROM s JOIN inc ON inc.rn = s.rn + 1,
       LATERAL (SELECT CASE WHEN list_contains(s.users, inc.username) THEN 'username taken'
                            WHEN list_contains(s.mails, inc.email) THEN 'email taken' END AS reason) x)
SELECT c_custkey, username, email, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason
FROM inc JOIN s ON s.rn = inc.rn
""")
def insert_unique_q(spark, sf):
    t = Tables(spark, sf)
    incoming = t.customer.select(
        "c_custkey",
        F.concat(F.lower("c_mktsegment"), c("c_nationkey").cast("string"), F.lit("-"),
                 (c("c_custkey") % 11).cast("string")).alias("username"),
        F.concat(F.lit("supplier#"), F.lpad((c("c_custkey") % 450).cast("string"), 9, "0"),
                 F.lit("@corp.test")).alias("email"))
    current = t.supplier.select(F.concat(F.lit("u"), c("s_nationkey").cast("string")).alias("username"),
                                F.concat(F.lower("s_name"), F.lit("@corp.test")).alias("email"))
    return wh.insert_unique(current, incoming, ["username", "email"], ["c_custkey"])


@query("delete_by_key", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders
                         WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')
""")
def delete_by_key_q(spark, sf):
    orders = Tables(spark, sf).orders
    keys = orders.where((c("o_orderstatus") == "F") &
                        (c("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")
    return wh.delete_by_key(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), keys, ["o_orderkey"])


@query("ensure_rows", """
WITH d AS (SELECT CAST(n_nationkey * 5 AS BIGINT) AS s_suppkey, 'Contact ' || n_name AS s_name,
                  n_nationkey AS s_nationkey, CAST(0.0 AS DOUBLE) AS s_acctbal FROM nation)
SELECT s.s_suppkey, s.s_name, CAST(COALESCE(d.s_nationkey, s.s_nationkey) AS BIGINT) AS s_nationkey, s.s_acctbal
FROM supplier s LEFT JOIN d ON s.s_suppkey = d.s_suppkey
UNION ALL
SELECT d.s_suppkey, d.s_name, CAST(d.s_nationkey AS BIGINT), d.s_acctbal FROM d
WHERE d.s_suppkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def ensure_rows_q(spark, sf):
    t = Tables(spark, sf)
    current = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    defaults = t.nation.select((c("n_nationkey") * 5).cast("long").alias("s_suppkey"),
                               F.concat(F.lit("Contact "), c("n_name")).alias("s_name"),
                               c("n_nationkey").alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    res = wh.ensure_rows(current, defaults, ["s_suppkey"], ["s_nationkey"])
    return res.withColumn("s_nationkey", c("s_nationkey").cast("long"))


def _adjusted(t: Tables):
    nations = t.nation.select("n_nationkey", "n_regionkey")
    base = t.supplier.join(nations, c("s_nationkey") == c("n_nationkey")).select(
        "s_suppkey", c("s_acctbal").cast("decimal(12,2)").alias("salary"),
        F.when(c("n_regionkey") == 0, F.lit(None)).otherwise(c("n_regionkey") * F.lit(0.05))
        .cast("decimal(4,2)").alias("commission_pct"))
    return wh.adjust_salary(base, "salary", "commission_pct")


_ADJ_SQL = """
SELECT s.s_suppkey, CAST(s.s_acctbal AS DECIMAL(12,2)) AS old,
       CASE WHEN n.n_regionkey = 0 THEN NULL ELSE CAST(n.n_regionkey * 0.05 AS DECIMAL(4,2)) END AS com,
       CAST(ROUND(CAST(s.s_acctbal AS DECIMAL(12,2)) *
             CASE WHEN n.n_regionkey = 0 THEN CAST(1.02 AS DECIMAL(4,2))
                  ELSE CAST(1 + n.n_regionkey * 0.05 AS DECIMAL(4,2)) END, 2) AS DECIMAL(12,2)) AS new,
       CASE WHEN n.n_regionkey = 0 THEN 'DEFAULT' ELSE 'COMMISSION' END AS branch
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
"""


@query("adjust_salary", f"""
SELECT s_suppkey, CAST(old AS DOUBLE) AS old_salary, CAST(com AS DOUBLE) AS commission_pct,
       CAST(new AS DOUBLE) AS new_salary, branch
FROM ({_ADJ_SQL}) a
""")
def adjust_salary_q(spark, sf):
    adj = _adjusted(Tables(spark, sf))
    return adj.select("s_suppkey", money("salary").alias("old_salary"),
                      money("commission_pct").alias("commission_pct"),
                      money("new_salary").alias("new_salary"), "branch")


LOG_TIME = "2025-06-05 12:00:00"


def _number_sql(x: str) -> str:
    text = f"CAST({x} AS VARCHAR)"
    text = f"CASE WHEN strpos({text}, '.') > 0 THEN regexp_replace(regexp_replace({text}, '0+$', ''), '[.]$', '') ELSE {text} END"
    return f"CASE WHEN {text} = '0' THEN '0' ELSE regexp_replace({text}, '^(-?)0[.]', '\\1.') END"


_LABEL_SQL = "'[Package] --> HR_MANAGEMENT    [PROCEDURE] --> ADJUST_SALARIES_BY_COMMISSION'"


def _audit_sql(debug: bool) -> str:
    rows = f"""
WITH adj AS (SELECT a.*, ROW_NUMBER() OVER (ORDER BY s_suppkey) AS seq FROM ({_ADJ_SQL}) a),
body AS (
  SELECT 4 * seq - 2 AS log_id, 2 AS line_no, 'DEBUG' AS log_level, '[VAR] EMP_ID = ' || CAST(s_suppkey AS VARCHAR) AS log_message FROM adj
  UNION ALL SELECT 4 * seq - 1, 3, 'DEBUG', '[VAR] OLD_SALARY = ' || {_number_sql('old')} FROM adj
  UNION ALL SELECT 4 * seq, 4, CASE WHEN com IS NULL THEN 'WARNING' ELSE 'DEBUG' END,
         CASE WHEN com IS NULL THEN 'Commission_pct NULL, applied default 2%' ELSE 'Commission_pct found: ' || {_number_sql('com')} END FROM adj
  UNION ALL SELECT 4 * seq + 1, 5, 'DEBUG', 'Updated SALARY -> ' || {_number_sql('new')} FROM adj
  UNION ALL SELECT 1, 1, 'INFO', '>>> START HR_MANAGEMENT'
  UNION ALL SELECT (SELECT COUNT(*) FROM adj) * 4 + 2, 6, 'INFO', '<<< END HR_MANAGEMENT'),
err AS (SELECT s_suppkey AS log_id, 7 AS line_no, 'ERROR' AS log_level,
               'Code = [-1476] > ORA-01476: divisor is equal to zero' AS log_message
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 0),
log AS (SELECT *, {_LABEL_SQL} AS module_name FROM body
        UNION ALL SELECT *, '[Package] --> HR_MANAGEMENT    [Function] --> TEST_ERROR_LOGGING' FROM err)
SELECT CAST(log_id AS BIGINT) AS log_id, '{LOG_TIME}' AS log_time, module_name, CAST(line_no AS BIGINT) AS line_no, log_level, log_message FROM log
"""
    return rows if debug else rows + "WHERE log_level = 'ERROR'"


def _audit(spark, sf, debug: bool):
    """Salary audit, and the errors of a division (by the region's number) that fails for some suppliers."""
    t = Tables(spark, sf)
    adj = _adjusted(t)
    body = wh.audit_rows(assign_keys(adj, ["s_suppkey"], "seq"), "s_suppkey", "salary", "commission_pct", "new_salary", "seq", LOG_TIME)
    log = wh.bracket_log(body, adj.agg(F.count(F.lit(1))).scalar(), LOG_TIME)
    parts = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).withColumn("share", safe_divide("s_acctbal", "n_regionkey"))
    failed = parts.where(c("share").isNull() & divide_error("n_regionkey").isNotNull())
    errors = wh.error_rows(failed, "s_suppkey", "HR_MANAGEMENT.TEST_ERROR_LOGGING", "HR_MANAGEMENT", "FUNCTION", LOG_TIME)
    return wh.filter_log(log.unionByName(errors), debug).withColumn("log_time", F.date_format("log_time", "yyyy-MM-dd HH:mm:ss"))


@query("audit_log", _audit_sql(True))
def audit_log_q(spark, sf):
    return _audit(spark, sf, True)


@query("audit_log_quiet", _audit_sql(False))
def audit_log_quiet_q(spark, sf):
    return _audit(spark, sf, False)


@query("module_label", """
SELECT p_partkey, CASE p_partkey % 4
  WHEN 0 THEN 'Stored PROCEDURE: ' || upper(p_brand)
  WHEN 1 THEN '[Package] --> ' || p_brand || '    [Function] --> ' || p_type
  WHEN 2 THEN '[Package] --> ' || p_brand || '    [PROCEDURE] --> ' || p_type
  ELSE 'No package; No procedure; No function. Check anonymous PL/SQL blocks.' END AS label
FROM part
""")
def module_label_q(spark, sf):
    """P15 over made-up units of the parts: stored, function, procedure, anonymous."""
    part, kind = Tables(spark, sf).part, c("p_partkey") % 4
    unit = F.when(kind == 0, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit("."), c("p_type")))
    what = F.when(kind == 1, "function").when(kind != 3, "PROCEDURE")
    return part.select("p_partkey", module_label(unit, c("p_brand"), what).alias("label"))
