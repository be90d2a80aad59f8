"""Driver queries for parsers, labels, picks, checks and small set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.functions import scalars as sc
from shiftwise.operators import aggregates as agg
from shiftwise.operators import joins, quality, sets, windows
from shiftwise.plans.common import c, day_text, ts_text
from shiftwise.plans.registry import query
from shiftwise.sources.tables import Tables


@query("parse_dates", """
SELECT event_id, CAST(month(ts) AS BIGINT) AS month_no, CAST(month(ts) AS BIGINT) AS month_of_number,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed_ts, strftime(ts, '%Y-%m-%d') AS parsed_day,
       CASE WHEN day(ts) <= 28 THEN strftime(ts, '%Y-%m-%d') END AS made_day,
       upper(strftime(ts, '%d-%b-%y')) AS day_label, strftime(ts, '%H:%M:%S') AS clock,
       CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts)) AS BIGINT) AS seconds_of_day
FROM events
""")
def parse_dates_q(spark, sf):
    """Texts of the event times in each accepted format, parsed back."""
    ev = Tables(spark, sf).events.select("event_id", "ts")
    texts = ev.select(
        "event_id", "ts", F.concat(F.lit(" "), F.upper(F.date_format("ts", "MMMM"))).alias("month_name"), F.date_format("ts", "M").alias("month_text"),
        F.date_format("ts", "M/d/yy, h:mm:ss a").alias("ts_text"), F.upper(F.date_format("ts", "dd-MMM-yy")).alias("oracle_text"),
        # a day past the 28th of any month is offered to February
        F.when(F.dayofmonth("ts") <= 28, F.month("ts")).otherwise(2).alias("m"),
        F.when(F.dayofmonth("ts") <= 28, F.dayofmonth("ts")).otherwise(30).alias("d"))
    start = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return texts.select(
        "event_id", sc.month_number("month_name").cast("long").alias("month_no"), sc.month_number("month_text").cast("long").alias("month_of_number"),
        ts_text(sc.parse_ts("ts_text")).alias("parsed_ts"), day_text(sc.parse_oracle_date("oracle_text")).alias("parsed_day"),
        day_text(sc.make_day(F.year("ts"), "m", "d")).alias("made_day"), sc.oracle_day_label("ts").alias("day_label"), sc.clock_label("ts").alias("clock"),
        F.floor(F.extract(F.lit("SECOND"), sc.elapsed(start, F.date_trunc("second", "ts").cast("timestamp_ntz")))
                + 60 * F.extract(F.lit("MINUTE"), sc.elapsed(start, c("ts"))) + 3600 * F.extract(F.lit("HOUR"), sc.elapsed(start, c("ts")))).cast("long").alias("seconds_of_day"))


@query("names_and_codes", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_brand || ' ' || p_type END AS full_name, p_brand AS code,
       p_brand AS package, p_type AS module, p_type AS bare_module,
       'Title: ' || p_name || chr(10) || 'Themes: ' || p_brand || ', ' || p_type || chr(10) || 'Summary: ' || p_name AS document,
       'book_' || p_name AS document_id, CAST(CASE WHEN p_size IN (1, 5, 7) THEN 1 ELSE 0 END AS BIGINT) AS listed,
       CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END AS size_name
FROM part
""")
def names_and_codes_q(spark, sf):
    """P9, P13, P14, P24, P27, P29."""
    part = Tables(spark, sf).part.where(c("p_name").isNotNull())
    package, module = sc.split_qualified_name(F.concat("p_brand", F.lit("."), c("p_type")))
    _, bare = sc.split_qualified_name("p_type")
    return part.select(
        "p_partkey", sc.full_name("p_brand", F.when(c("p_size") % 3 != 0, c("p_type"))).alias("full_name"),
        sc.normalize_code(F.concat(F.lit(" "), c("p_brand"), F.lit("\t  "))).alias("code"), package.alias("package"), module.alias("module"), bare.alias("bare_module"),
        sc.render_document("p_name", F.array("p_brand", "p_type"), "p_name").alias("document"), sc.document_id("p_name").alias("document_id"),
        sc.in_list("p_size", [1, 5, 7]).cast("long").alias("listed"), sc.map_constant(c("p_size") % 3, {0: "small", 1: "large"}).alias("size_name"))


@query("orders_between", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'
""")
def orders_between_q(spark, sf):
    """An inclusive period."""
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate")
    return orders.where(sc.between_dates(c("o_orderdate").cast("date"), "1996-03-01", "1996-03-31")).select("o_orderkey", day_text("o_orderdate").alias("day"))


@query("lookup_people", """
WITH i AS (SELECT s_name AS identifier FROM supplier UNION SELECT c_name FROM customer UNION SELECT c_mktsegment || '@' || c_name FROM customer),
p AS (SELECT c_custkey, c_name, c_mktsegment || '@' || c_name AS mail FROM customer)
SELECT DISTINCT i.identifier, p.c_custkey FROM i JOIN p ON i.identifier = p.c_name OR i.identifier = p.mail
UNION ALL SELECT 'BUILDING@' || c_name, c_custkey FROM p WHERE mail = 'BUILDING@' || c_name
""")
def lookup_people_q(spark, sf):
    """People by any of their identifiers, for many identifiers at once and for one segment's addresses."""
    t = Tables(spark, sf)
    people = t.customer.select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit("@"), c("c_name")).alias("mail"))
    names = t.supplier.select(c("s_name").alias("ident")).union(people.select("c_name")).union(people.select("mail")).distinct()
    many = sc.lookup_many(people, ["c_name", "mail"], names, "ident", ["c_custkey"]).select("identifier", "c_custkey")
    asked = people.withColumn("asked", F.concat(F.lit("BUILDING@"), c("c_name")))
    return many.unionByName(asked.where(c("mail") == c("asked")).select(c("asked").alias("identifier"), "c_custkey"))


@query("log_loss_and_rows", """
SELECT (SELECT ROUND(AVG(-ln(GREATEST(LEAST(CAST(l_discount AS DOUBLE) * 8, 1 - 1e-15), 1e-15))), 6) FROM lineitem) AS log_loss,
       (SELECT COUNT(*) FROM lineitem) AS n
""")
def log_loss_q(spark, sf):
    """A9, A10."""
    lines = Tables(spark, sf).lineitem.select((c("l_discount") * 8).alias("p"))
    loss = agg.log_loss(lines, "p")
    return loss.select(F.round("log_loss", 6).alias("log_loss")).crossJoin(agg.row_count(lines))  # one row each


@query("picks", """
WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w, CAST(p_size % 4 AS BIGINT) AS n FROM part WHERE p_name IS NOT NULL)
SELECT p_partkey, CASE WHEN n >= 1 AND n <= len(w) THEN w[n] END AS picked,
       COALESCE(CASE WHEN n >= 1 AND n <= len(w) THEN w[n] END, w[1]) AS shown,
       array_to_string(list_distinct_ordered, '|') AS words
FROM a, LATERAL (SELECT list(v ORDER BY i) AS list_distinct_ordered FROM (SELECT v, MIN(i) AS i FROM (SELECT unnest(w || w) AS v, generate_subscripts(w || w, 1) AS i) u GROUP BY v) d) l
""")
def picks_q(spark, sf):
    """The n-th word of a name, else its first; the different words of a doubled list."""
    part = Tables(spark, sf).part.where(c("p_name").isNotNull()).select("p_partkey", F.split("p_name", " ").alias("w"), (c("p_size") % 4).alias("n"))
    picked = windows.pick_nth(c("w"), c("n"))
    return part.select("p_partkey", picked.alias("picked"), windows.first_or_fallback(picked, c("w")).alias("shown"),
                       F.array_join(sets.distinct_set(F.concat("w", "w")), "|").alias("words"))


@query("largest_orders", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def largest_orders_q(spark, sf):
    """The limit is the report."""
    return windows.ordered_limit(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"), [c("o_totalprice").desc(), "o_orderkey"], 100)


@query("running_before", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
       CAST(COALESCE(SUM(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before
FROM lineitem
""")
def running_before_q(spark, sf):
    """W4."""
    lines = Tables(spark, sf).lineitem.select("l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", c("l_quantity").cast("decimal(18,2)").alias("q"))
    out = windows.running_before(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "q", "before")
    return out.drop("q").withColumn("before", c("before").cast("double"))


@query("new_codes", """
WITH p AS (SELECT p_brand || ' ' || CAST(p_size AS VARCHAR) AS code, p_type FROM part)
SELECT DISTINCT code FROM p WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM p WHERE p_type < 'M' AND code IS NOT NULL)
""")
def new_codes_q(spark, sf):
    """U2."""
    part = Tables(spark, sf).part.select(F.concat("p_brand", F.lit(" "), c("p_size").cast("string")).alias("code"), "p_type").where(c("code").isNotNull())
    return sets.new_codes(part.select("code").distinct(), part.where(c("p_type") < "M").select("code").distinct(), "code")


@query("day_and_mail_checks", """
SELECT event_id, CAST(CASE WHEN CAST(ts AS DATE) < DATE '2024-01-08' OR CAST(ts AS DATE) > DATE '2024-01-15' THEN 1 ELSE 0 END AS BIGINT) AS outside_window,
       CAST(CASE WHEN event_type = 'error' OR user_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bad_mail
FROM events
""")
def day_and_mail_checks_q(spark, sf):
    """Q6, Q10: events outside the week before a day; made-up addresses, some without a domain or with a blank."""
    ev = Tables(spark, sf).events.select("event_id", "ts", "event_type", "user_id")
    ev = ev.withColumn("day", c("ts").cast("date")).withColumn(
        "mail", F.concat(c("event_type"), F.lit("."), c("user_id").cast("string"), F.when(c("event_type") == "error", F.lit("@host")).otherwise(F.lit("@mail.example.org")),
                         F.when(c("user_id") % 5 == 0, F.lit(" x")).otherwise(F.lit(""))))
    return ev.select("event_id", quality.outside_day_window("day", "2024-01-15", 7).cast("long").alias("outside_window"),
                     quality.invalid_email("mail").cast("long").alias("bad_mail"))


@query("semi_and_anti", """
SELECT c_custkey, 'buyer' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""")
def semi_and_anti_q(spark, sf):
    """J8."""
    t = Tables(spark, sf)
    people, buyers = t.customer.select("c_custkey"), t.orders.select(c("o_custkey").alias("c_custkey"))
    return joins.semi_filter(people, buyers, ["c_custkey"]).withColumn("kind", F.lit("buyer")).unionByName(
        joins.anti_filter(people, buyers, ["c_custkey"]).withColumn("kind", F.lit("idle")))
