"""Driver queries for quota, cooldown, context and validity state (section 2.9), batch forms.

Mapping onto ``events``: a user is an anonymous session / e-mail address;
``purchase`` events are successful (counted) recommendations, every event is
a request; ``signup`` events issue a code and ``click`` events attempt one,
the code being ``props.k``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.plans.common import c, ts_text
from shiftwise.plans.registry import query
from shiftwise.sources.tables import Tables
from shiftwise.streaming import quotas as qt


@query("usage_counter", """
WITH p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                       OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 86400 SECOND
                     THEN 1 ELSE 0 END AS brk FROM p),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_use,
       strftime(max(ts) + INTERVAL 86400 SECOND, '%Y-%m-%d %H:%M:%S') AS expires,
       CAST(COUNT(*) AS BIGINT) AS uses, CAST(GREATEST(3 - COUNT(*), 0) AS BIGINT) AS remaining,
       CASE WHEN COUNT(*) >= 3 THEN 'blocked' ELSE 'open' END AS verdict
FROM s GROUP BY user_id, sid
""")
def usage_counter(spark, sf):
    ev = Tables(spark, sf).events.where(c("event_type") == "purchase").select("user_id", "ts")
    s = qt.usage_sessions(ev, "user_id", "ts")
    return s.select("user_id", ts_text("first_use").alias("first_use"), ts_text("expires").alias("expires"),
                    "uses", "remaining", "verdict")


@query("usage_verdicts", """
WITH RECURSIVE r AS (
  SELECT event_id, user_id, ts, event_type = 'purchase' AS counted,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
s AS (
  SELECT user_id, rn, event_id,
         CASE WHEN counted THEN 1 ELSE 0 END AS used,
         CASE WHEN counted THEN ts + INTERVAL 86400 SECOND END AS expiry,
         0 AS used_before, 'allowed' AS verdict
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn, r.event_id,
         CASE WHEN x.u0 < 3 AND r.counted THEN x.u0 + 1 ELSE x.u0 END,
         CASE WHEN x.u0 < 3 AND r.counted THEN r.ts + INTERVAL 86400 SECOND ELSE s.expiry END,
         x.u0, CASE WHEN x.u0 >= 3 THEN 'blocked' ELSE 'allowed' END
  FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1,
       LATERAL (SELECT CASE WHEN s.expiry IS NULL OR r.ts >= s.expiry THEN 0 ELSE s.used END AS u0) x)
SELECT event_id, user_id, CAST(used_before AS BIGINT) AS used_before, verdict,
       CAST(GREATEST(3 - used, 0) AS BIGINT) AS remaining
FROM s
""")
def usage_verdicts(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts", "event_type")
    v = qt.usage_verdicts(ev, "user_id", "ts", "event_id", c("event_type") == "purchase")
    return v.select("event_id", "user_id", "used_before", "verdict", "remaining")


@query("hourly_cap", """
SELECT event_id, user_id, strftime(date_trunc('hour', ts), '%Y%m%d%H') AS hour_key,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS BIGINT) AS attempt_no,
       CAST(CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 5
                 THEN 1 ELSE 0 END AS BIGINT) AS allowed
FROM events
""")
def hourly_cap(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    h = qt.hourly_cap(ev, "user_id", "ts", "event_id")
    return h.select("event_id", "user_id", "hour_key", "attempt_no", c("allowed").cast("long").alias("allowed"))


@query("cooldown", """
WITH RECURSIVE r AS (
  SELECT event_id, user_id, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (
  SELECT user_id, rn, event_id, ts + INTERVAL 60 SECOND AS cool_until, date_trunc('hour', ts) AS hr,
         1 AS cnt, 'sent' AS verdict
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn, r.event_id,
         CASE WHEN r.ts < s.cool_until THEN s.cool_until
              WHEN x.c0 + 1 <= 5 THEN r.ts + INTERVAL 60 SECOND ELSE s.cool_until END,
         CASE WHEN r.ts < s.cool_until THEN s.hr ELSE date_trunc('hour', r.ts) END,
         CASE WHEN r.ts < s.cool_until THEN s.cnt ELSE x.c0 + 1 END,
         CASE WHEN r.ts < s.cool_until THEN 'cooldown' WHEN x.c0 + 1 <= 5 THEN 'sent' ELSE 'hourly_limit' END
  FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1,
       LATERAL (SELECT CASE WHEN date_trunc('hour', r.ts) = s.hr THEN s.cnt ELSE 0 END AS c0) x)
SELECT event_id, user_id, verdict FROM s
""")
def cooldown(spark, sf):
    """T2 + T3 exact per-attempt verdicts (sequential state); recursive-CTE oracle."""
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    return qt.send_verdicts(ev, "user_id", "ts", "event_id").select("event_id", "user_id", "verdict")


@query("session_context", """
WITH g AS (
  SELECT event_id, user_id, ts, event_type, value,
         CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3600 SECOND
              THEN 1 ELSE 0 END AS brk
  FROM events),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ctx_session FROM g)
SELECT event_id, user_id, CAST(ctx_session AS BIGINT) AS ctx_session,
       last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (
         PARTITION BY user_id, ctx_session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view_value,
       last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
         PARTITION BY user_id, ctx_session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase_value
FROM s
""")
def session_context(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts", "event_type", "value")
    fields = {"last_view_value": F.when(c("event_type") == "view", c("value")),
              "last_purchase_value": F.when(c("event_type") == "purchase", c("value"))}
    s = qt.session_context(ev, "user_id", "ts", "event_id", fields, ttl_s=3600)
    return s.select("event_id", "user_id", "ctx_session", "last_view_value", "last_purchase_value")


def _codes(t: Tables):
    ev = t.events.select("event_id", "user_id", "ts", "event_type",
                         F.get_json_object("props", "$.k").cast("long").alias("code"))
    return ev.where(c("event_type") == "signup"), ev.where(c("event_type") == "click")


@query("valid_within", """
WITH e AS (SELECT event_id, user_id, ts, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS code FROM events),
i AS (SELECT * FROM e WHERE event_type = 'signup'),
a AS (SELECT * FROM e WHERE event_type = 'click')
SELECT a.event_id, a.user_id, a.code,
       CASE WHEN a.ts < i.ts + INTERVAL 600 SECOND THEN i.event_id END AS issue_id,
       CAST(CASE WHEN a.ts < i.ts + INTERVAL 600 SECOND AND i.code = a.code THEN 1 ELSE 0 END AS INTEGER) AS valid
FROM a ASOF LEFT JOIN i ON a.user_id = i.user_id AND a.ts >= i.ts
""")
def valid_within(spark, sf):
    issues, attempts = _codes(Tables(spark, sf))
    v = qt.valid_within(issues.select("event_id", "user_id", "ts", "code"),
                        attempts.select("event_id", "user_id", "ts", "code"), "user_id", "ts", "code", "event_id")
    return v.select("event_id", "user_id", "code", "issue_id", "valid")


@query("spent_codes", """
WITH e AS (SELECT event_id, user_id, ts, event_type FROM events),
i AS (SELECT * FROM e WHERE event_type = 'signup'),
a AS (SELECT * FROM e WHERE event_type IN ('click', 'view')),
v AS (SELECT a.event_id, a.user_id, a.ts, CASE WHEN a.ts < i.ts + INTERVAL 36000 SECOND THEN i.event_id END AS issue_id,
             CASE WHEN a.ts < i.ts + INTERVAL 36000 SECOND AND a.event_id % 3 > 0 THEN 1 ELSE 0 END AS valid
      FROM a ASOF LEFT JOIN i ON a.user_id = i.user_id AND a.ts >= i.ts)
SELECT event_id, user_id, issue_id,
       CAST(CASE WHEN valid = 1 AND COALESCE(SUM(valid) OVER (PARTITION BY issue_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS valid
FROM v
""")
def spent_codes(spark, sf):
    """J12 with reset codes, which their first valid attempt spends; two attempts in three give the right code, codes live ten hours."""
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts", "event_type")
    issues = ev.where(c("event_type") == "signup").withColumn("code", F.lit(1))
    attempts = ev.where(c("event_type").isin("click", "view")).withColumn("code", (c("event_id") % 3 > 0).cast("int"))
    v = qt.valid_within(issues, attempts, "user_id", "ts", "code", "event_id", ttl_s=36_000, invalidate_on_use=True)
    return v.select("event_id", "user_id", "issue_id", "valid")


@query("route_events", """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, ts, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
p AS (
  SELECT *, CASE WHEN event_type IN ('view', 'error') THEN list_transform(range(1, 1 + k % 4), lambda i: 'title ' || (k * i)) ELSE [] END AS shortlist,
         CASE WHEN event_type = 'click' THEN 1 + k % 3 END AS ord FROM e),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS selected_title,
         CAST(NULL AS VARCHAR) AS context_title, CAST(0 AS BIGINT) AS used, CAST(NULL AS TIMESTAMP) AS until, CAST([] AS VARCHAR[]) AS last_list,
         CAST(NULL AS VARCHAR) AS last_title, CAST(NULL AS TIMESTAMP) AS touched
  FROM p
  UNION ALL
  SELECT p.user_id, p.rn, p.event_id, y.status,
         CASE y.status WHEN 'followup' THEN x.title WHEN 'ordinal_pick' THEN x.list[p.ord] WHEN 'candidates' THEN p.shortlist[1] END,
         x.title, x.used + CASE WHEN y.status IN ('ordinal_pick', 'candidates') THEN 1 ELSE 0 END,
         CASE WHEN y.status IN ('ordinal_pick', 'candidates') THEN p.ts + INTERVAL 86400 SECOND WHEN x.used = 0 AND s.used > 0 THEN NULL ELSE s.until END,
         CASE WHEN y.status = 'candidates' THEN p.shortlist WHEN y.status IN ('blocked', 'out_of_scope') THEN s.last_list ELSE x.list END,
         CASE WHEN y.status = 'candidates' THEN p.shortlist[1] WHEN y.status IN ('blocked', 'out_of_scope') THEN s.last_title ELSE x.title END,
         CASE WHEN y.status IN ('blocked', 'out_of_scope') THEN s.touched ELSE p.ts END
  FROM s JOIN p ON p.user_id = s.user_id AND p.rn = s.rn + 1,
       LATERAL (SELECT CASE WHEN s.until IS NOT NULL AND p.ts >= s.until THEN 0 ELSE s.used END AS used,
                       CASE WHEN p.ts > s.touched + INTERVAL 3600 SECOND THEN [] ELSE s.last_list END AS list,
                       CASE WHEN p.ts > s.touched + INTERVAL 3600 SECOND THEN NULL ELSE s.last_title END AS title) x,
       LATERAL (SELECT CASE WHEN x.used >= 3 THEN 'blocked'
                            WHEN p.event_type = 'signup' THEN 'out_of_scope'
                            WHEN p.event_type = 'purchase' THEN CASE WHEN x.title IS NULL THEN 'need_title' ELSE 'followup' END
                            WHEN p.ord BETWEEN 1 AND len(x.list) THEN 'ordinal_pick'
                            WHEN len(p.shortlist) = 0 THEN 'no_results'
                            ELSE 'candidates' END AS status) y)
SELECT event_id, user_id, status, selected_title, context_title FROM s WHERE rn > 0
""")
def route_events(spark, sf):
    """M14 with expiry: a user's events as queries of one session; the quota ends after 24 hours, the context after one."""
    from shiftwise.operators.routing import route_features
    return route_features(event_queries(Tables(spark, sf).events), "user_id", ["ts", "event_id"], "event_id", ts="ts").select(
        "event_id", "user_id", "status", "selected_title", "context_title")


def event_queries(events):
    """Events as routed queries: a view or error finds k % 4 titles, a click picks one, a purchase asks on, a signup is out of scope."""
    k = F.get_json_object("props", "$.k").cast("long")
    titles = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")), lambda i: F.concat(F.lit("title "), (k * i).cast("string")))
    finds = F.slice(titles, F.lit(1), (k % 4).cast("int"))
    intent = F.when(c("event_type") == "purchase", "book_followup").when(c("event_type") == "signup", "out_of_scope").otherwise("book_search")
    return events.select("event_id", "user_id", "ts", F.lit(False).alias("is_empty"), F.lit(True).alias("is_anonymous"), F.lit(False).alias("is_offensive"), intent.alias("intent"),
                         F.when(c("event_type") == "click", 1 + k % 3).alias("ordinal"), F.when(c("event_type").isin("view", "error"), finds).otherwise(F.array().cast("array<string>")).alias("shortlist"))
