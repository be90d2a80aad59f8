"""Quotas, cooldowns, TTL context and code validity.

The source kept this state in keys with a time-to-live.  A key that every use
renews expires after a *gap* of TTL seconds, so its batch form is a gap
session: ``session_window`` (batch or streaming) or ``lag`` + running sum.
Rules whose outcome feeds back into the state (blocked uses are not counted,
refused sends do not restart the cooldown) are chains of the events that change
it: see ``chains``.  No key is walked by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.streaming import chains as ch

# Limits and lifetimes (seconds) of the source's keys.
ANON_LIMIT = 3
ANON_TTL_S = 24 * 3600
OTP_TTL_S = 600
OTP_COOLDOWN_S = 60
OTP_HOURLY_LIMIT = 5


# --- T1 -----------------------------------------------------------------------
def gap_session_buckets(df: DataFrame, key: str, ts: str, ttl_s: int, strict_gap: bool = False) -> DataFrame:
    """Session numbers of (key, TTL-wide time bucket) for gap sessions with gap ``ttl_s``.

    Two events in the same bucket are less than one TTL apart, so a session
    can only start at the first event of a bucket: when the key's previous
    bucket is empty, or its last event is at least (``strict_gap``: more
    than) one TTL before this bucket's first event.  The per-bucket summary
    is an aggregate with a map-side partial phase, so a key holding a third
    of all events is reduced in every task; the per-key window then runs over
    buckets only (time span / TTL rows per key), never over the events.
    Returns ``key, _bucket, _first, _last, _n, session_no``.
    """
    b = F.floor(epoch_seconds(ts) / F.lit(ttl_s)).cast("long")
    per = df.groupBy(key, b.alias("_bucket")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"),
                                                 F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_bucket")
    prev_b = F.lag("_bucket").over(w)
    prev_last = F.lag("_last").over(w)
    ttl = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s))
    far = (F.col("_first") > prev_last + ttl) if strict_gap else (F.col("_first") >= prev_last + ttl)
    brk = F.when(prev_b.isNull() | (prev_b != F.col("_bucket") - 1) | far, 1).otherwise(0)
    return per.withColumn("session_no", F.sum(brk).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def usage_sessions(uses: DataFrame, key: str, ts: str, ttl_s: int = ANON_TTL_S,
                   limit: int = ANON_LIMIT) -> DataFrame:
    """T1 aggregate form: a counter renewed by every use resets after a TTL gap.

    One row per (key, session): first use, expiry (last use + TTL), uses,
    remaining = max(0, limit - uses) and the verdict for the next request.
    Built on ``gap_session_buckets`` (skew-safe); the streaming form uses
    ``session_window`` with a watermark.
    """
    per = gap_session_buckets(uses, key, ts, ttl_s)
    s = per.groupBy(key, "session_no").agg(F.sum("_n").alias("uses"), F.min("_first").alias("first_use"),
                                          F.max("_last").alias("last_use"))
    ttl = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s))
    return s.select(key, "first_use", (F.col("last_use") + ttl).alias("expires"), F.col("uses").cast("long").alias("uses"),
                    F.greatest(F.lit(limit) - F.col("uses"), F.lit(0)).cast("long").alias("remaining"),
                    F.when(F.col("uses") >= limit, "blocked").otherwise("open").alias("verdict"))


def usage_sessions_windowed(uses: DataFrame, key: str, ts: str, ttl_s: int = ANON_TTL_S,
                            limit: int = ANON_LIMIT) -> DataFrame:
    """T1 with ``session_window`` (the form used on streams)."""
    s = uses.groupBy(key, F.session_window(ts, f"{ttl_s} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("uses"), F.min(ts).alias("first_use"), F.max(ts).alias("last_use"))
    return s.select(key, "first_use", F.col("w.end").alias("expires"), F.col("uses").cast("long").alias("uses"),
                    F.greatest(F.lit(limit) - F.col("uses"), F.lit(0)).cast("long").alias("remaining"),
                    F.when(F.col("uses") >= limit, "blocked").otherwise("open").alias("verdict"))


_NO_KEY = object()  # unlike any key, null included


def _walk(df: DataFrame, key: str, order: Sequence[str], schema: T.StructType, step) -> DataFrame:
    """Per-key ordered scan: ``step(state, row) -> (state, outputs)``, state reset per key."""
    names = [f.name for f in schema.fields]
    extra = [f.name for f in schema.fields if f.name not in df.columns]

    def run(batches):
        cur, state = _NO_KEY, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[key].tolist()
            rows = pdf.to_dict("records")
            outs = {c: [None] * len(pdf) for c in extra}
            for i, r in enumerate(rows):
                if keys[i] != cur and not (pd.isna(keys[i]) and pd.isna(cur)):
                    cur, state = keys[i], None
                state, out = step(state, r)
                for c in extra:
                    outs[c][i] = out.get(c)
            pdf = pdf.copy()
            for c in extra:
                pdf[c] = outs[c]
            yield pdf[names]

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def epoch_seconds(col: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock timestamp, independent of the session time zone."""
    x = F.col(col) if isinstance(col, str) else col
    days = F.datediff(F.to_date(x), F.to_date(F.lit("1970-01-01")))
    return days.cast("long") * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)


def _later_by(a: Column, b: Column, seconds: int) -> Column:
    """``a >= b + seconds`` with interval arithmetic (exact to the microsecond)."""
    return a >= b + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def segmented(df: DataFrame, key: str, ts: str, reset_gap_s: int) -> DataFrame:
    """Add ``_seg``: the key and the number of its gap session, for a gap after which no state matters.

    Segments are independent, so the walk of a busy key is split over many tasks.
    """
    out = _with_session(df, key, ts, gap_session_buckets(df, key, ts, reset_gap_s), reset_gap_s)
    named = F.when(F.col(key).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    return out.withColumn("_seg", F.concat(named, F.lit("#"), F.coalesce(F.col("session_no").cast("string"), F.lit("")))).drop("_bucket", "session_no")


def _with_session(df: DataFrame, key: str, ts: str, buckets: DataFrame, width_s: int) -> DataFrame:
    """``df`` with ``_bucket`` and ``session_no``; events without a key are those of one more key."""
    per = buckets.select(F.col(key).alias("_pk"), F.col("_bucket").alias("_pb"), "session_no")
    b = F.floor(epoch_seconds(ts) / F.lit(width_s)).cast("long")
    return df.withColumn("_bucket", b).join(
        per, F.col(key).eqNullSafe(F.col("_pk")) & F.col("_bucket").eqNullSafe(F.col("_pb"))).drop("_pk", "_pb")


def _epoch(x) -> int:
    """Microseconds since the epoch of a wall-clock timestamp (exact integer)."""
    return pd.Timestamp(x).value // 1000


_US = 1_000_000


def usage_step(ts: str, ttl_s: int = ANON_TTL_S, limit: int = ANON_LIMIT):
    """State transition of the anonymous quota: ``(used, expiry_us)`` x request -> verdict."""
    def step(state, r):
        used, expiry = state or (0, None)
        t = _epoch(r[ts])
        if expiry is None or t >= expiry:
            used = 0
        before = used
        if used >= limit:
            verdict = "blocked"
        else:
            verdict = "allowed"
            if r["_counted"]:
                used, expiry = used + 1, t + ttl_s * _US
        return (used, expiry), {"used_before": before, "verdict": verdict,
                                "remaining": max(0, limit - used)}
    return step


def usage_verdicts(requests: DataFrame, key: str, ts: str, tiebreak: str, counted: Column,
                   ttl_s: int = ANON_TTL_S, limit: int = ANON_LIMIT) -> DataFrame:
    """T1 per-request verdict with the exact feedback of the source.

    Before each request the counter is dropped if its expiry passed; a request
    is ``blocked`` when ``used >= limit``; an allowed request that is a counted
    use (``counted``) increments the counter and renews the expiry to
    ``ts + ttl``.  Blocked requests neither count nor renew.  A request
    without a time is allowed and not counted; requests without a key are those
    of one more key.
    """
    rows = ch.numbered(requests.withColumn("_counted", F.coalesce(counted.cast("boolean"), F.lit(False))), key, ts, tiebreak)
    width = ttl_s * _US
    uses = rows.where("_counted").where(F.col("_e.us").isNotNull()).select("_k", "_e")
    seq = ch.following(uses, width, limit - 1)
    # a use after a silent TTL starts a count whatever was before
    fresh = F.col("previous").isNull() | (F.col("_e.us") >= F.col("previous.us") + width)
    chain = F.concat(F.array("_e"), "then")
    late = F.filter(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.get("chain", i)["us"] >= F.get("chain", i - 1)["us"] + width)
    seq = seq.select("_k", "_e", fresh.alias("fresh"), chain.alias("chain"))
    seq = seq.withColumn("cut", F.when(F.size("chain") > 1, F.get(late, F.lit(0))))
    # of a use that starts a count: the uses that count, and the use that starts the next count
    seq = seq.select("_k", "_e", "fresh", F.when(F.col("cut").isNull(), F.col("chain")).otherwise(F.slice("chain", 1, F.greatest("cut", F.lit(1)))).alias("counts"),
                     F.get("chain", F.col("cut")).alias("onward"))
    full = F.col("onward").isNull() & (F.size("counts") == limit)
    seq = seq.withColumn("last", F.when(full, F.element_at("counts", -1)["id"]))
    after = ch.first_after(uses, width).select(F.col("id").alias("last"), F.col("next.id").alias("_after"))
    seq = seq.join(after, "last", "left").select("_k", F.col("_e.id").alias("id"), "fresh", "counts", F.coalesce("onward.id", "_after").alias("next")).checkpoint(eager=True)
    heads = seq.join(ch.reached(seq, seq.where("fresh")), "id")
    # a count lasts under limit TTLs after its first use, so it matters to so many buckets; its first uses lie a TTL apart or more
    first = ch.bucket(F.get("counts", F.lit(0))["us"], width)
    near = heads.select(F.col("_k").alias("_hk"), F.explode(F.sequence(first, first + limit)).alias("_hb"), "counts")
    near = near.groupBy("_hk", "_hb").agg(F.sort_array(F.collect_list("counts")).alias("_groups"))
    out = rows.withColumn("_b", ch.bucket(F.col("_e.us"), width)).join(near, ch.same_key("_hk") & (F.col("_b") == F.col("_hb")), "left")
    group = F.element_at(F.filter("_groups", lambda g: g[0] < F.col("_e")), -1)
    before = F.filter(group, lambda e: e < F.col("_e"))
    out = out.withColumn("_before", F.when(F.size(F.filter("_groups", lambda g: g[0] < F.col("_e"))) > 0, before))
    alive = F.col("_before").isNotNull() & (F.col("_e.us") < F.element_at("_before", -1)["us"] + width)
    used = F.when(alive, F.size("_before")).otherwise(0).cast("long")
    out = out.withColumn("used_before", used).withColumn("verdict", F.when(F.col("used_before") >= limit, "blocked").otherwise("allowed"))
    counts = (F.col("_counted") & (F.col("verdict") == "allowed")).cast("long")
    out = out.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used_before") - counts, F.lit(0)).cast("long"))
    return out.select(*requests.columns, "used_before", "verdict", "remaining")


# --- T2, T3 ---------------------------------------------------------------------
def hourly_cap(attempts: DataFrame, key: str, ts: str, tiebreak: str,
               limit: int = OTP_HOURLY_LIMIT) -> DataFrame:
    """Attempts per key and clock hour; allowed while the running count <= limit.

    Refused attempts still count (the counter is incremented before the test).
    Attempts are numbered within their second, after those of earlier seconds of
    the hour (at most 3600 counts), so a busy hour is not one task.
    """
    x = attempts.withColumn("_h", F.date_trunc("hour", F.col(ts))).withColumn("_s", F.date_trunc("second", F.col(ts)))
    counts = x.groupBy(key, "_h", "_s").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key, "_h").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("_ck"), F.col("_s").alias("_cs"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    w = Window.partitionBy(key, "_s").orderBy(ts, tiebreak)
    return (x.withColumn("_row", F.row_number().over(w))
            .join(counts, F.col(key).eqNullSafe(F.col("_ck")) & F.col("_s").eqNullSafe(F.col("_cs")))
            .withColumn("hour_key", F.date_format("_h", "yyyyMMddHH"))
            .withColumn("attempt_no", (F.col("_before") + F.col("_row")).cast("long"))
            .withColumn("allowed", (F.col("attempt_no") <= limit).cast("int"))
            .drop("_h", "_s", "_ck", "_cs", "_row", "_before"))


def send_step(ts: str, cooldown_s: int = OTP_COOLDOWN_S, limit: int = OTP_HOURLY_LIMIT):
    """State transition of the send guard: ``(cool_until_us, hour, count)`` x attempt -> verdict."""
    def step(state, r):
        cool_until, hour, count = state or (-np.inf, None, 0)
        t = _epoch(r[ts])
        if t < cool_until:
            return (cool_until, hour, count), {"verdict": "cooldown"}
        h = pd.Timestamp(r[ts]).floor("h")
        if h != hour:
            hour, count = h, 0
        count += 1
        if count <= limit:
            return (t + cooldown_s * _US, hour, count), {"verdict": "sent"}
        return (cool_until, hour, count), {"verdict": "hourly_limit"}
    return step


def send_verdicts(attempts: DataFrame, key: str, ts: str, tiebreak: str,
                  cooldown_s: int = OTP_COOLDOWN_S, limit: int = OTP_HOURLY_LIMIT) -> DataFrame:
    """T2 + T3 exact: cooldown first (a refusal there does not count), then the hourly cap.

    An accepted send starts a cooldown of ``cooldown_s`` seconds; the hourly
    counter of the clock hour is incremented by every attempt that passes the
    cooldown test, allowed while it stays <= limit.  An attempt without a time
    has no verdict; attempts without a key are those of one more key.

    A send's next one is the key's first attempt past the cooldown; once an
    hour is full, the first one of a later hour past it.
    """
    rows = ch.numbered(attempts, key, ts, tiebreak)
    width, hour = cooldown_s * _US, 3600 * _US
    timed = rows.where(F.col("_e.us").isNotNull()).select("_k", "_e", ch.bucket(F.col("_e.us"), hour).alias("_h"))
    next_ = ch.first_after(timed, width).select(F.col("id").alias("_nid"), "next").checkpoint(eager=True)
    by_hour = Window.partitionBy("_k").orderBy("_h")
    hours = timed.groupBy("_k", "_h").agg(F.min("_e").alias("_first"), F.max("_e").alias("_last"), F.min(F.when(F.col("_e.us") >= F.col("_h") * hour + width, F.col("_e"))).alias("_cool"))
    # a cooldown from before the hour is over by width into it, so the hour's first send is one of these
    silent = F.col("_first.us") >= F.lag("_last").over(by_hour)["us"] + width
    hours = hours.select(F.col("_k").alias("_hk"), F.col("_h").alias("_hh"), "_first", "_cool", F.lead("_first").over(by_hour).alias("_later"), F.coalesce(silent, F.lit(True)).alias("_silent"))
    may = (F.col("_e.us") < F.col("_h") * hour + width) | (F.col("_e.id") == F.col("_first.id")) | (F.col("_e.id") == F.col("_cool.id"))
    path = timed.join(hours, ch.same_key("_hk") & (F.col("_h") == F.col("_hh"))).where(may)
    path = path.select("_k", "_h", "_later", F.col("_e.id").alias("id"), (F.col("_silent") & (F.col("_e.id") == F.col("_first.id"))).alias("fresh"), F.array("_e").alias("sent"), F.lit(None).cast("long").alias("onward"))
    for i in range(limit):
        # one more send in this hour, or the first one past it
        path = path.withColumn("_last", F.when(F.col("onward").isNull() & (F.size("sent") == i + 1), F.element_at("sent", -1)["id"]))
        path = path.join(next_, F.col("_last") == F.col("_nid"), "left")
        here = ch.bucket(F.col("next.us"), hour) == F.col("_h")
        grows = F.coalesce(here, F.lit(False)) if i + 1 < limit else F.lit(False)
        full = F.when(F.coalesce(here, F.lit(True)), F.col("_later.id")).otherwise(F.col("next.id")) if i + 1 == limit else F.col("next.id")
        path = path.select("_k", "_h", "_later", "id", "fresh", F.when(grows, F.concat("sent", F.array("next"))).otherwise(F.col("sent")).alias("sent"),
                           F.when(F.col("_last").isNotNull() & ~grows, full).otherwise(F.col("onward")).alias("onward"))
    path = path.select("_k", "id", "fresh", "sent", F.col("onward").alias("next")).checkpoint(eager=True)
    sends = path.join(ch.reached(path, path.where("fresh")), "id").select("_k", F.explode("sent").alias("_s"))
    at = ch.bucket(F.col("_s.us"), width)  # sends lie a cooldown apart, so a bucket holds one
    near = sends.select(F.col("_k").alias("_sk"), F.explode(F.array(at, at + 1)).alias("_sb"), "_s").groupBy("_sk", "_sb").agg(F.collect_list("_s").alias("_sends"))
    out = rows.withColumn("_b", ch.bucket(F.col("_e.us"), width)).join(near, ch.same_key("_sk") & (F.col("_b") == F.col("_sb")), "left")
    is_send = F.exists("_sends", lambda s: s["id"] == F.col("_e.id"))
    cooling = F.exists("_sends", lambda s: (s["us"] <= F.col("_e.us")) & (F.col("_e.us") < s["us"] + width))
    verdict = F.when(F.col("_e.us").isNull(), F.lit(None)).when(is_send, "sent").when(cooling, "cooldown").otherwise("hourly_limit")
    return out.select(*attempts.columns, verdict.alias("verdict"))


# --- T4 ---------------------------------------------------------------------------
def context_sessions(events: DataFrame, key: str, ts: str, tiebreak: str, ttl_s: int,
                     strict_gap: bool, keep_bucket: bool = False) -> DataFrame:
    """Gap sessions of a context that every access renews.

    ``strict_gap=True``: expired only when the gap exceeds the TTL (in-memory
    variant, ``last + ttl < now``); ``False``: expired once the gap reaches
    the TTL (key with expiry).  Adds ``ctx_session`` (1, 2, ... per key) from
    ``gap_session_buckets`` joined back on (key, bucket).
    """
    out = _with_session(events, key, ts, gap_session_buckets(events, key, ts, ttl_s, strict_gap), ttl_s
                        ).withColumnRenamed("session_no", "ctx_session")
    return out if keep_bucket else out.drop("_bucket")


def session_context(events: DataFrame, key: str, ts: str, tiebreak: str, fields: dict[str, Column],
                    ttl_s: int = 3600, nulls_overwrite: bool = True, strict_gap: bool = True) -> DataFrame:
    """T4: the context after each event: latest value of each field in the session.

    ``fields`` maps a context field to the value an event writes: a column
    (NULL = no write) or a ``(writes, value)`` pair when explicit NULL
    writes must be told apart.  Variant B (default, TTL 3600 s) is the
    one the chat route uses; variant A (``nulls_overwrite=False``, TTL 1800 s,
    gap reached at the TTL) keeps the previous value on NULL updates.

    The running "latest value" is split the same way as the sessions: inside
    a TTL bucket a window over that bucket's rows, across buckets the value
    at the end of each earlier bucket of the same session, carried by a
    window over bucket summaries.  No window ever spans a whole session.
    """
    s = context_sessions(events, key, ts, tiebreak, ttl_s, strict_gap, keep_bucket=True)
    order = F.struct(F.col(ts), F.col(tiebreak))
    inb = Window.partitionBy(key, "_bucket").orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    # A write is a struct holding the value, so an explicit NULL write (variant
    # B) is a non-NULL struct and overwrites; rows that do not write give NULL.
    writes = {}
    for name, spec in fields.items():
        cond, value = spec if isinstance(spec, tuple) else (spec.isNotNull(), spec)
        keep = cond if nulls_overwrite else (cond & value.isNotNull())
        writes[name] = F.when(keep, F.struct(value.alias("v")))
    for name, w in writes.items():
        s = s.withColumn(f"_w_{name}", w)
    ends = s.groupBy(key, "ctx_session", "_bucket").agg(
        *[F.max_by(F.col(f"_w_{n}"), F.when(F.col(f"_w_{n}").isNotNull(), order)).alias(f"_e_{n}") for n in writes])
    carry_w = Window.partitionBy(key, "ctx_session").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_ek"), F.col("ctx_session").alias("_es"), F.col("_bucket").alias("_eb"),
                       *[F.last(f"_e_{n}", ignorenulls=True).over(carry_w).alias(f"_c_{n}") for n in writes])
    s = s.join(ends, F.col(key).eqNullSafe(F.col("_ek")) & F.col("ctx_session").eqNullSafe(F.col("_es"))
               & F.col("_bucket").eqNullSafe(F.col("_eb"))).drop("_ek", "_es", "_eb")
    for n in writes:
        s = s.withColumn(n, F.coalesce(F.last(f"_w_{n}", ignorenulls=True).over(inb), F.col(f"_c_{n}"))["v"])
    return s.drop("_bucket", *[f"_w_{n}" for n in writes], *[f"_c_{n}" for n in writes])


# --- J12 / T7 ------------------------------------------------------------------------
def valid_within(issues: DataFrame, attempts: DataFrame, key: str, ts: str, code: str, id_col: str,
                 ttl_s: int = OTP_TTL_S, invalidate_on_use: bool = False) -> DataFrame:
    """An attempt is valid if the latest code issued for its key is equal and younger than the TTL.

    Only issues of the last ``ttl_s`` seconds can make an attempt valid, so
    the as-of join is an equi join on (key, time bucket of ``ttl_s``) - every
    issue is offered to its own and the next bucket - followed by the range
    filter and ``max_by`` on the issue time.  Candidates per attempt are
    bounded by the issues of one key in two TTL windows.

    ``invalidate_on_use`` (reset codes): a code is spent by its first valid
    attempt (by time, then id); later ones are invalid until the next issue.
    """
    b = F.floor(epoch_seconds(ts) / F.lit(ttl_s)).cast("long")
    iss = issues.select(F.col(key).alias("_ik"), F.col(ts).alias("_its"), F.col(code).alias("_icode"),
                        F.col(id_col).alias("issue_id"),
                        F.explode(F.array(b, b + 1)).alias("_bucket"))
    att = attempts.withColumn("_bucket", b)
    cand = att.join(iss, (att[key] == iss["_ik"]) & (att["_bucket"] == iss["_bucket"])
                    & (iss["_its"] <= att[ts])
                    & ~_later_by(att[ts], iss["_its"], ttl_s), "inner")
    latest = cand.groupBy(id_col).agg(F.max_by(F.struct("_icode", "issue_id"),
                                               F.struct("_its", "issue_id")).alias("_last"))
    res = attempts.join(latest, id_col, "left")
    right = F.col("_last._icode").isNotNull() & (F.col("_last._icode") == F.col(code))
    res = res.select(*attempts.columns, F.col("_last.issue_id").alias("issue_id"), right.cast("int").alias("valid"))
    return spend(res, ts, id_col) if invalidate_on_use else res


def spend(checked: DataFrame, ts: str, id_col: str) -> DataFrame:
    """Attempts whose code an earlier valid attempt has spent are invalid: one row an issue tells who spent it."""
    order = F.struct(ts, id_col)
    spent = checked.where("valid = 1").groupBy(F.col("issue_id").alias("_spent")).agg(F.min(order).alias("_by"))
    out = checked.join(spent, F.col("issue_id") == F.col("_spent"), "left")
    return out.withColumn("valid", F.when(F.col("_by").isNotNull() & (order > F.col("_by")), 0).otherwise(F.col("valid"))).drop("_spent", "_by")
