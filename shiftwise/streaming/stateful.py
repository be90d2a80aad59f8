"""Structured Streaming forms of the quota, dedup and code-validity operators.

* ``usage_sessions_stream``: event-time ``session_window`` with a watermark;
  a session is emitted once the watermark passes its end (append mode), late
  rows beyond the watermark are dropped by Spark.
* ``usage_verdicts_stream`` / ``validity_stream``: per-key state with
  ``applyInPandasWithState``; the state is the key's few scalars (counter and
  expiry, latest issued code), not its events, and an event-time timeout
  removes it once it has expired - the streaming analogue of a key TTL.  The
  transition functions are the ones the batch forms use, so a stream and the
  batch over the same events give the same verdicts.
* ``dedup_requests_stream``: ``dropDuplicatesWithinWatermark`` - the first
  request of an input is computed, repeats within the watermark are cache
  hits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from shiftwise.streaming.ordered import in_order
from shiftwise.streaming.quotas import (ANON_LIMIT, ANON_TTL_S, OTP_COOLDOWN_S, OTP_HOURLY_LIMIT, OTP_TTL_S, _epoch,
                                       send_step, usage_sessions_windowed, usage_step)

_US = 1_000_000


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need ``TIMESTAMP``; wall-clock (``TIMESTAMP_NTZ``) columns are
    read in the session time zone (UTC in all our sessions)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def usage_sessions_stream(uses: DataFrame, key: str, ts: str, watermark: str = "1 day",
                          ttl_s: int = ANON_TTL_S, limit: int = ANON_LIMIT) -> DataFrame:
    """T1 aggregate form on a stream (append mode after the watermark)."""
    return usage_sessions_windowed(event_time(uses, ts).withWatermark(ts, watermark), key, ts, ttl_s, limit)


def _sorted(pdfs, order):
    frames = [p for p in pdfs if len(p)]
    if not frames:
        return None
    return pd.concat(frames, ignore_index=True).sort_values(order, kind="mergesort")


def usage_verdicts_stream(requests: DataFrame, key: str, ts: str, tiebreak: str, counted: Column,
                          watermark: str = "1 day", ttl_s: int = ANON_TTL_S, limit: int = ANON_LIMIT) -> DataFrame:
    """T1 per-request verdicts on a stream; state ``(used, expiry)`` per key with TTL."""
    src = event_time(requests.withColumn("_counted", counted.cast("boolean")), ts).withWatermark(ts, watermark)
    out = T.StructType(src.schema.fields + [T.StructField("used_before", T.LongType()),
                                            T.StructField("verdict", T.StringType()),
                                            T.StructField("remaining", T.LongType())])
    names = [f.name for f in out.fields]
    step = usage_step(ts, ttl_s, limit)

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        cur = None
        if state.exists:
            used, expiry = state.get
            cur = (used, None if expiry < 0 else expiry)
        pdf = _sorted(pdfs, [ts, tiebreak])
        if pdf is None:
            return
        rows = pdf.to_dict("records")
        res = {"used_before": [], "verdict": [], "remaining": []}
        for r in rows:
            cur, o = step(cur, r)
            for c in res:
                res[c].append(o[c])
        for c, v in res.items():
            pdf[c] = v
        used, expiry = cur
        state.update((int(used), int(expiry) if expiry is not None else -1))
        if expiry is not None:
            state.setTimeoutTimestamp(max(int(expiry // 1000), state.getCurrentWatermarkMs() + 1))
        yield pdf[names]

    state_schema = T.StructType([T.StructField("used", T.LongType()), T.StructField("expiry", T.LongType())])
    return (src.groupBy(key).applyInPandasWithState(fn, out, state_schema, "append",
                                                      GroupStateTimeout.EventTimeTimeout).drop("_counted"))


def send_verdicts_stream(attempts: DataFrame, key: str, ts: str, tiebreak: str, watermark: str = "1 hour",
                         cooldown_s: int = OTP_COOLDOWN_S, limit: int = OTP_HOURLY_LIMIT) -> DataFrame:
    """T2 + T3 on a stream: state ``(cool_until, hour, count)`` per key, dropped
    by an event-time timeout one hour after the last attempt."""
    src = event_time(attempts, ts).withWatermark(ts, watermark)
    out = T.StructType(src.schema.fields + [T.StructField("verdict", T.StringType())])
    names = [f.name for f in out.fields]
    step = send_step(ts, cooldown_s, limit)

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        cur = None
        if state.exists:
            cool, hour_us, count = state.get
            cur = (cool, pd.Timestamp(hour_us, unit="us"), count)
        pdf = _sorted(pdfs, [ts, tiebreak])
        if pdf is None:
            return
        verdicts = []
        for r in pdf.to_dict("records"):
            cur, o = step(cur, r)
            verdicts.append(o["verdict"])
        pdf["verdict"] = verdicts
        cool, hour, count = cur
        cool_i = int(cool) if cool != -float("inf") else -1
        state.update((cool_i, int(hour.value // 1000), int(count)))
        last_us = _epoch(pdf[ts].iloc[-1])
        state.setTimeoutTimestamp(max(int((last_us + 3600 * _US) // 1000), state.getCurrentWatermarkMs() + 1))
        yield pdf[names]

    state_schema = T.StructType([T.StructField("cool_until", T.LongType()), T.StructField("hour", T.LongType()),
                                 T.StructField("count", T.LongType())])
    return src.groupBy(key).applyInPandasWithState(fn, out, state_schema, "append",
                                                   GroupStateTimeout.EventTimeTimeout)


def validity_step(kind: str, code: str, ttl_s: int, invalidate_on_use: bool):
    """State transition of a key's latest code: ``(code, issued)`` x issue or attempt; issues give no row."""
    def step(state, r):
        latest, issued = state or (None, None)
        if r[kind] == "issue":
            return (r[code], r["_us"]), None
        right = latest is not None and r["_us"] - issued < ttl_s * _US and r[code] == latest
        spent = right and invalidate_on_use
        return (None if spent else latest, issued), {"valid": int(right)}
    return step


def validity_stream(events: DataFrame, key: str, ts: str, tiebreak: str, kind: str, code: str,
                    watermark: str = "10 minutes", ttl_s: int = OTP_TTL_S,
                    invalidate_on_use: bool = False) -> DataFrame:
    """Per key, the latest issued code and its time; each attempt is checked against it.

    ``kind`` is 'issue' or 'attempt'.  A code expires ``ttl_s`` after it was
    issued (event time); ``invalidate_on_use`` drops it after a valid attempt
    (password-reset codes).  Rows are taken in event-time order, whatever the
    order they come in.  Output: the attempts with ``valid`` (0/1).
    """
    kind_of = events.schema[code].dataType.simpleString()
    out = in_order(events, key, ts, tiebreak, validity_step(kind, code, ttl_s, invalidate_on_use), f"code {kind_of}, issued bigint", "valid int", watermark,
                   lambda state: (state[1] or 0) + ttl_s * _US)
    return out.drop(kind)


def valid_within_stream(issues: DataFrame, attempts: DataFrame, key: str, ts: str, code: str, id_col: str,
                        watermark: str = "10 minutes", ttl_s: int = OTP_TTL_S) -> DataFrame:
    """T7 as an interval join of two streams: (attempt columns, issue_id, valid), as ``quotas.valid_within`` in batch.

    Both sides have a watermark, so Spark drops an issue from the join's state
    once no attempt of its lifetime can come.  An attempt joins every
    issue it may mean; an aggregate per attempt, closed by the watermark, takes the latest.
    """
    iss = event_time(issues.select(F.col(key).alias("_ik"), F.col(ts).alias("_its"), F.col(code).alias("_icode"), F.col(id_col).alias("_iid")), "_its").withWatermark("_its", watermark)
    att = event_time(attempts, ts).withWatermark(ts, watermark)
    ttl = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s))
    pairs = att.join(iss, (F.col(key) == F.col("_ik")) & (F.col("_its") <= F.col(ts)) & (F.col(ts) < F.col("_its") + ttl), "left_outer")
    latest = F.max_by(F.struct(F.col("_iid").alias("id"), F.col("_icode").alias("code")), F.struct("_its", "_iid"))
    out = pairs.groupBy(*attempts.columns).agg(latest.alias("_last"))
    right = F.col("_last.code").isNotNull() & (F.col("_last.code") == F.col(code))
    return out.select(*attempts.columns, F.col("_last.id").alias("issue_id"), right.cast("int").alias("valid"))


def dedup_requests_stream(requests: DataFrame, key_cols: list[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """T5 on a stream: the first request per input within the watermark is computed."""
    return event_time(requests, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key_cols)


def context_step(names: list[str], ttl_s: int, strict_gap: bool, nulls_overwrite: bool):
    """State transition of a context: ``(last, session, values)`` x event -> session number and values.

    ``_w_<name>`` holds whether an event writes a field, ``_v_<name>`` the value, ``_renews`` whether it renews the context.
    """
    def step(state, r):
        last, session, *values = state or (None, 0, *[None] * len(names))
        gap = None if last is None else r["_us"] - last
        if gap is None or (gap > ttl_s * _US if strict_gap else gap >= ttl_s * _US):
            session, values, last = session + 1, [None] * len(names), r["_us"]
        writes = [r[f"_w_{n}"] and (nulls_overwrite or r[f"_v_{n}"] is not None) for n in names]
        values = [r[f"_v_{n}"] if w else v for n, v, w in zip(names, values, writes, strict=True)]
        return (r["_us"] if r["_renews"] else last, session, *values), {"ctx_session": session, **dict(zip(names, values, strict=True))}
    return step


def session_context_stream(events: DataFrame, key: str, ts: str, tiebreak: str, fields: dict[str, Column | tuple[Column, Column]],
                           ttl_s: int = 3600, strict_gap: bool = True, watermark: str = "1 hour", nulls_overwrite: bool = True,
                           renews: Column | None = None) -> DataFrame:
    """T4 on a stream: each event, in time order, with its context's number and the field values after it.

    ``fields`` as in ``quotas.session_context``: a column (NULL = no write) or a
    ``(writes, value)`` pair.  Variant B (default): NULLs that are written
    overwrite, every event renews.  Variant A: ``nulls_overwrite=False``,
    ``strict_gap=False``, and ``renews`` tells the updates, which alone renew.
    The numbers go on while the state lives: one TTL past the last renewal it
    is dropped, and a key that comes back begins with 1 again.
    """
    specs = {n: x if isinstance(x, tuple) else (x.isNotNull(), x) for n, x in fields.items()}
    rows = events.withColumns({f"_w_{n}": F.coalesce(w.cast("boolean"), F.lit(False)) for n, (w, _) in specs.items()} | {f"_v_{n}": v for n, (_, v) in specs.items()})
    rows = rows.withColumn("_renews", F.lit(True) if renews is None else F.coalesce(renews.cast("boolean"), F.lit(False)))
    values = ", ".join(f"{n} {rows.schema[f'_v_{n}'].dataType.simpleString()}" for n in fields)
    state = "last bigint, session bigint" + (f", {values}" if values else "")
    adds = "ctx_session bigint" + (f", {values}" if values else "")
    step = context_step(list(fields), ttl_s, strict_gap, nulls_overwrite)
    out = in_order(rows, key, ts, tiebreak, step, state, adds, watermark, lambda state: state[0] + ttl_s * _US)
    return out.select(*events.columns, "ctx_session", *fields)


def request_events_stream(requests: DataFrame, op: str, key_cols: list[str], ts: str,
                          watermark: str = "1 hour") -> DataFrame:
    """T6 on a stream: prime requests always emit an event (also on a cache
    hit); other inputs emit once (computed) within the watermark."""
    src = event_time(requests, ts).withWatermark(ts, watermark)
    primes = src.where(F.col(op) == "prime")
    computed = src.where(F.col(op) != "prime").dropDuplicatesWithinWatermark([op, *key_cols])
    label = F.when(F.col(op) == "fibo", F.lit("fibonacci")).otherwise(F.col(op))
    return primes.unionByName(computed).withColumn("event_operation", label)
