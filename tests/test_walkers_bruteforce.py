"""Segmented per-key walkers against a plain sequential walk on boundary-heavy fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shiftwise.streaming import quotas as qt

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _events(seed, n=400):
    rnd = random.Random(seed)
    rows, t = [], {}
    steps = [0, 1, 59, 60, 61, 3599, 3600, 3601, 86399, 86400, 86401, 300, 7200, 172800]
    for i in range(n):
        u = rnd.choice([1, 2, 3])
        t[u] = t.get(u, T0) + dt.timedelta(seconds=rnd.choice(steps), microseconds=rnd.choice([0, 0, 1, 999999]))
        rows.append((i, u, t[u], rnd.random() < 0.5))
    return rows


def _walk_usage(rows, ttl=86400, limit=3):
    out, state = {}, {}
    for i, u, ts, counted in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        used, exp = state.get(u, (0, None))
        if exp is None or ts >= exp:
            used = 0
        if used >= limit:
            out[i] = "blocked"
        else:
            out[i] = "allowed"
            if counted:
                used, exp = used + 1, ts + dt.timedelta(seconds=ttl)
        state[u] = (used, exp)
    return out


def _walk_send(rows, cool=60, limit=5):
    out, state = {}, {}
    for i, u, ts, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        until, hour, cnt = state.get(u, (None, None, 0))
        if until is not None and ts < until:
            out[i] = "cooldown"
            continue
        h = ts.replace(minute=0, second=0, microsecond=0)
        if h != hour:
            hour, cnt = h, 0
        cnt += 1
        if cnt <= limit:
            out[i], until = "sent", ts + dt.timedelta(seconds=cool)
        else:
            out[i] = "hourly_limit"
        state[u] = (until, hour, cnt)
    return out


def test_usage_and_send_walkers_match_bruteforce(spark):
    for seed in (1, 2, 3):
        rows = _events(seed)
        df = spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz, counted boolean")
        uv = {r.id: r.verdict for r in qt.usage_verdicts(df, "u", "ts", "id", F.col("counted")).collect()}
        assert uv == _walk_usage(rows), seed
        sv = {r.id: r.verdict for r in qt.send_verdicts(df, "u", "ts", "id").collect()}
        assert sv == _walk_send(rows), seed
