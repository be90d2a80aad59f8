"""Pointers to later events, pointer doubling, and the feedback rules on busy keys."""

import datetime as dt
import inspect
import random

import pytest
from pyspark.sql import functions as F

from shiftwise.streaming import chains as ch
from shiftwise.streaming import quotas as qt
from tests.test_walkers_bruteforce import T0, _walk_send, _walk_usage

SCHEMA = "id long, u long, ts timestamp_ntz, counted boolean"


def _rows(seed, n, steps, keys=(1, 2, None)):
    """Rows of some keys; the first key has most of them."""
    rnd = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        u = keys[0] if rnd.random() < 0.6 else rnd.choice(keys)
        at[u] = at.get(u, T0) + dt.timedelta(seconds=rnd.choice(steps), microseconds=rnd.choice([0, 0, 0, 1, 999_999]))
        rows.append((i, u, at[u], rnd.random() < 0.7))
    rnd.shuffle(rows)
    return rows


def _null_first(rows):
    return [(i, -1 if u is None else u, ts, c) for i, u, ts, c in rows]


@pytest.mark.parametrize("seed, limit, ttl, cool", [(1, 1, 50, 7), (2, 2, 100, 60), (3, 3, 400, 90), (4, 5, 90, 4000)])
def test_busy_keys_without_silent_gaps(spark, seed, limit, ttl, cool):
    """One key holds most rows and is never silent for a TTL, so no walk could be split."""
    rows = _rows(seed, 900, [0, 1, 2, 5, 13, 29, 31])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    used = {r.id: r.verdict for r in qt.usage_verdicts(df, "u", "ts", "id", F.col("counted"), ttl_s=ttl, limit=limit).collect()}
    assert used == _walk_usage(_null_first(rows), ttl, limit)
    sent = {r.id: r.verdict for r in qt.send_verdicts(df, "u", "ts", "id", cooldown_s=cool, limit=limit).collect()}
    assert sent == _walk_send(_null_first(rows), cool, limit)


def test_counts_told_before_and_after(spark):
    rows = _rows(9, 400, [0, 1, 30, 59, 60, 61, 300])
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.id: (r.used_before, r.verdict, r.remaining) for r in qt.usage_verdicts(df, "u", "ts", "id", F.col("counted"), ttl_s=60).collect()}
    state = {}
    for i, u, ts, counted in sorted(_null_first(rows), key=lambda r: (r[1], r[2], r[0])):
        used, until = state.get(u, (0, None))
        used = 0 if until is None or ts >= until else used
        before, blocked = used, used >= 3
        if counted and not blocked:
            used, until = used + 1, ts + dt.timedelta(seconds=60)
        state[u] = used, until
        assert out[i] == (before, "blocked" if blocked else "allowed", max(0, 3 - used)), i


def test_odd_rows(spark):
    """No rows, rows without a time, equal rows."""
    df = spark.createDataFrame([(1, 1, T0, True), (1, 1, T0, True), (2, None, T0, None), (3, 1, None, True)], SCHEMA)
    assert sorted(r.verdict for r in qt.send_verdicts(df, "u", "ts", "id").where("u = 1 and ts is not null").collect()) == ["cooldown", "sent"]
    used = qt.usage_verdicts(df, "u", "ts", "id", F.col("counted"))
    assert sorted((r.id, r.used_before, r.remaining) for r in used.collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 3), (3, 0, 2)]
    for out in (used, qt.send_verdicts(df, "u", "ts", "id")):
        assert out.count() == 4
    assert qt.usage_verdicts(df.limit(0), "u", "ts", "id", F.col("counted")).count() == 0
    assert qt.send_verdicts(df.limit(0), "u", "ts", "id").count() == 0


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_first_after(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice((1, 2, None)), (rnd.randrange(0, 3000), i, i)) for i in range(300)]
    events = spark.createDataFrame(rows, "_k long, _e struct<us:long,tie:long,id:long>")
    for r in ch.first_after(events, width).collect():
        k, e = rows[r["id"]]
        later = [x for k2, x in rows if k2 == k and x[0] >= e[0] + width]
        assert (tuple(r["next"]) if r["next"] else None) == min(later, default=None)
    for r in ch.following(events, width, 3).collect():
        order = sorted(x for k, x in rows if k == r["_k"])
        at = order.index(tuple(r["_e"]))
        assert [tuple(x) for x in r["then"]] == order[at + 1:at + 4]
        assert (tuple(r["previous"]) if r["previous"] else None) == (order[at - 1] if at else None)


def test_reached(spark):
    rnd = random.Random(5)
    next_ = {i: (rnd.randrange(i + 1, 200) if rnd.random() < 0.95 else None) for i in range(199)}
    next_[199] = None
    starts, want = [0, 3, 3, 190], set()
    for s in starts:
        while s is not None and s not in want:
            want.add(s)
            s = next_[s]
    pointers = spark.createDataFrame(list(next_.items()), "id long, next long")
    found = [r.id for r in ch.reached(pointers, spark.createDataFrame([(s,) for s in starts], "id long")).collect()]
    assert sorted(found) == sorted(want)
    line = spark.range(100).select("id", (F.col("id") + 1).alias("next")).where("id < 99")
    assert ch.reached(line, spark.range(1)).count() == 100


def test_no_key_is_walked():
    source = inspect.getsource(qt.usage_verdicts) + inspect.getsource(qt.send_verdicts) + inspect.getsource(ch)
    assert "mapInPandas" not in source and "applyInPandas" not in source
