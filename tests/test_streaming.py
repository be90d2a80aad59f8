"""Streams over the events table give the same answers as the batch operators."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from shiftwise.streaming import quotas as qt
from shiftwise.streaming import stateful as st

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events_dir():
    d = tempfile.mkdtemp(prefix="sw-stream-")
    shutil.copy(os.path.join(SMALL, "events.parquet"), os.path.join(d, "part-0.parquet"))
    return d


@pytest.fixture(scope="module")
def closed_dir(spark, events_dir):
    """The events and, in a later file, one far in the future: the watermark passes all others, so that held rows are handed on."""
    d = tempfile.mkdtemp(prefix="sw-stream-")
    shutil.copy(os.path.join(events_dir, "part-0.parquet"), os.path.join(d, "part-0.parquet"))
    ev = spark.read.parquet(events_dir)
    last = ev.limit(1).withColumns({"ts": F.lit("2030-01-01 00:00:00").cast(ev.schema["ts"].dataType), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long"), "event_type": F.lit("click")})
    last.coalesce(1).write.mode("append").parquet(d)
    return d


def _run(df, name, mode="append"):
    ckpt = tempfile.mkdtemp(prefix=f"sw-ckpt-{name}-")
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None, q.exception()
    return df.sparkSession.table(name)


def _stream(spark, events_dir):
    schema = spark.read.parquet(events_dir).schema
    return spark.readStream.schema(schema).parquet(events_dir)


def test_usage_verdicts_stream_equals_batch(spark, events_dir):
    batch = qt.usage_verdicts(spark.read.parquet(events_dir), "user_id", "ts", "event_id",
                              F.col("event_type") == "purchase")
    stream = st.usage_verdicts_stream(_stream(spark, events_dir), "user_id", "ts", "event_id",
                                      F.col("event_type") == "purchase")
    got = _run(stream, "uv_stream")
    cols = ["event_id", "used_before", "verdict", "remaining"]
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert got.where("verdict = 'blocked'").count() > 0


def test_usage_sessions_stream_finalized_equal_batch(spark, events_dir):
    ev = spark.read.parquet(events_dir).where("event_type = 'purchase'")
    batch = qt.usage_sessions(ev, "user_id", "ts")
    stream = st.usage_sessions_stream(_stream(spark, events_dir).where("event_type = 'purchase'"),
                                      "user_id", "ts", watermark="1 day")
    got = _run(stream, "us_stream")
    max_ts = ev.agg(F.max("ts")).collect()[0][0]
    cols = ["user_id", "first_use", "uses", "verdict"]
    emitted = sorted(got.select(*cols).collect())
    assert emitted, "no session finalized"
    final = batch.where(F.col("expires") <= F.lit(max_ts) - F.expr("INTERVAL 1 DAY"))
    assert set(emitted) >= set(final.select(*cols).collect())
    assert set(emitted) <= set(batch.select(*cols).collect())


def test_validity_stream_equals_batch(spark, events_dir, closed_dir):
    ev = spark.read.parquet(events_dir).select(
        "event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("code"))
    issues = ev.where("event_type = 'signup'").select("event_id", "user_id", "ts", "code")
    attempts = ev.where("event_type = 'click'").select("event_id", "user_id", "ts", "code")
    batch = qt.valid_within(issues, attempts, "user_id", "ts", "code", "event_id")
    sev = _stream(spark, closed_dir).where("event_type IN ('signup', 'click')").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", "issue").otherwise("attempt").alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("code"))
    got = _run(st.validity_stream(sev, "user_id", "ts", "event_id", "kind", "code"), "val_stream").where("event_id >= 0")
    assert sorted(got.select("event_id", "valid").collect()) == sorted(batch.select("event_id", "valid").collect())


def test_dedup_stream(spark, events_dir):
    s = _stream(spark, events_dir).select("event_type", "user_id", "ts")
    got = _run(st.dedup_requests_stream(s, ["event_type", "user_id"], "ts", "365 days"), "dd_stream")
    exp = spark.read.parquet(events_dir).select("event_type", "user_id").distinct().count()
    assert got.count() == exp


def test_send_verdicts_stream_equals_batch(spark, events_dir):
    batch = qt.send_verdicts(spark.read.parquet(events_dir), "user_id", "ts", "event_id")
    got = _run(st.send_verdicts_stream(_stream(spark, events_dir), "user_id", "ts", "event_id"), "sv_stream")
    assert sorted(got.select("event_id", "verdict").collect()) == sorted(batch.select("event_id", "verdict").collect())


def test_session_context_stream_equals_batch(spark, events_dir, closed_dir):
    ev = spark.read.parquet(events_dir)
    fields = {"last_view_value": F.when(F.col("event_type") == "view", F.col("value")),
              "last_purchase_value": F.when(F.col("event_type") == "purchase", F.col("value"))}
    batch = qt.session_context(ev, "user_id", "ts", "event_id", fields, ttl_s=3600)
    got = _run(st.session_context_stream(_stream(spark, closed_dir), "user_id", "ts", "event_id", fields,
                                         ttl_s=3600), "ctx_stream").where("event_id >= 0")
    cols = ["event_id", "ctx_session", "last_view_value", "last_purchase_value"]
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_request_events_stream(spark, events_dir):
    s = _stream(spark, events_dir).select(
        "ts", F.when(F.col("event_type") == "click", "prime").otherwise(F.col("event_type")).alias("operation"),
        F.col("user_id").alias("x"))
    got = _run(st.request_events_stream(s, "operation", ["x"], "ts", "365 days"), "re_stream")
    ev = spark.read.parquet(events_dir)
    exp = ev.where("event_type = 'click'").count() + ev.where("event_type <> 'click'").select(
        "event_type", "user_id").distinct().count()
    assert got.count() == exp
