"""Streams in several files and micro-batches, rows out of order: state between batches, expiry, late rows."""

import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftwise.operators.routing import route_features, route_stream
from shiftwise.plans.streams import event_queries
from shiftwise.streaming import stateful as st
from shiftwise.streaming.quotas import session_context
from tests.test_streaming import SMALL, _run

END = "2030-01-01 00:00:00"


def in_files(rows, ts, files=5):
    """Rows dealt to files by time, neighbours swapped within minutes, then a row far in the future that makes all others due."""
    folder = tempfile.mkdtemp(prefix="sw-files-")
    order = rows.withColumn("_n", F.ntile(files).over(Window.orderBy(F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.hash(ts), F.lit(40))))))
    for i in range(1, files + 1):
        order.where(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(folder)
    last = rows.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.lit(END).cast(rows.schema[ts].dataType))
    for c in ("user_id", "event_id"):
        last = last.withColumn(c, F.lit(-1).cast(rows.schema[c].dataType))
    last.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet").where("user_id < 60")


def test_routing_with_expiry(spark, events):
    rows = event_queries(events)
    batch = route_features(rows, "user_id", ["ts", "event_id"], "event_id", ts="ts")
    got = _run(route_stream(stream(spark, in_files(rows, "ts")), "user_id", "ts", "event_id", watermark="2 hours"), "route_stream").where("event_id >= 0")
    cols = ["event_id", "user_id", "status", "selected_title", "context_title"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, batch.select(*cols).collect()))
    assert {"blocked", "candidates", "need_title", "followup", "ordinal_pick"} <= {r.status for r in batch.select("status").distinct().collect()}


@pytest.mark.parametrize("nulls_overwrite", [True, False])
def test_context_variants(spark, events, nulls_overwrite):
    """Written NULLs overwrite in variant B only."""
    fields = {"v": (F.col("event_type").isin("view", "error"), F.when(F.col("event_type") == "view", F.col("value"))), "p": F.when(F.col("event_type") == "purchase", F.col("value"))}
    batch = session_context(events, "user_id", "ts", "event_id", fields, 3600 * 6, nulls_overwrite=nulls_overwrite)
    found = st.session_context_stream(stream(spark, in_files(events, "ts")), "user_id", "ts", "event_id", fields, 3600 * 6, watermark="2 hours", nulls_overwrite=nulls_overwrite)
    got = _run(found, f"ctx_{nulls_overwrite}").where("event_id >= 0")
    assert sorted(map(str, got.select("event_id", "v", "p").collect())) == sorted(map(str, batch.select("event_id", "v", "p").collect()))


def test_only_updates_renew(spark):
    """Variant A: reads don't renew, the context ends one TTL after the last update."""
    base = "2024-01-01 00:00:00"
    rows = spark.createDataFrame([(i, 1, m, x) for i, (m, x) in enumerate([(0, 5.0), (20, None), (29, None), (31, None), (40, 7.0), (69, None), (71, None)])], "event_id long, user_id long, m int, value double")
    rows = rows.withColumn("ts", F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))).drop("m")
    found = st.session_context_stream(stream(spark, in_files(rows, "ts", 3)), "user_id", "ts", "event_id", {"v": F.col("value")}, 1800, strict_gap=False, watermark="1 hour",
                                      nulls_overwrite=False, renews=F.col("value").isNotNull())
    got = {r.event_id: r.v for r in _run(found, "ctx_a").where("event_id >= 0").collect()}
    assert got == {0: 5.0, 1: 5.0, 2: 5.0, 3: None, 4: 7.0, 5: 7.0, 6: None}
