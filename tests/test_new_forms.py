"""Repeatable sinks, a cache on a stream, automata, code validity by interval join, stored history, capped vocabularies."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shiftwise.operators import automata, ml
from shiftwise.operators import requests as rq
from shiftwise.operators import warehouse as wh
from shiftwise.operators.matching import mention_join
from shiftwise.sources.sinks import append_once
from shiftwise.streaming import quotas as qt
from shiftwise.streaming import stateful as st
from tests.test_ordered_streams import in_files, stream
from tests.test_streaming import SMALL, _run


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for n, batch in ((5, 0), (3, 1), (5, 0), (3, 1)):
        append_once(spark.range(n), path, batch)
    assert spark.read.parquet(path).count() == 8


def test_cache_on_a_stream(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(("fibo", "factorial", "prime", "pow")), rnd.randrange(-1, 12), rnd.randrange(0, 3)) for i in range(120)]
    source, cache, answers = (str(tmp_path / x) for x in ("in", "cache", "answers"))
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i:i + 40], "id long, operation string, x long, y long").coalesce(1).write.mode("append").parquet(source)
    requests = spark.readStream.schema("id long, operation string, x long, y long").option("maxFilesPerTrigger", 1).parquet(source)
    writer = rq.answer_stream(requests, ["id"], cache, answers)
    for ckpt in ("a", "b"):  # the second run replays every batch from the start
        q = writer.option("checkpointLocation", str(tmp_path / ckpt)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        got = spark.read.parquet(answers)
        want, fresh = rq.answer(spark.createDataFrame(rows, "id long, operation string, x long, y long"), ["id"], spark.createDataFrame([], "operation string, x long, y long, result string"))
        cols = ["id", "result", "status", F.when(F.col("status") == "ok", F.col("cache_hit")).alias("hit")]  # invalid inputs are never stored
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
        assert sorted(map(str, spark.read.parquet(cache).drop("batch_no").collect())) == sorted(map(str, fresh.collect()))


@pytest.mark.parametrize("shard, piece", [(1 << 20, 1 << 25), (40, 300)])
def test_keys_in_texts(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(automata, "SHARD_CHARS", shard)
    monkeypatch.setattr(automata, "SLICE_CHARS", piece)
    rnd = random.Random(3)
    keys = [("".join(rnd.choice("abÉ ") for _ in range(rnd.randrange(1, 6))), i) for i in range(60)] + [("ABA", 200), (None, 201)]
    texts = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(0, 40)))) for i in range(80)] + [(100, None), (101, ""), (102, "x" * 100_000 + "ab")]
    k = spark.createDataFrame(keys, "title string, pos long")
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    for extra in ([], [("", 30)]):
        kk = k.unionByName(spark.createDataFrame(extra, "title string, pos long")) if extra else k
        got = {r.id: r.mentioned_title for r in mention_join(t, "id", "text", kk, "title", "pos").collect()}
        for i, text in texts:
            want = min(((p, x) for x, p in [*keys, *extra] if x is not None and text is not None and x.lower() in text.lower()), default=(None, None))[1]
            assert got[i] == want, (i, text)
    assert mention_join(t, "id", "text", k.limit(0), "title", "pos").where("mentioned_title is not null").count() == 0


def _codes(spark):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id < 60")
    issues = ev.where("event_type = 'signup'").select("event_id", "user_id", "ts", F.lit(1).cast("long").alias("code"))
    attempts = ev.where("event_type in ('click', 'view', 'error')").select("event_id", "user_id", "ts", (F.col("event_id") % 3 > 0).cast("long").alias("code"))
    return issues, attempts


def test_codes_by_interval_join(spark):
    issues, attempts = _codes(spark)
    batch = qt.valid_within(issues, attempts, "user_id", "ts", "code", "event_id", ttl_s=36_000)
    found = st.valid_within_stream(stream(spark, in_files(issues, "ts", 3)), stream(spark, in_files(attempts, "ts", 3)), "user_id", "ts", "code", "event_id", watermark="2 hours", ttl_s=36_000)
    got = _run(found, "interval_codes").where("event_id >= 0")
    cols = ["event_id", "issue_id", "valid"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, batch.select(*cols).collect()))
    assert batch.where("valid = 1").count() > 5


def test_spent_codes_on_a_stream(spark):
    issues, attempts = _codes(spark)
    batch = qt.valid_within(issues, attempts, "user_id", "ts", "code", "event_id", ttl_s=36_000, invalidate_on_use=True)
    both = issues.withColumn("kind", F.lit("issue")).unionByName(attempts.withColumn("kind", F.lit("attempt")))
    found = st.validity_stream(stream(spark, in_files(both, "ts")), "user_id", "ts", "event_id", "kind", "code", watermark="2 hours", ttl_s=36_000, invalidate_on_use=True)
    got = _run(found, "spent_stream").where("event_id >= 0")
    assert sorted(map(tuple, got.select("event_id", "valid").collect())) == sorted(map(tuple, batch.select("event_id", "valid").collect()))
    once = qt.valid_within(issues, attempts, "user_id", "ts", "code", "event_id", ttl_s=36_000)
    assert 0 < batch.where("valid = 1").count() < once.where("valid = 1").count()


def test_stored_history(spark):
    """Batches of several snapshots, one run twice; closed rows stay as they were written."""
    path = tempfile.mkdtemp(prefix="sw-scd-") + "/history"
    rnd = random.Random(4)
    plain, days = {}, [f"2024-01-{d:02d} 00:00:00" for d in range(1, 9)]
    for batch in range(4):
        rows = []
        for day in days[2 * batch:2 * batch + 2]:
            for key in range(12):
                if rnd.random() < 0.7:
                    value = rnd.choice([None, "a", "b"])
                    rows.append((key, value, day))
                    versions = plain.setdefault(key, [])
                    if not versions or versions[-1][0] != value:
                        if versions:
                            versions[-1][2] = day
                        versions.append([value, day, None])
        snap = spark.createDataFrame(rows, "k long, v string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
        for _ in range(2 if batch == 2 else 1):
            wh.scd2_store(spark, path, snap, ["k"], ["v"], "at", batch)
    got = spark.read.parquet(path)
    want = sorted((k, str(v), a, str(e)) for k, x in plain.items() for v, a, e in x)
    assert sorted((r.k, str(r.v), str(r.start_ts), str(r.end_ts)) for r in got.collect()) == want
    assert got.where("is_active = 'Y'").count() == len(plain) == got.where("is_active = 'Y'").select("k").distinct().count()
    assert got.select("history_id").distinct().count() == got.count()


def test_capped_terms(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb cc"), (3, ""), (4, None), (5, "dd ee bb cc")], "id long, text string")
    got = {(r.id, r.term): r.tf for r in ml.term_weights(docs, "id", "text", (1, 2), 3).collect()}
    assert got == {(1, "bb"): 1, (1, "cc"): 1, (1, "aa"): 2, (2, "bb"): 1, (2, "cc"): 1, (5, "bb"): 1, (5, "cc"): 1}


def test_one_pass_checks(spark):
    """All checks of a table at once find what each finds alone; duplicates and nulls in keys, an empty table."""
    from shiftwise.operators import quality as qc
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 1, "a", 6), (1, 2, None, None), (None, 1, "bbb", 7), (None, 1, "b", 5), (2, 2, "cccc", 9), (2, 2, "c", 9), (2, 2, "c", 9)], "k long, n long, s string, f long")
    parent = spark.createDataFrame([(5,), (5,), (7,), (None,)], "f long")
    checks = {"null_s": qc.not_null("s"), "long_s": qc.too_long("s", 2)}
    for rows in (df, df.limit(0)):
        alone = [qc.check_primary_key(rows, ["k", "n"], "pk"), qc.check_foreign_key(rows, parent, "f", "f", "fk"), qc.row_checks(rows, checks)]
        want = {r.check_name: r.violations for x in alone for r in x.collect()}
        got = qc.check_table(rows, ("pk", ["k", "n"]), checks, [("fk", "f", parent, "f")])
        assert {r.check_name: r.violations for r in got.collect()} == want
        without = qc.check_table(rows, None, checks, [("fk", "f", parent, "f")])
        assert {r.check_name: r.violations for r in without.collect()} == {k: v for k, v in want.items() if k != "pk"}


def test_offensive_words_of_a_list(spark):
    """A list joined by value flags what the fixed list flags."""
    from shiftwise.functions.text import OFFENSIVE_WORDS, is_offensive_tokens
    from shiftwise.operators.matching import offensive_by_list
    texts = spark.createDataFrame([(1, "Esti un BOU!"), (2, "boul nu"), (3, None), (4, ""), (5, "bou bou dracu"), (None, "tâmpit")], "id long, text string")
    words = spark.createDataFrame([(w,) for w in [*OFFENSIVE_WORDS, None, "zzz"]], "w string")
    got = {(r.id, r.text): r.offensive for r in offensive_by_list(texts, "id", "text", words, "w").collect()}
    assert got == {(r.id, r.text): bool(r.o) for r in texts.withColumn("o", is_offensive_tokens("text")).collect()}
