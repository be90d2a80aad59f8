"""Small helpers: list picks, priority union, staged refresh, set ops."""

import os

from pyspark.sql import functions as F

from shiftwise.operators import sets, warehouse as wh
from shiftwise.operators.windows import first_or_fallback, pick_nth, top_k_per_group


def test_pick_and_fallback(spark):
    df = spark.createDataFrame([(["a", "b"], 2, None), (["a", "b"], 3, "z"), ([], 1, None)],
                               "l array<string>, n int, sel string")
    got = [(r.p, r.f) for r in df.select(pick_nth(F.col("l"), F.col("n")).alias("p"),
                                         first_or_fallback(F.col("sel"), F.col("l")).alias("f")).collect()]
    assert got == [("b", "a"), (None, "z"), (None, None)]


def test_priority_union_and_sets(spark):
    js = spark.createDataFrame([("A", "json A"), ("B", "")], "title string, summary string")
    md = spark.createDataFrame([("B", "md B"), ("C", "md C")], "title string, summary string")
    got = {r.title: r.summary for r in sets.priority_union([js, md], ["title"]).collect()}
    assert got == {"A": "json A", "B": "", "C": "md C"}
    raw = spark.createDataFrame([("E", "Exam"), ("X", "New")], "code string, description string")
    stored = spark.createDataFrame([("E", "Other text")], "code string, description string")
    assert [r.code for r in sets.new_codes(raw, stored, "code").collect()] == ["X"]
    assert spark.range(1).select(sets.distinct_set(F.array(F.lit(2), F.lit(1), F.lit(2))).alias("d")).first().d == [2, 1]


def test_staged_refresh(spark, tmp_path):
    base = str(tmp_path / "mv")
    v1 = wh.refresh_materialized(spark.range(3), base)
    v2 = wh.refresh_materialized(spark.range(5), base)
    assert v1 != v2 and wh.current_version(spark, base) == v2
    assert spark.read.parquet(v1).count() == 3 and spark.read.parquet(wh.current_version(spark, base)).count() == 5
    copy = wh.copy_table(spark.range(2), str(tmp_path / "copy"))
    assert os.path.isdir(copy) and spark.read.parquet(copy).count() == 2


def test_top_k_ties_broken_by_order(spark):
    df = spark.createDataFrame([(1, "u", 5.0), (2, "u", 5.0), (3, "u", 1.0), (4, "v", 2.0)], "id int, g string, x double")
    got = sorted(r.id for r in top_k_per_group(df, ["g"], [F.col("x").desc(), "id"], 1).collect())
    assert got == [1, 4]


def test_blend_weights_at_the_optimum(spark):
    import math
    import random

    from shiftwise.operators import ml
    rnd = random.Random(1)
    for k, rows in ((3, [(0.9, 0.5, 0.2), (0.6, 0.7, 0.3), (0.7, 0.4, 0.6)]), (3, [tuple(rnd.random() for _ in range(3)) for _ in range(50)]), (2, [(0.3, 0.3), (0.6, 0.6)]),
                    (4, [tuple(rnd.choice((0.0, 0.1, 0.9, 1.0)) for _ in range(4)) for _ in range(80)])):
        cols = [f"m{i}" for i in range(k)]
        best = ml.fit_blend_weights(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols).first()
        loss = lambda w: -sum(math.log(min(max(sum(p * x for p, x in zip(r, w)), 1e-15), 1 - 1e-15)) for r in rows) / len(rows)
        assert abs(sum(best[:k]) - 1) < 1e-9 and min(best[:k]) >= 0
        assert abs(loss(best[:k]) - best.log_loss) < 1e-9
        assert best.log_loss <= min(map(loss, ml.simplex_grid(k, 0.05))) + 1e-9
    none = ml.fit_blend_weights(spark.createDataFrame([], "a double, b double"), ["a", "b"]).first()
    assert (none.w1, none.w2, none.log_loss) == (0.5, 0.5, None)


def test_audit_update(spark, tmp_path):
    sal = spark.createDataFrame([(1, 1000.0, 0.2), (2, 1000.0, None)], "emp long, salary double, pct double")
    path = wh.update_with_audit(sal, "emp", "salary", "pct", str(tmp_path / "salary"), str(tmp_path / "log"), "2025-06-05 12:00:00")
    new = {r.emp: float(r.salary) for r in spark.read.parquet(path).collect()}
    assert new == {1: 1200.0, 2: 1020.0}
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 * 4 + 2 and log.where("log_level = 'WARNING'").count() == 1


def test_titles_match_by_containment_at_any_length(spark):
    from shiftwise.operators.matching import match_title, mention_join
    names = ["Dune", "The Hobbit", "Hobbits and more", "It", "War and Peace", "A"]
    keys = spark.createDataFrame(list(enumerate(names)), "pos int, title string")
    asked = ["dune", "hobbit", "ob", "i", "and", "peace", "xyz", "", None, "(no)", "HOBBIT", "zhobbit"]
    q = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    got = {r.id: r.matched_title for r in match_title(q, "id", "t", keys, "title", "pos").collect()}
    low = [n.lower() for n in names]

    def want(x):
        x = (x or "").lower().replace("(no)", "")
        if not x:
            return None
        return next((n for n, k in zip(names, low) if k == x), next((n for n, k in zip(names, low) if x in k), None))
    assert got == {i: want(x) for i, x in enumerate(asked)}
    texts = ["read DUNE now", "it", "a", "x", "", None, "war and peace", "the hobbits and more!"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.mentioned_title for r in mention_join(t, "id", "t", keys, "title", "pos").collect()}
    assert got == {i: next((n for n, k in zip(names, low) if x is not None and k in x.lower()), None) for i, x in enumerate(texts)}


def test_rejected_rows_take_nothing(spark):
    current = spark.createDataFrame([("old", "taken@x")], "u string, e string")
    rows = [(1, "bob", "taken@x"), (2, "bob", "new@x"), (3, "eve", "new@x"), (4, "eve", "e@x"), (5, "eve", "z@x"), (6, None, "z@x"), (7, None, None), (8, None, "z@x"), (9, "old", "taken@x")]
    got = {r.id: (r.status, r.reason) for r in wh.insert_unique(current, spark.createDataFrame(rows, "id int, u string, e string"), ["u", "e"], ["id"]).collect()}
    no, users, mails, want = ("accepted", None), {"old"}, {"taken@x"}, {}
    for i, u, e in rows:
        want[i] = ("rejected", "u taken") if u in users else ("rejected", "e taken") if e in mails else no
        if want[i] == no:
            users |= {u} - {None}
            mails |= {e} - {None}
    assert got == want


def test_rows_without_label_or_key_are_kept(spark):
    import datetime as dt

    from shiftwise.operators import ml
    from shiftwise.streaming import quotas
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(30)], "id int, label string")
    split = ml.stratified_split(docs, "label", "id", 0.2)
    assert split.count() == 30 and split.where("holdout = 1").groupBy("label").count().collect().__len__() == 2
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, None if i % 2 else "k", t0 + dt.timedelta(minutes=7 * i)) for i in range(20)], "id int, k string, ts timestamp")
    for out in (quotas.usage_verdicts(ev, "k", "ts", "id", F.lit(True)), quotas.send_verdicts(ev, "k", "ts", "id"),
                quotas.session_context(ev, "k", "ts", "id", {"v": F.col("id")})):
        assert out.count() == 20
        pairs = {(r.id // 2, r.k): r.asDict() for r in out.collect()}
        assert len({k for _, k in pairs}) == 2
    same = quotas.usage_verdicts(ev, "k", "ts", "id", F.lit(True)).groupBy("k", "verdict").count().collect()
    assert len({(r.verdict, r["count"]) for r in same if r.k is None} ^ {(r.verdict, r["count"]) for r in same if r.k is not None}) == 0


def test_request_results_are_exact(spark):
    import math

    from shiftwise.operators import requests as rq
    fib = [0, 1]
    while len(fib) < 400:
        fib.append(fib[-1] + fib[-2])
    assert [rq.fibonacci(n) for n in range(400)] == fib
    sieve = [n for n in range(2000) if n > 1 and all(n % p for p in range(2, math.isqrt(n) + 1))]
    assert [n for n in range(2000) if rq.is_prime(n)] == sieve
    assert rq.is_prime(10**18 + 3) and not rq.is_prime(3825123056546413051) and rq.is_prime(2**61 - 1)
    rows = [(1, "fibo", 90.0, None), (2, "fibo", None, None), (3, "prime", 1.0, None), (4, "pow", 7.0, 9.0), (5, "pow", 0.0, -1.0), (6, "pow", 10.0, 400.0),
            (7, "factorial", 40.0, None), (8, "factorial", -1.0, None), (9, "other", 1.0, 1.0), (10, None, 1.0, 1.0), (11, "fibo", 90.0, None), (12, "fibo", None, None)]
    df = spark.createDataFrame(rows, "id int, operation string, x double, y double")
    got = {r.id: (r.result, r.status) for r in rq.evaluate_requests(df).collect()}
    bad = (None, "invalid")
    assert got == {1: (str(fib[90]), "ok"), 2: bad, 3: bad, 4: ("40353607.0", "ok"), 5: bad, 6: bad, 7: (str(math.factorial(40)), "ok"), 8: bad, 9: bad, 10: bad, 11: (str(fib[90]), "ok"), 12: bad}
    large = spark.createDataFrame([(10**18 + 3,), (10**18 + 4,)], "x bigint").selectExpr("'prime' operation", "x", "cast(null as bigint) y")
    assert {r.x: r.result for r in rq.evaluate(large).collect()} == {10**18 + 3: "True", 10**18 + 4: "False"}
    stored = spark.createDataFrame([("fibo", 90.0, None, "from the table"), ("pow", 1.0, 1.0, "1.0")], "operation string, x double, y double, result string")
    answered, store = rq.answer(df, ["id"], stored)
    hits = {r.id: (r.cache_hit, r.result) for r in answered.collect()}
    assert hits[1] == (1, "from the table") and hits[11] == (1, "from the table") and hits[4] == (0, "40353607.0") and hits[12][0] == 1
    assert {(r.operation, r.x, r.result) for r in store.collect()} == {("pow", 7.0, "40353607.0"), ("factorial", 40.0, str(math.factorial(40)))}
    events = {r.id: r.result for r in rq.request_events(answered).collect()}
    assert events == {4: "40353607.0", 7: str(math.factorial(40))}


def test_nearest_vectors_of_any_id_and_number(spark):
    import numpy as np

    from shiftwise.operators.vectors import knn
    rng = np.random.default_rng(1)
    vecs = [(f"book_{i % 60}", [float(x) for x in rng.integers(0, 3, 4)]) for i in range(60)]
    asked = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(50)]
    out = knn(spark.createDataFrame(vecs, "id string, v array<double>"), "id", "v", spark.createDataFrame(asked, "q int, qv array<float>"), "q", "qv", 5, query_block=7, vector_block=11)
    got = {(r.query_id, r["rank"]): (r.distance, r.id) for r in out.collect()}
    want = {(q, i + 1): x for q, qv in asked for i, x in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(v, qv)), n) for n, v in vecs)[:5])}
    assert got == want
