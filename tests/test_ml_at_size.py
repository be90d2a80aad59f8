"""What the text operators hold in a task or move between tasks does not follow the size of the tables."""
import math
import random

import numpy as np
import pyarrow as pa

from shiftwise.operators import ml
from shiftwise.operators import word_vectors as wv

RND = random.Random(5)
WORDS = {lang: [f"{lang}{i}" for i in range(60)] for lang in ("aa", "bb")}


def _texts(n, k=20):
    return [(i, lang := ("aa", "bb")[i % 2], " ".join(RND.choices(WORDS[lang], k=k))) for i in range(n)]


def test_word_vectors_of_any_vocabulary(spark, monkeypatch):
    """vectors are a table, trained and joined by blocks; means as a plain loop finds them; empty and null texts."""
    monkeypatch.setattr(wv, "BLOCK_BYTES", 2000)
    rows = [*((i, t) for i, _, t in _texts(60)), (100, ""), (101, None), (102, "zz9 zz9 once"), (102, "zz9 zz9 once"), (None, "aa1 unseen")]
    df = spark.createDataFrame(rows, "id long, text string")
    model = wv.WordVectors("text", "features", size=4, min_count=3).fit(df)
    vectors = {r.word: np.array(r.v) for r in model.vectors.collect()}
    assert "zz9" in vectors and "once" not in vectors and "unseen" not in vectors
    got = model.transform(df)
    assert got.columns == ["id", "text", "features"]
    found = [(r.id, r.text, r.features.toArray()) for r in got.collect()]
    assert sorted(map(str, [x[:2] for x in found])) == sorted(map(str, rows))
    for _, text, mean in found:
        words = (text or "").split()
        want = sum((vectors.get(w, np.zeros(4)) for w in words), np.zeros(4)) / max(1, len(words))
        assert np.allclose(mean, want, atol=1e-6)
    assert model.transform(df.limit(0)).count() == 0


def test_embedding_mlp_learns(spark):
    df = spark.createDataFrame(_texts(400, 100), "id long, lang string, text string").coalesce(1)
    model = ml.fit_embedding_mlp(df, "text", "lang", vector_size=8, hidden=4, max_iter=100)
    assert model.stages[0].labels == ["aa", "bb"]
    right = [model.stages[0].labels[int(r.prediction)] == r.lang for r in model.transform(df).collect()]
    assert len(right) == 400 and sum(right) >= 380


def test_training_brings_neighbours_together():
    words = pa.array([f"w{i}" for i in range(20)])
    rng = np.random.default_rng(1)
    code = np.concatenate([rng.integers(0, 10, 30) + 10 * (i % 2) for i in range(2000)])
    v = wv.train_block(code, np.repeat(np.arange(2000), 30), np.bincount(code), wv.first_vectors(words, 8, 42), 5, 0.05, 42)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T
    assert near[:10, :10].mean() > near[:10, 10:].mean() + 0.3


def test_split_moves_no_texts(spark):
    """a row is joined with its class alone; of each class the rows of the smallest hashes are held out."""
    import hashlib
    rows = [(i if i % 11 else None, ("x", "y", None)[i % 3]) for i in range(400)] + [(5000, "only")]
    got = ml.stratified_split(spark.createDataFrame(rows, "id long, label string"), "label", "id", 0.2).collect()
    assert len(got) == len(rows)
    for label in ("x", "y", None, "only"):
        mine = [r for r in got if r.label == label]
        held = [hashlib.md5(f"42:{'' if r.id is None else r.id}".encode()).hexdigest() for r in mine if r.holdout]
        rest = [hashlib.md5(f"42:{'' if r.id is None else r.id}".encode()).hexdigest() for r in mine if not r.holdout]
        assert len(held) == math.floor(0.2 * len(mine) + 0.5) and (not held or max(held) <= min(rest))


def test_split_shuffles_no_texts(spark):
    """texts pass an exchange only with the rows of the bucket that the cut-off lies in."""
    rows = [(i, ("x", "y", None)[i % 3], f"text {i} " * 50) for i in range(300)]
    split = ml.stratified_split(spark.createDataFrame(rows, "id long, label string, text string"), "label", "id", 0.2)
    kept = split.where("holdout = 0").select("text")
    assert kept.count() == 240
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_trained_vectors_travel_as_floats():
    """a word of a block is its count and an array of floats, whose weighted mean is the word's vector."""
    lists = pa.RecordBatch.from_arrays([pa.array([["a", "b", "a", "c"], None, ["b"]], pa.list_(pa.string()))], names=["_w"])
    out, = wv._train(4, 5, 0.05, 42, 1000)(iter([lists]))
    assert out.schema.names == ["word", "n", "v"] and out.schema.field("v").type == pa.list_(pa.float32())
    assert dict(zip(out["word"].to_pylist(), out["n"].to_pylist())) == {"a": 2, "b": 2, "c": 1} and all(len(x) == 4 for x in out["v"].to_pylist())


def test_classifier_trains_on_a_partition_a_core(spark, monkeypatch):
    """the partitions that every iteration sends a slope from do not grow with the table's."""
    from pyspark.ml.tuning import CrossValidator
    seen, fit = [], CrossValidator.fit
    monkeypatch.setattr(CrossValidator, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame(_texts(80), "id long, lang string, text string").repartition(3 * cores)
    ml.fit_text_classifier(df, "text", "lang", n_range=1, vocab_size=256, reg_params=(0.01,), folds=2, hashed=True, max_iter=3)
    assert seen and seen[0] <= cores


def test_term_weights_by_shares_of_text(spark, monkeypatch):
    """as many partitions as the text has shares; common and rare terms, null and repeated ids as a plain count finds them."""
    monkeypatch.setattr(ml, "TEXT_SHARE", 200)
    monkeypatch.setattr(ml, "COMMON", 3)
    rows = [*((i, t + " the") for i, _, t in _texts(30)), (3, "the the aa1 new"), (None, "the rare"), (None, "rare word"), (70, ""), (71, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    made = ml.term_weights(df, "id", "text")
    assert made.rdd.getNumPartitions() >= sum(len(t or "") for _, t in rows) // 200
    tf = {}
    for i, t in rows:
        for w in (t or "").split():
            tf[i, w] = tf.get((i, w), 0) + 1
    dfs = {}
    for _, w in tf:
        dfs[w] = dfs.get(w, 0) + 1
    n = len({i for i, _ in rows})
    raw = {k: v * (math.log((1 + n) / (1 + dfs[k[1]])) + 1) for k, v in tf.items()}
    got = made.collect()
    assert {(r.id, r.term): (r.tf, r.df) for r in got} == {k: (v, dfs[k[1]]) for k, v in tf.items()} and len(got) == len(tf)
    for r in got:
        assert abs(r.weight - raw[r.id, r.term] / math.sqrt(sum(x * x for (i, _), x in raw.items() if i == r.id))) < 1e-9
