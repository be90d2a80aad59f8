"""The pattern grammar clause by clause, learning on held-out rows, and odd texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiftwise.llm import queries, toxicity
from shiftwise.llm.toxicity import KINDS, Lexicon, Reader, Tokens

NONE = (np.zeros(0, np.uint64), np.zeros(0))


def kinds(text):
    sums = Reader(Lexicon(*NONE))(pa.array([text]))[0]
    return {k for k, x in zip(KINDS, sums) if x > 0}


@pytest.mark.parametrize("text, found", [
    ("what a beautiful day", set()), ("the idiot came", {"plain"}), ("you are such an IDIOT", {"aimed"}), ("Idiot, you", {"aimed"}), ("an idiot came here long before you", {"plain"}),
    ("he is not an idiot", {"denied"}), ("she said he was an idiot", {"told"}), ("she said so. idiot", {"plain"}), ("I will kill you", {"threat"}), ("to kill the time", {"loose"}),
    ("never hurt them", {"denied"}), ("not at all what an idiot", {"plain"}), ("kein Trottel", {"denied"}), ("eres un IMBÉCIL tú", {"aimed"}), ("idiot moron", {"plain"}), ("idiot### is%%%", {"plain"}),
    ("«idiot»", {"plain"}), ("idiotic", set()), ("", set()),
])
def test_clauses(text, found):
    assert kinds(text) == found


def test_nearer_targets_weigh_more():
    read = Reader(Lexicon(*NONE))
    near, far = read(pa.array(["you idiot", "you are such an idiot"]))[:, KINDS.index("aimed")]
    assert near > far > 0


def test_composition_reads_like_its_parts():
    """The composed table gives what the three transducers give one after the other."""
    rng = np.random.default_rng(3)
    parts, whole = (toxicity.negation(), toxicity.reporting(), toxicity.aiming()), toxicity.grammar()
    for _ in range(300):
        words = [*rng.integers(0, 6, rng.integers(0, 12)).tolist(), toxicity.END]
        states, at = [p.start for p in parts], whole.start
        for x in words:
            at, out, weight = whole.arcs[at, x]
            total = 0.0
            for i, p in enumerate(parts):
                states[i], x, w = p.arcs[states[i], x]
                total += w
            assert (x, pytest.approx(total)) == (out, weight)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"word{i} né{i % 7}. you idiot" if i % 5 == 0 else f"word{i}" for i in range(3000))
    whole = Reader(Lexicon(*NONE))(pa.array([text, "moron", None]).fill_null(""))
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert np.allclose(Reader(Lexicon(*NONE))(pa.array([text, "moron", None])), whole)
    assert sum(b - a for a, b in toxicity._cut(np.full(5000, 97, np.uint8), 0, 5000)) == 5000


def test_words():
    text = "Éa <b>don't «x» A1—b".encode()
    t = Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [text[a:b].decode() for a, b in zip(t.starts, t.ends)] == ["Éa", "b", "don", "t", "x", "A1", "b"]
    other = "éA".encode()
    assert t.hashes[0] == Tokens(np.frombuffer(other, np.uint8), np.array([0, len(other)])).hashes[0]


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return rows.where("held_out and toxic is not null").toPandas()


def test_held_out_accuracy(scored):
    hit = scored.predicted == scored.toxic
    assert len(scored) > 700 and hit.mean() > 0.97
    assert hit[scored.toxic == 1].mean() > 0.85 and hit[scored.toxic == 0].mean() > 0.99


def test_held_out_labels_are_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, turned))
    assert first == second and len(first) == docs.count()


def test_odd_documents(spark, edge_docs, no_docs, edge_rows):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (13, 0), (13, 1), (99, 1)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(edge_docs, labels).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((x[0] is not None, x[0] or 0) for x in edge_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    bare = toxicity.score(edge_docs.unionByName(edge_docs.limit(1).withColumn("text", F.lit("you idiot, you worthless moron"))), toxicity.learn(no_docs, labels.limit(0), ~toxicity.held_out()))
    assert bare.agg(F.sum("predicted")).first()[0] == 1
