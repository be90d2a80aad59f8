"""The pipeline and its stages against plain versions of them."""

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from shiftwise.llm import queries
from tests.llm import brute
from tests.llm.test_documents import check_packing


def brute_texts(rows):
    """rows: (doc_id, text, lang), ids all different -> (doc_id, n, words kept) of the documents that are packed."""
    good = {q[0] for q in brute.quality(rows) if q[-1]}
    rows = [(d, t) for d, t, _ in rows if d in good]
    first = {d for d, _, c, _ in brute.jaccard_join(rows) if d == c}
    return brute.kept_words([(d, t) for d, t in rows if d in first])


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    bpe = Tokenizer.from_file(queries.word_bpe()["tokenizer"])
    got = corpus_pipeline.run(spark, folder).collect()
    # words are what the tokenizer sees: white space is dropped
    padding, total = check_packing(got, [(d, brute.token_ids(bpe, " ".join(k))) for d, _, k in brute_texts(rows)], 2048)
    assert padding <= 0.02 * total + 2048


def test_stages_keep_all_columns(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.schema.simpleString() == docs.schema.simpleString(), name
            out.write.format("noop").mode("overwrite").save()


def test_staged_tables_are_made_in_small_batches(spark):
    """A worker gets a bounded number of rows at a time; the session's own setting stays, and counts where it is smaller."""
    import pyarrow as pa

    from shiftwise.llm import staging

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    key, df = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 5000, 1, 1)
    held = spark.conf.get(key)
    try:
        for own, most in ((held, staging.BATCH_ROWS), ("0", staging.BATCH_ROWS), ("300", 300)):
            spark.conf.set(key, own)
            found = [r.n for r in staging.stage(df.mapInArrow(sizes, "n bigint"), "batches").collect()]
            assert sum(found) == 5000 and max(found) <= most and spark.conf.get(key) == own
    finally:
        spark.conf.set(key, held)
