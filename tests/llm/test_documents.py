"""Operators on documents against their plain versions."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftwise.llm import ngram_join, packing, pieces, quality_rules, queries, sharding, substring_dedup, token_files, tokens, words
from shiftwise.llm.staging import folder
from tests.llm import brute


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ words


def test_words_and_windows():
    texts = ["a  b c\n d", None, "", " \t", "é ü\x0bx", "one"] * 3
    w = words.Words(pa.array(texts))
    found = [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert found == [brute.words(t) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for t in found for x in t})
    assert (words.long_windows(h, 3)[:6] == words.long_windows(np.concatenate([h[:4], h]), 3)[4:10]).all()


@pytest.mark.parametrize("k", [1, 2, 5, 25, 50])
def test_sliding(k):
    v = np.random.default_rng(k).integers(0, 1000, 90).astype(np.uint64)
    assert words.sliding(v, k).tolist() == [min(v[i:i + k]) for i in range(len(v))]


@pytest.mark.parametrize("k", [1, 2, 5, 25, 50])
def test_sliding_over_few(k):
    for n in range(61):
        v = np.random.default_rng(n).integers(0, 1000, n).astype(np.uint64)
        for op, plain in ((np.minimum, min), (np.maximum, max)):
            assert words.sliding(v, k, op).tolist() == [plain(v[i:i + k]) for i in range(n)]


# ---------------------------------------------------------- quality rules


def quality_of(df):
    out = quality_rules.judge(df, ["doc_id"]).drop("class_distance", "word_distance")
    return Counter(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())


@pytest.mark.parametrize("name", ["documents", "edge_docs"])
def test_quality_rules(name, request):
    df = request.getfixturevalue(name)
    assert quality_of(df) == Counter(brute.quality([tuple(r) for r in df.select("doc_id", "text", "lang").collect()]))


def test_quality_keep(edge_docs, no_docs):
    kept = Counter(r[0] for r in brute.quality([tuple(r) for r in edge_docs.select("doc_id", "text", "lang").collect()]) if r[-1])
    out = quality_rules.keep(edge_docs)
    assert out.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == kept
    assert quality_rules.keep(no_docs).count() == 0
    assert quality_rules.judge(no_docs, ["doc_id"]).count() == 0


def each_language(rows):
    """brute.quality of every language by itself."""
    langs = {lang for *_, lang in rows}
    return Counter(x for key in langs for x in brute.quality([r for r in rows if r[2] == key]))


def test_rare_languages_have_their_own_references(spark):
    def text(lang, i, n=400):
        rng = np.random.default_rng(i)
        return " ".join(f"{lang}{j}" for j in rng.integers(0, 90, n))
    docs = [(i, "a few words", "en") for i in range(4500)] + [(9000 + i, text(lang, i), lang) for lang in ("xx", "yy", "zz", "") for i in range(4)]
    docs += [(9100, text("other", 1), "xx"), (9101, "#$% &* " * 100, "yy"), (9102, None, "none"), (9103, text("lone", 1), "vv"), (9104, text("null", 2), None), (9105, None, None), (9106, text("xx", 1), "xx")]
    df = spark.createDataFrame([(*r, "?") for r in docs], "doc_id bigint, text string, lang string, reference string").repartition(3)
    want = each_language(docs)
    assert quality_of(df) == want
    kept = Counter(x[0] for x in want.elements() if x[-1])
    assert kept[9000] and kept[9103] and not kept[9101]
    out = quality_rules.keep(df)
    assert out.columns == df.columns and Counter(r["doc_id"] for r in out.collect()) == kept


def test_rare_languages_agree_with_sql(spark):
    """The SQL gives every language a reference of its own, too."""
    import duckdb

    from shiftwise.llm import oracles
    rng = np.random.default_rng(5)
    docs = [(i, "a few words", "en") for i in range(2500)] + [(3000 + i, " ".join(f"{lang}{j}" for j in rng.integers(0, 60 if i % 3 else 900, 300)), lang) for lang in ("xx", "yy") for i in range(2)] + [(4000, "x y " * 100, None)]
    rows = quality_rules.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), ["doc_id"])
    got = Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows.collect())
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang"), map(list, zip(*docs))))))
    found = con.execute(oracles.QUALITY)
    order = [[d[0] for d in found.description].index(c) for c in rows.columns]
    assert Counter(tuple(r[i] for i in order) for r in found.fetchall()) == got


@pytest.mark.parametrize("name, share", [("documents", 64 << 20), ("documents", 20_000), ("edge_docs", 64 << 20)])
def test_both_ways_to_a_reference_agree(name, share, request, monkeypatch):
    monkeypatch.setattr(quality_rules, "RARE_BYTES", share)  # a language in several shares
    df = request.getfixturevalue(name)
    def judged(rules):
        return Counter((r["doc_id"], r["kept"], round(r["class_distance"], 9), round(r["word_distance"], 9)) for r in quality_rules.judge(df, ["doc_id"], rules).collect())
    assert judged(quality_rules.Rules(language_share=2.0)) == judged(quality_rules.Rules())


def test_js_distance_bounds():
    same = quality_rules.js_distance(np.array([[1, 3], [0, 0]]), np.array([0.25, 0.75]))
    assert same.tolist() == [0.0, 0.0]
    assert quality_rules.js_distance(np.array([[5, 0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1)


# ----------------------------------------------------------- Jaccard join


@pytest.mark.parametrize("name,how", [("documents", {}), ("edge_docs", {}), ("edge_docs", {"region_rows": 2, "region_shingles": 50, "levels": 2})])
def test_jaccard_join(name, how, request):
    df = request.getfixturevalue(name)
    assert rows(ngram_join.join(df, **how)) == Counter(brute.jaccard_join(pairs(df)))


def test_jaccard_join_cuts_one_large_family(spark):
    """A family too large for a region: pivots, cells and guests, then the even deal."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        own = list(base)
        for j in rng.integers(0, len(own), rng.integers(0, 9)):
            own[j] = f"n{rng.integers(0, 4)}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = Counter(brute.jaccard_join(texts))
    assert 1 < len({r[2] for r in want}) < 150
    for how in ({"region_rows": 20}, {"region_rows": 10, "levels": 1}, {"region_rows": 16, "region_shingles": 1500, "levels": 0}):
        assert rows(ngram_join.join(df, **how)) == want


def test_keep_first(edge_docs, no_docs):
    out = ngram_join.keep_first(edge_docs)
    assert out.columns == edge_docs.columns
    found = zip(pairs(edge_docs), brute.jaccard_join(pairs(edge_docs)))
    want = {(d, brute.shingles(t)) for (d, t), (_, n, c, _) in found if d is None or d == c}
    got = [(r["doc_id"], brute.shingles(r["text"])) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ngram_join.keep_first(no_docs).count() == 0 and ngram_join.join(no_docs).count() == 0


# -------------------------------------------------------- substring dedup


@pytest.mark.parametrize("n", [3, 5, 7])
def test_substring_dedup_of_one_short_text(spark, n):
    df = spark.createDataFrame([(1, " ".join("abcdefg"[:n]))], "doc_id bigint, text string").coalesce(1)
    assert rows(substring_dedup.digest(df)) == Counter(brute.substring_dedup(pairs(df)))


@pytest.mark.parametrize("name,how", [("documents", {}), ("edge_docs", {}), ("edge_docs", {"shard_words": 40, "share_bytes": 500})])
def test_substring_dedup(name, how, request, monkeypatch):
    df = request.getfixturevalue(name)
    if how:
        whole = substring_dedup.removals
        monkeypatch.setattr(substring_dedup, "removals", lambda docs, width: whole(docs, width, **how))
    assert rows(substring_dedup.digest(df)) == Counter(brute.substring_dedup(pairs(df)))


def test_substring_removal(edge_docs, no_docs):
    out = substring_dedup.remove(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    want = Counter((d, " ".join(k)) for d, n, k in brute.kept_words(pairs(edge_docs)))
    got = out.collect()
    assert Counter((r["doc_id"], " ".join(brute.words(r["text"]))) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert substring_dedup.remove(no_docs).count() == 0 and substring_dedup.digest(no_docs).count() == 0


# ------------------------------------------------------- tokens and files


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(queries.word_bpe()["tokenizer"])


def ids_of(encode, texts):
    """A text's ids, for each text."""
    ids, sizes = encode(pa.array([x.decode() for x in texts]))
    assert len(sizes) == len(texts) and sizes.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_by_word_equals_whole_texts(documents, edge_rows):
    path = queries.word_bpe()["tokenizer"]
    texts = [(t or "").encode() for _, t in pairs(documents)[:60]] + [(r[1] or "").encode() for r in edge_rows]
    rng = np.random.default_rng(2)
    parts = ["a", "B", "É", "é", "İ", "ß", "'s", "'", "日本", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "_", " ", "\n", "\x85", " ", "ſ", "x"]
    texts += ["".join(rng.choice(parts, rng.integers(0, 25))).encode() for _ in range(2000)]
    assert ids_of(tokens.Encoder(path, True), texts) == ids_of(tokens.Encoder(path, False), texts)


def test_a_worker_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encode = tokens.Encoder(queries.word_bpe()["tokenizer"], True)
    whole = tokens.Encoder(queries.word_bpe()["tokenizer"], False)
    for texts in ([b"a b c d"], [b"c d e f"], [b"a b", b"", b"x y z"]):
        assert ids_of(encode, texts) == ids_of(whole, texts)


@pytest.mark.parametrize("name", ["documents", "edge_docs"])
def test_token_files(name, request, bpe):
    df = request.getfixturevalue(name)
    want, start = Counter(), 0
    got = token_files.round_trip(df, **queries.word_bpe()).collect()
    if name == "documents":
        for d, t in sorted(pairs(df)):
            ids = brute.token_ids(bpe, t)
            want[d, start, len(ids), brute.crc(ids)] += 1
            start += len(ids)
        assert Counter(map(tuple, got)) == want
    else:
        order = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:i]) for i in range(len(order))]
        ids = [r["doc_id"] for r in order]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), brute.crc(x)) for d, t in pairs(df) for x in [brute.token_ids(bpe, t)])


def test_token_file_layout_and_selective_reads(spark, documents, bpe):
    path = folder(spark, "test-tokens")
    token_files.write_tokens(documents, path, **queries.word_bpe())
    seen = 0
    for file in [f for f in spark.read.parquet(path).inputFiles()]:
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            assert {"RLE_DICTIONARY"} <= set(columns["ids.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
            seen += group.num_rows
    assert seen == documents.count()
    text = dict(pairs(documents))
    some = token_files.read_tokens(spark, path, (token_files.F.col("doc_id") >= 20) & (token_files.F.col("doc_id") < 30)).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {d: brute.token_ids(bpe, text[d]).tolist() for d in range(20, 30)}
    about = token_files.read_metadata(spark, path)
    assert "ids" not in about._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert about.count() == documents.count()


def test_token_files_of_nothing(no_docs):
    assert token_files.round_trip(no_docs, **queries.word_bpe()).count() == 0


# ---------------------------------------------------------------- packing


def check_packing(got, wanted, capacity):
    """got: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; wanted: (doc_id, ids)."""
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] > 0
    padding = total = 0
    for pieces_ in sequences.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    want = defaultdict(list)
    for d, ids in wanted:
        want[d].append(ids)
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        found = Counter(by_doc[d])
        assert sum(n * k[1] for k, n in found.items()) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, crc, n in sorted(found):
                assert (start, n) == (at, len(texts[0])) and crc == brute.crc(texts[0][start:start + length])
                at += length
    return padding, total


@pytest.mark.parametrize("name,capacity", [("documents", 2048), ("edge_docs", 2048), ("documents", 96)])
def test_packing(name, capacity, request, bpe):
    df = request.getfixturevalue(name)
    got = packing.digest(packing.pack(df, capacity=capacity, group_rows=50, **queries.word_bpe())).collect()
    padding, total = check_packing(got, [(d, brute.token_ids(bpe, t)) for d, t in pairs(df)], capacity)
    groups = max(1, len(got) // 50)
    assert padding <= total * 0.02 + groups * capacity


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, **queries.word_bpe()).count() == 0


@pytest.mark.parametrize("capacity,slack", [(2048, 16), (96, 0), (7, 1)])
def test_cuts_fill_their_classes(capacity, slack):
    for rest in range(capacity):
        cuts = packing.cut(rest, capacity, slack)
        assert sum(n for _, n in cuts) == rest
        for k, n in cuts:
            assert k * n <= capacity and n > 0
            assert capacity - k * n <= slack or n == capacity // k


# --------------------------------------------------------------- sharding


def brute_shard(doc, weights):
    def score(i):
        h = xxhash.xxh64_intdigest(int(doc).to_bytes(8, "little", signed=True), 42) if doc is not None else 42
        u = ((xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h) >> 11) + 0.5) / 2**53
        return -weights[i] / np.log(u)
    return max((i for i, w in enumerate(weights) if w > 0), key=lambda i: (score(i), -i))


@pytest.mark.parametrize("name", ["documents", "edge_docs"])
def test_sharding(name, request):
    df = request.getfixturevalue(name)
    got = sharding.shard_documents(df, 24).collect()
    import zlib
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", brute_shard(d, [1] * 24), brute_shard(d, [1] * 25)) for d, t in pairs(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weighted_shards(spark):
    weights = [1.0, 3.0, 0.0, 2.0]
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    got = Counter(r[0] for r in df.select(sharding.rendezvous([df["doc_id"]], weights)).collect())
    assert got[2] == 0
    for i, w in enumerate(weights):
        assert abs(got[i] - 1000 * w) < 150


def test_sharding_of_nothing(no_docs):
    assert sharding.shard_documents(no_docs, 24).count() == 0


def test_sharding_is_native(documents):
    plan = sharding.shard_documents(documents, 24)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ----------------------------------------------------------- SentencePiece

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(spark, documents, edge_docs):
    import sentencepiece
    native = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (documents, edge_docs):
        got = pieces.digest(df, PIECES).collect()
        assert all(r["verified"] for r in got)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), brute.crc(x)) for d, t in pairs(df) for x in [native.encode(t or "")])
    few = documents.limit(20)
    back = pieces.decode(pieces.encode(few, PIECES), PIECES)
    assert rows(back) == Counter(pairs(few))


def test_pieces_on_random_texts():
    rng = np.random.default_rng(8)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "the", "in", " er", "<s>", "<0x41>", "    ", "1", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)]
    encoder = pieces.PieceEncoder(PIECES)
    made = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x, _ in made] == encoder.native.encode(texts)
    assert all(ok for _, ok in made)


def model_bytes(pieces_, kind, **normalizer):
    """A model file with these (text, score, type) pieces."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    import struct
    out = b""
    for text, score, type_ in pieces_:
        out += message(1, message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(type_))
    trainer = varint(3 << 3) + varint(kind) + varint(4 << 3) + varint(len(pieces_)) + varint(35 << 3) + varint(1)
    rules = message(1, b"identity") + b"".join(varint(n << 3) + varint(normalizer[key]) for n, key in ((3, "dummy"), (4, "trim")) if key in normalizer)
    return out + message(2, trainer) + message(3, rules)


@pytest.mark.parametrize("dummy,trim", [(1, 0), (0, 0), (1, 1)])
def test_unigram_model(tmp_path, dummy, trim):
    rows_ = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    rows_ += [(t, s, 1) for t, s in (("▁", -3.0), ("▁the", -2.5), ("the", -4.0), ("t", -6.0), ("h", -6.1), ("e", -6.2), ("he", -5.0), ("▁t", -5.5), ("n", -6.4), ("then", -7.0), ("▁▁", -6.6))]
    path = tmp_path / "own.model"
    path.write_bytes(model_bytes(rows_, 1, dummy=dummy, trim=trim))
    encoder = pieces.PieceEncoder(str(path))
    texts = ["the then hen", "the", "then the  the", "thethe nnn", "日 the\nthe", "", "t h e", "  the "]
    made = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x, _ in made] == encoder.native.encode(texts)


def test_likely_rows_are_a_superset(spark, monkeypatch):
    from shiftwise.llm import staging
    df, ids = spark.range(-500, 5000), spark.range(-500, 5000, 37)
    for size in (1 << 20, 1 << 4, 1):
        monkeypatch.setattr(staging, "FILTER_WORDS", size)
        got = {r[0] for r in staging.likely(df, ids, "id").collect()}
        assert got >= {r[0] for r in ids.collect()} and (size < 100 or len(got) < 200)


def test_rows_told_apart_without_a_join(spark, monkeypatch):
    """rows that surely stay don't move with their texts; null keys, keys of another type, columns with the names used."""
    from shiftwise.llm import staging
    docs = spark.range(600).select(F.when(F.col("id") > 0, F.col("id")).cast("int").alias("doc_id"), F.lit(1).alias("filter_word"), F.lit("t").alias("text"))
    ids = spark.range(1, 600).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).alias("stays")).withColumn("unclear", ~F.col("stays") | (F.col("doc_id") % 30 == 0))
    wanted = {i for i in range(1, 600) if i % 3 == 0}
    for size in (1 << 20, 8, 1):
        monkeypatch.setattr(staging, "FILTER_WORDS", size)
        sure, unclear = staging.told_apart(docs, ids, "doc_id", "stays", "unclear")
        assert sure.columns == unclear.columns == docs.columns and "SortMergeJoin" not in sure._jdf.queryExecution().toString()
        a, b = [r[0] for r in sure.collect()], [r[0] for r in unclear.collect()]
        assert set(a) <= {i for i in wanted if i % 30} and {i for i in wanted if i % 30 == 0} <= set(b) and wanted <= {*a, *b} and None not in a + b
        assert len({*a, *b}) == len(a + b) and (size < 100 or len(a) > 150)


def test_keep_first_with_a_full_table_of_bits(spark, edge_docs, monkeypatch):
    """the same rows whether the table tells all of them apart or none."""
    from shiftwise.llm import staging
    docs = edge_docs.unionByName(spark.createDataFrame([(900 + i, f"{name} of its own words in a row") for i, name in enumerate("abcabd")], "doc_id bigint, text string").withColumns({c: F.lit(None) for c in edge_docs.columns if c not in ("doc_id", "text")}).select(edge_docs.columns))
    want = Counter(map(str, ngram_join.keep_first(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(staging, "FILTER_WORDS", 1)
    assert Counter(map(str, ngram_join.keep_first(docs).select("doc_id", "text").collect())) == want


def test_shared_shingles_come_back_in_bytes_a_hit():
    """what a range sends back follows its shared hashes, not documents times ranges."""
    def run(number, hashes, rows):
        about = (None,) * 5
        return (0, number, ngram_join._planes(np.array(hashes, np.uint64), ngram_join.BITS // 8), np.array(rows, "<u2").tobytes(), *about)
    far = 16_000
    rows = [run(7, [1, 5, 9], [far, 3, ngram_join.MANY]), run(8, [5, 9, 11], [far, 2, 4]), run(9, [20], [far])]
    out = ngram_join._count_shared(pa.Table.from_batches([ngram_join._table(rows, ngram_join._RUN_KINDS, ngram_join._RUN_NAMES)])).to_pylist()
    got = {r["run"]: sorted(ngram_join._from_planes(r["hits"], 2).tolist()) for r in out}
    assert got == {7: [3], 8: [2, far]}
    assert sum(len(r["hits"]) for r in out) == 6


@pytest.mark.parametrize("part, whole", [(3, 4), (1, 2), (9, 10), (1, 1), (1, 3)])
def test_links_at_other_similarities(spark, part, whole, monkeypatch):
    """a part of the hash space in the first exchange loses no link; classes in several runs."""
    from fractions import Fraction
    monkeypatch.setattr(ngram_join, "RUN_SHINGLES", 200)
    rng = np.random.default_rng(3)
    texts = []
    for i in range(60):
        words = [f"{i % 12}w{j}" for j in range(int(rng.integers(3, 60)))]
        texts += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:-1] + ["else"])), (3 * i + 2, " ".join(words))]
    texts += [(7, "7w0 7w1 7w2"), (7, "7w0 7w1 7w2"), (None, texts[0][1]), (999, ""), (998, None)]
    sets = [brute.shingles(t) for _, t in texts]
    def linked(i, j):
        both = len(sets[i] & sets[j])
        return i != j and both and texts[i][0] is not None and texts[j][0] is not None and whole * both >= part * (len(sets[i]) + len(sets[j]) - both)
    want = Counter((texts[i][0], len(sets[i]), sum(linked(i, j) for j in range(len(texts)))) for i in range(len(texts)))
    got = ngram_join.join(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), similarity=Fraction(part, whole))
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got.collect()) == want


def test_two_sets_under_one_id(spark):
    """Two unlike texts share an id and are first of their sets: no link is lost."""
    def text(name, *changed):
        return " ".join(f"{name}{i}" if i not in changed else f"other{name}{i}" for i in range(60))
    rows = [(20, text("a")), (20, text("b")), (21, text("a", 59)), (22, text("b", 59)), (23, text("a", 0)), (24, text("b", 0)), (25, text("c")), (25, text("c", 0)), (26, text("c", 59))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {(r.doc_id, r.component_id, r.n_links) for r in ngram_join.join(df).collect()}
    assert found == {(20, 20, 2), (21, 20, 2), (22, 20, 2), (23, 20, 2), (24, 20, 2), (25, 25, 2), (26, 25, 2)}
    kept = Counter((r.doc_id, r.text[:1]) for r in ngram_join.keep_first(df).collect())
    assert sum(kept.values()) == 3 and {d for d, _ in kept} == {20, 25}


def test_many_short_texts_in_one_batch(spark):
    """More rows than 16 bits can number, in one Arrow batch."""
    n = 70_000
    df = spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.floor(F.col("id") / 2).cast("string"), F.lit(" x")).alias("text"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        out = ngram_join.join(df)
        assert out.where(F.col("component_id") != F.col("doc_id") - F.col("doc_id") % 2).count() == 0 and out.where("n_links <> 1").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
