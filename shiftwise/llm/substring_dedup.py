"""Removal of passages that an earlier document holds, by repeated-phrase automata.

A window is ``width`` consecutive words.  Every word is removed that lies in a
window which also starts in a document with a smaller id; windows are judged on
the input.

1. Documents with the same words are one class; all but the first lose every
   word.  From here on a class is its first document.
2. Candidates: phrases of ``phrase`` words are hashed and winnowed: of each run
   of ``width - phrase + 1`` neighbouring phrases the one with the smallest hash
   is taken.  A shared window holds a taken phrase, the same in both documents,
   so windows around phrases that only one document has can't recur.
3. Confirm: the windows around recurring phrases are hashed and grouped; each
   recurring window belongs to the first document that has it, its owner.
   Neighbouring windows of an owner make a passage.
4. Automata: passages are cut into blocks of ``width // 2`` words; any window
   inside a passage holds a whole block.  Passages are dealt into shards by
   owner, and the blocks of a shard are compiled to an Aho-Corasick automaton
   over word numbers.
5. Every document with a window of another owner is streamed through the shards
   of these owners.  Each hit is extended word by word in both directions, and a
   run of ``width`` words or more is removed.  The words decide, not the hashes:
   a collision only costs time.

A shard that many documents visit is built several times, for as many shares of
its documents; sizes of shards and shares are bounded in words and bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.staging import free_name, ready, stage
from shiftwise.llm.words import MAX64, U64, Words, long_windows, slices, sliding

WIDTH, PHRASE = 50, 26


def _phrases(w: Words, h: np.ndarray, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the taken phrases."""
    room = w.room()
    p = long_windows(h, phrase)
    p[room < phrase] = MAX64
    span = width - phrase + 1
    least = sliding(p, span)
    least[room < width] = U64(0)  # no window starts here
    # a phrase is taken if it is the least of a window that holds it
    best = sliding(least[::-1].copy(), span, np.maximum)[::-1] if len(least) else least
    at = np.flatnonzero((best == p) & (room >= phrase))
    return at, p[at]


def _key(words: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(words)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _documents(width: int, phrase: int):
    """Per row: key of its words, their number, their digest, and its taken phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                at, hashes = _phrases(w, w.hashes(), width, phrase)
                text = np.searchsorted(w.first, at, side="right") - 1
                order = np.lexsort((hashes, text))
                text, hashes = text[order], hashes[order]
                fresh = np.ones(len(text), dtype=bool)
                fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                plain = [b" ".join(x.split()) for x in _bytes(part.column("text"))]
                hi, lo = zip(*map(_key, plain), strict=True)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(w.counts),
                    pa.array([hashlib.sha256(x).digest() for x in plain], pa.binary()),
                    _lists(_signed(hashes[fresh]), np.bincount(text[fresh], minlength=len(w.counts))),
                ], names=["doc_id", "hi", "lo", "n_words", "digest", "phrases"])
    return run


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _windows(width: int, phrase: int):
    """(window, doc_id, lo, at) of each different window around a recurring phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                h, n = w.hashes(), len(w)
                at, hashes = _phrases(w, h, width, phrase)
                again = part.column("phrases")
                flat = again.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(again)), np.diff(again.offsets.to_numpy()))
                text = np.searchsorted(w.first, at, side="right") - 1
                seed = U64(0x9E3779B97F4A7C15)
                hit = at[np.isin(hashes + text.astype(np.uint64) * seed, flat + owner.astype(np.uint64) * seed)]
                near = np.zeros(n + 1, dtype=np.int64)
                lo = np.maximum(hit - (width - phrase), 0)
                np.add.at(near, lo, 1)
                np.add.at(near, hit + 1, -1)
                begin = np.flatnonzero((np.cumsum(near)[:n] > 0) & (w.room() >= width))
                # a phrase marks windows before it that may belong to the text before: these end too early to hold it, but do no harm
                found, text = long_windows(h, width)[begin], w.text_of()[begin]
                order = np.lexsort((begin, found, text))
                found, text, begin = found[order], text[order], begin[order]
                first = np.ones(len(found), dtype=bool)
                first[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
                take = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([
                    _signed(found[first]), part.column("doc_id").take(take), part.column("lo").take(take), pa.array((begin[first] - w.first[text[first]]).astype(np.int32)),
                ], names=["window", "doc_id", "lo", "at"])
    return run


def _passages(width: int):
    """(owner, owner_lo, n, passage) of each run of neighbouring windows that an owner has; n: its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, lo, text, starts in zip(part.column("doc_id").to_pylist(), part.column("lo").to_pylist(), _bytes(part.column("text")), part.column("starts").to_pylist(), strict=True):
                    words, at = text.split(), np.sort(np.array(starts))
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        own = words[run_[0]:run_[-1] + width]
                        rows.append((doc, lo, len(own), b" ".join(own)))
                yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), ("owner", "owner_lo", "n", "passage"))
    return run


def _batch(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


class Phrasebook:
    """The passages of a shard, compiled: (owner, words joined by a space), the owner being any number."""

    def __init__(self, passages: Iterator[tuple[int, bytes]], width: int):
        import ahocorasick
        self.width, self.block = width, width // 2
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, ...]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for owner, text in passages:
            words = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in text.split())
            for i in range(0, len(words) - self.block + 1, self.block):
                block = words[i:i + self.block]
                places = self.automaton.get(block, None)
                if places is None:
                    self.automaton.add_word(block, places := {})
                places.setdefault(owner, []).append((len(self.passages), i))
            self.passages.append(words)
        self.automaton.make_automaton()

    def spans(self, text: bytes, owners: set[int]) -> list[tuple[int, int]]:
        """Word ranges of the text that lie in passages of these owners, each a window or longer."""
        words = tuple(self.numbers.get(x, 0) for x in text.split())
        out, seen = [], {}
        for end, places in self.automaton.iter(words):
            begin = end - self.block + 1
            for owner in owners.intersection(places):
                for passage, offset in places[owner]:
                    if seen.get((passage, begin - offset), -1) >= end:
                        continue
                    own, a, b = self.passages[passage], begin, end + 1
                    i, j = offset, offset + self.block
                    while a and i and words[a - 1] == own[i - 1]:
                        a, i = a - 1, i - 1
                    while b < len(words) and j < len(own) and words[b] == own[j]:
                        b, j = b + 1, j + 1
                    seen[passage, begin - offset] = b - 1
                    if b - a >= self.width:
                        out.append((a, b))
        return out


_SPANS = "doc_id bigint, lo bigint, spans array<struct<from:int,to:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _locate(width: int):
    """Spans of a share of a shard's documents; texts are taken from Arrow one at a time."""
    def run(documents: pa.Table, passages: pa.Table) -> pa.Table:
        rows = []
        if documents.num_rows and passages.num_rows:
            number: dict[tuple[int, int], int] = {}
            owners = [number.setdefault(x, len(number)) for x in zip(passages["owner"].to_pylist(), passages["owner_lo"].to_pylist(), strict=True)]
            book = Phrasebook(((x, text.as_py()) for x, text in zip(owners, passages["passage"], strict=True)), width)
            for doc, lo, text, ids, los in zip(documents["doc_id"], documents["lo"], documents["text"], documents["owners"], documents["owner_los"], strict=True):
                spans = book.spans((text.as_py() or "").encode(), {number[x] for x in zip(ids.as_py(), los.as_py(), strict=True)})
                if spans:
                    rows.append((doc.as_py(), lo.as_py(), [{"from": a, "to": b} for a, b in spans]))
        return pa.Table.from_batches([_batch(rows, (pa.int64(), pa.int64(), _SPAN_TYPE), ("doc_id", "lo", "spans"))])
    return run


def _kept(text: bytes, spans: list[dict]) -> tuple[int, bytes]:
    """Words removed, and the words kept, joined by a space."""
    words = text.split()
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for x in spans:
        gone[x["from"]] += 1
        gone[x["to"]] -= 1
    out = np.cumsum(gone)[:-1] > 0
    return int(out.sum()), b" ".join(x for x, o in zip(words, out.tolist(), strict=True) if not o)


def removals(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE, shard_words: int = 500_000, share_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(documents, cut): a row for each row of ``docs``, and one for each class of texts that loses some of its words.

    documents: doc_id, hi, lo (key of its words), n_words, digest (of all its
    words), copied (an earlier document has the same words, a window or more).
    cut: doc_id, lo, n_removed, kept (the words left, joined by a space).

    ``docs`` needs ``doc_id`` and ``text``.  A null text has no words.  A row
    without an id has no place in the order: it loses nothing and costs no other
    row anything.  Repeated rows lose the same words, and nothing to each other.  A
    very long text is read whole, in some 15 times its size of a worker's memory;
    an empty table gives no rows.
    """
    docs = ready(docs).select(F.col("doc_id").cast("long"), "text")
    rows = stage(docs.mapInArrow(_documents(width, phrase), "doc_id bigint, hi bigint, lo bigint, n_words bigint, digest binary, phrases array<bigint>"), "documents")
    long = rows.where((F.col("n_words") >= width) & F.col("doc_id").isNotNull())
    classes = stage(long.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "phrases")).alias("x")).select("hi", "lo", "x.*"), "classes")
    firsts = classes.select("hi", "lo", F.col("doc_id").alias("first"))
    documents = rows.drop("phrases").join(firsts, ["hi", "lo"], "left").withColumn("copied", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)) & (F.col("n_words") >= width)).drop("first")

    held = classes.select("doc_id", "lo", F.explode("phrases").alias("phrase"))
    recurring = held.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase")
    candidates = held.join(recurring, "phrase").groupBy("doc_id", "lo").agg(F.collect_list("phrase").alias("phrases"))
    texts = docs.join(candidates, "doc_id").mapInArrow(_of_class, "doc_id bigint, lo bigint, text string, phrases array<bigint>")
    texts = stage(texts.dropDuplicates(["doc_id", "lo"]), "texts")

    windows = stage(texts.mapInArrow(_windows(width, phrase), "window bigint, doc_id bigint, lo bigint, at int"), "windows")
    owned = windows.groupBy("window").agg(F.min(F.struct("doc_id", "at", "lo")).alias("x"), F.max("doc_id").alias("last"))
    owned = stage(owned.where("last > x.doc_id").select("window", F.col("x.doc_id").alias("owner"), F.col("x.lo").alias("owner_lo"), F.col("x.at").alias("start")), "owned")

    starts = owned.groupBy(F.col("owner").alias("doc_id"), F.col("owner_lo").alias("lo")).agg(F.collect_list("start").alias("starts"))
    passages = stage(texts.select("doc_id", "lo", "text").join(starts, ["doc_id", "lo"]).mapInArrow(_passages(width), "owner bigint, owner_lo bigint, n bigint, passage binary"), "passages")
    n_shards = int(passages.agg(F.sum("n")).first()[0] or 0) // shard_words + 1
    shard = F.pmod(F.xxhash64("owner", "owner_lo"), F.lit(n_shards)).alias("shard")

    to_owner = windows.join(owned, "window").where("owner < doc_id").select("doc_id", "lo", "owner", "owner_lo").distinct()
    visits = to_owner.select("doc_id", "lo", shard, "owner", "owner_lo").groupBy("doc_id", "lo", "shard").agg(F.collect_list(F.struct("owner", "owner_lo")).alias("x"))
    visits = visits.select("doc_id", "lo", "shard", F.col("x.owner").alias("owners"), F.col("x.owner_lo").alias("owner_los"))
    visits = stage(texts.select("doc_id", "lo", "text").join(visits, ["doc_id", "lo"]), "visits")
    shares = visits.groupBy("shard").agg((F.floor(F.sum(F.octet_length("text")) / share_bytes) + 1).alias("shares"))
    dealt = visits.join(shares, "shard").withColumn("share", F.pmod(F.xxhash64("doc_id", "lo"), F.col("shares"))).drop("shares")
    built = passages.select(shard, "owner", "owner_lo", "passage").join(shares, "shard").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    spans = dealt.groupBy("shard", "share").cogroup(built.groupBy("shard", "share")).applyInArrow(_locate(width), _SPANS)
    spans = spans.groupBy("doc_id", "lo").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_kept(x, y) for x, y in zip(_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lo"), pa.array([n for n, _ in made], pa.int64()), pa.array([x.decode() for _, x in made], pa.string())], names=["doc_id", "lo", "n_removed", "kept"])

    cut = texts.select("doc_id", "lo", "text").join(spans, ["doc_id", "lo"]).select("doc_id", "lo", "text", "spans").mapInArrow(apply, "doc_id bigint, lo bigint, n_removed bigint, kept string")
    return documents, stage(cut, "cut")


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the key that came with it (other rows of the id may have other texts)."""
    for batch in batches:
        own = [_key(b" ".join(x.split()))[1] for x in _bytes(batch.column("text"))]
        same = np.array(own, dtype=np.int64) == batch.column("lo").to_numpy(zero_copy_only=False)
        yield batch.select(["doc_id", "lo", "text", "phrases"]).filter(pa.array(same))


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``."""
    documents, cut = removals(docs, width)
    cut = cut.select("doc_id", "lo", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    rows = documents.join(cut, ["doc_id", "lo"], "left")
    copied = F.col("copied")
    return rows.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"))


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the removed words gone from ``text`` (and ``n_chars`` counted anew, if there is such a column).

    Texts that lose nothing stay as they are; the others are the words left,
    joined by a space, possibly none.  All other columns stay.
    """
    documents, cut = removals(docs, width)
    gone = documents.where("copied").select("doc_id", "lo", F.lit("").alias("kept")).unionByName(cut.select("doc_id", "lo", "kept")).distinct()
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "kept")).alias(extra := free_name(docs, "kept_words")))
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        for batch in batches:
            columns = [batch.column(n) for n in names]
            texts, found = batch.column("text").to_pylist(), batch.column(extra).to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else [0] * len(texts)
            for i, text in enumerate(texts):
                if found[i]:
                    lo = _key(b" ".join((text or "").encode().split()))[1]
                    for x in found[i]:
                        if x["lo"] == lo:
                            texts[i], sizes[i] = x["kept"], len(x["kept"])
            columns[place] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    key = gone.select(F.col("doc_id").alias(own := free_name(docs, "own_id")), extra)
    return docs.join(key, F.col("doc_id") == F.col(own), "left").select(*names, extra).mapInArrow(apply, docs.schema)
