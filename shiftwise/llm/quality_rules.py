"""Quality rules by distribution divergence.

Every document gets two histograms: its characters by class (lower case, upper
case, digit, white space, punctuation, symbol, beyond ASCII) and its words by
the common words of its language, all other words in one bin.  Both are held
against references of the language by Jensen-Shannon distance (square root of
the divergence, base 2).  The references come from all documents:

* a word is common if it makes up at least ``common_share`` of its language's
  words; the reference histogram is the language's own;
* the class reference is the median document: for each class the (lower) median
  of the documents' shares in steps of 1/1000, so that junk doesn't move it;
* every language has a reference of its own, and so have the documents without a
  language.

Only where a reference is held depends on the corpus.  Those of languages with at
least ``language_share`` of all documents are sent to the workers: at most
``1 / language_share`` references of at most ``2 / common_share`` words.  Those of
all rarer languages stay in a table and are dealt out by language together with
the documents, which follow their reference; a task streams them, and one
language has less than ``language_share`` of all documents there.

Lengths guard the tests: short texts scatter, so the word test allows
``word_distance + word_scatter / sqrt(words)`` and neither test is applied below
``min_words`` (words) or ``min_chars`` (characters).

The base rules (length, repetition) are plain counts of the same pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.llm.staging import free_name, ready, stage
from shiftwise.llm.words import SLICE, SPACE, U64, Words, mix, short_windows, slices, span_hashes

CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
PUNCTUATION = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"
_CONT = len(CLASSES)  # bytes that continue a character

_CLASS = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[SPACE] = 3
_CLASS[[ord(c) for c in PUNCTUATION]] = 4
_CLASS[128:192], _CLASS[192:] = _CONT, 6
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IN_WORD = ~SPACE & (_CLASS != _CONT)
_NEWLINE = 10


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_chars: int = 200
    class_distance: float = 0.19
    word_distance: float = 0.2
    word_scatter: float = 2.6
    common_share: float = 1 / 1000
    language_share: float = 1 / 1000


def _by_class(codes: np.ndarray, n: int, w: Words) -> np.ndarray:
    """Per text, how many bytes have each of ``n`` codes (``codes`` of a byte value), a mebibyte at a time."""
    out = np.zeros((len(w.counts), n), dtype=np.int64)
    for lo in range(0, len(w.data), SLICE):
        hi = min(lo + SLICE, len(w.data))
        first, last = np.searchsorted(w.offsets, (lo, hi - 1), side="right") - 1
        inside = np.diff(np.clip(w.offsets[first:last + 2], lo, hi))
        at = np.repeat(np.arange(last - first + 1, dtype=np.int32) * np.int32(n), inside)
        out[first:last + 1] += np.bincount(at + codes[w.data[lo:hi]], minlength=(last - first + 1) * n).reshape(-1, n)
    return out


def _per_text(held: np.ndarray, w: Words) -> np.ndarray:
    """Per text, bytes whose value is held."""
    return _by_class(held.astype(np.uint8), 2, w)[:, 1]


def _in_text(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return mix(hashes + (texts.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def _dup_lines(w: Words) -> np.ndarray:
    """Per text, lines that hold a word and equal an earlier line."""
    n, texts = len(w.data), len(w.counts)
    if not len(w):
        return np.zeros(texts, dtype=np.int64)
    breaks = np.flatnonzero(w.data == _NEWLINE)
    starts = np.union1d(w.offsets[:-1], breaks + 1)
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    # a line ends before its newline, if it has one
    ends = ends - (w.data[ends - 1] == _NEWLINE)
    held = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[held], ends[held]
    text = np.searchsorted(w.offsets, starts, side="right") - 1
    _, first = np.unique(_in_text(span_hashes(w.data, starts, ends), text), return_index=True)
    return np.bincount(text, minlength=texts) - np.bincount(text[first], minlength=texts)


def _repeat_words(w: Words, h: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text, words in ``k``-word windows that the text holds twice or more."""
    texts = len(w.counts)
    at = np.flatnonzero(w.room() >= k)
    if not len(at):
        return np.zeros(texts, dtype=np.int64)
    text = w.text_of()
    keys = _in_text(short_windows(h, k)[at], text[at])
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = at[order[same[1:] | same[:-1]]]
    inside = np.zeros(len(h), dtype=bool)
    for j in range(k):
        inside[twice + j] = True
    return np.bincount(text[inside], minlength=texts)


def _class_counts(w: Words) -> np.ndarray:
    return _by_class(_CLASS.astype(np.uint8), _CONT + 1, w)[:, :_CONT]


# ------------------------------------------------------------- references

_COUNTS = T.StructType([T.StructField(n, t) for n, t in (
    ("lang", T.StringType()), ("kind", T.StringType()), ("item", T.StringType()), ("n", T.LongType()), ("seen", T.LongType()))])
_STEPS = 1000


@dataclass(frozen=True)
class Reference:
    """Common words (hashes, sorted) and the two reference histograms of a language."""

    words: np.ndarray
    word_shares: np.ndarray  # the last entry is that of all other words
    class_shares: np.ndarray


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_COUNTS)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=_COUNTS.names)


def _groups(part: pa.RecordBatch, languages: frozenset) -> list[tuple[str | None, np.ndarray]]:
    """The rows of each language of ``languages``; all others under null."""
    keys = [x if x in languages else None for x in part.column("lang").to_pylist()]
    return [(key, np.fromiter((x == key for x in keys), bool, len(keys))) for key in dict.fromkeys(keys)]


def _frequent(share: float, languages: frozenset):
    """Words with at least ``share`` of a language's words in a run of documents, and the run's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                w = Words(part.column("text"))
                h, text, rows = w.hashes(), w.text_of(), []
                for key, held in _groups(part, languages):
                    mine = np.flatnonzero(held[text])
                    _, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    rows.append((key, "all", None, len(mine), len(mine)))
                    rows += [(key, "word", w.word(mine[first[i]]).decode(), int(n[i]), len(mine)) for i in np.flatnonzero(n >= share * len(mine))]
                yield _rows(rows)
    return run


def _class_steps(w: Words) -> np.ndarray:
    counts = _class_counts(w)
    return counts * _STEPS // np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _totals(languages: frozenset, candidates: dict):
    """Exact counts of the candidate words, and documents by class and step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {key: (np.array(sorted(v), dtype=object), *_sorted_hashes(v)) for key, v in candidates.items()}
        n_words: dict = defaultdict(lambda: 0)
        n_steps: dict = defaultdict(lambda: np.zeros((len(CLASSES), _STEPS + 1), dtype=np.int64))
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                h, text, steps = w.hashes(), w.text_of(), _class_steps(w)
                for key, held in _groups(part, languages):
                    known = words.get(key, (None, np.zeros(0, np.uint64), None))[1]
                    n_words[key] = n_words[key] + np.bincount(_bins(h[held[text]], known), minlength=len(known) + 1)
                    some = held & (w.counts > 0)
                    for c in range(len(CLASSES)):
                        n_steps[key][c] += np.bincount(steps[some, c], minlength=_STEPS + 1)
        rows = []
        for key, n in n_words.items():
            names = [*words[key][0][words[key][2]], None] if key in words else [None]
            rows += [(key, "word", name, int(x), 0) for name, x in zip(names, n, strict=True)]
            rows += [(key, "class", f"{c} {s}", int(n_steps[key][c, s]), 0) for c, s in np.argwhere(n_steps[key])]
        yield _rows(rows)
    return run


def _sorted_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, sorted, and the place of each in ``sorted(words)``."""
    w = Words(pa.array(sorted(words), pa.large_string()))
    order = np.argsort(w.hashes())
    return w.hashes()[order], order


def _bins(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each hash in ``known``; its length for the others."""
    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def _parted(docs: DataFrame, rules: Rules) -> tuple[frozenset, DataFrame, DataFrame | None]:
    """The frequent languages, the documents of these or of none, and those of rare languages, if there are any."""
    by_lang = docs.groupBy("lang").count()
    total, named = by_lang.agg(F.sum("count"), F.count("lang")).first()
    languages = frozenset(r["lang"] for r in by_lang.where((F.col("count") >= rules.language_share * (total or 0)) & F.col("lang").isNotNull()).collect())
    if len(languages) == named:
        return languages, docs, None
    frequent = F.col("lang").isin(*sorted(languages)) if languages else F.lit(False)
    return languages, docs.where(F.col("lang").isNull() | frequent), docs.where(F.col("lang").isNotNull() & ~frequent)


def references(docs: DataFrame, languages: frozenset, rules: Rules) -> dict[str | None, Reference]:
    """The references of ``languages`` and of documents without a language; ``docs`` has no others.

    A run of documents reports the words with half the common share among its
    own.  A word it doesn't report has less than that there, so ``reported +
    half the share of the other runs' words`` is no less than the word's count:
    no common word is missed, and what passes has half the share, which bounds
    the candidates.  A second pass counts these exactly.
    """
    docs = docs.select("text", "lang")
    half = rules.common_share / 2
    seen = docs.mapInArrow(_frequent(half, languages), _COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    whole = docs.sparkSession.createDataFrame(  # a row for each language with a reference
        [(r["lang"], r["n"]) for r in seen.where("kind = 'all'").select("lang", "n").collect()], "lang string, whole long")
    seen = seen.where("kind = 'word'").alias("s").join(F.broadcast(whole).alias("w"), F.col("s.lang").eqNullSafe(F.col("w.lang")))
    candidates = defaultdict(list)
    for r in seen.where(F.col("n") + (F.col("whole") - F.col("seen")) * half >= F.col("whole") * rules.common_share).select("s.lang", "item").collect():
        candidates[r["lang"]].append(r["item"])
    counted = docs.mapInArrow(_totals(languages, dict(candidates)), _COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).collect()
    words, steps = defaultdict(dict), defaultdict(lambda: np.zeros((len(CLASSES), _STEPS + 1), dtype=np.int64))
    for r in counted:
        if r["kind"] == "word":
            words[r["lang"]][r["item"]] = r["n"]
        else:
            c, s = map(int, r["item"].split())
            steps[r["lang"]][c, s] = r["n"]
    out = {}
    for key, n in words.items():
        total = sum(n.values())
        if not total:
            continue
        common = [x for x in n if x is not None and n[x] >= rules.common_share * total]
        hashes, order = _sorted_hashes(common) if common else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out[key] = _reference(hashes, [n[sorted(common)[i]] for i in order], total, steps[key])
    return out


def _reference(hashes: np.ndarray, counts: list[int], total: int, steps: np.ndarray) -> Reference:
    shares = np.array([*counts, total - sum(counts)], dtype=float) / total
    cum = steps.cumsum(axis=1)
    median = (2 * cum >= cum[:, -1:]).argmax(axis=1).astype(float)
    return Reference(hashes, shares, median / max(median.sum(), 1.0))


# ---------------------------------------- references of rare languages

_ITEMS = T.StructType([T.StructField(n, t) for n, t in (("lang", T.StringType()), ("kind", T.StringType()), ("item", T.LongType()), ("n", T.LongType()))])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all words (by hash), and documents by class and step, of each language of a run."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            names = part.column("lang").dictionary_encode()
            lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words, word = np.unique(w.hashes(), return_inverse=True)
            at, n = np.unique(lang[w.text_of()] * len(words) + word, return_counts=True)
            wide = len(CLASSES) * (_STEPS + 1)
            some = w.counts > 0
            places = lang[some, None] * wide + np.arange(len(CLASSES)) * (_STEPS + 1) + _class_steps(w)[some]
            place, docs = np.unique(places, return_counts=True)
            kinds = ["word"] * len(at) + ["class"] * len(place)
            item = np.concatenate([words.view(np.int64)[at % max(len(words), 1)], place % wide])
            whose = np.concatenate([at // max(len(words), 1), place // wide])
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(whose)).cast(pa.string()), pa.array(kinds, pa.string()), pa.array(item, pa.int64()), pa.array(np.concatenate([n, docs]), pa.int64())], names=_ITEMS.names)


def _reference_table(docs: DataFrame, rules: Rules) -> DataFrame:
    """(lang, reference): a row for each language of ``docs`` that has words; all counts are exact."""
    counted = docs.select("text", "lang").mapInArrow(_items, _ITEMS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counted = stage(counted, "items")
    total = counted.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total"))
    held = counted.join(total, "lang").where((F.col("kind") == "class") | (F.col("n") >= rules.common_share * F.col("total")))

    def listed(kind: str):
        return F.collect_list(F.when(F.col("kind") == kind, F.struct("item", "n")))

    return held.groupBy("lang").agg(F.struct(F.first("total").alias("total"), listed("word").alias("words"), listed("class").alias("steps")).alias("reference"))


def _read_reference(row: dict) -> Reference:
    hashes = np.array([x["item"] for x in row["words"]], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    steps = np.zeros((len(CLASSES), _STEPS + 1), dtype=np.int64)
    for x in row["steps"]:
        steps[divmod(x["item"], _STEPS + 1)] = x["n"]
    return _reference(hashes[order], [row["words"][i]["n"] for i in order], row["total"], steps)


#: Bytes of text of a rare language in one share.
RARE_BYTES = 64 << 20


def _judge_rare(docs: DataFrame, rules: Rules, schema: T.StructType, answer) -> DataFrame:
    """``answer(part, found)`` of the documents, each judged by the reference of its language.

    A language is dealt out in shares of about ``RARE_BYTES``, each with a
    copy of its reference before it.
    """
    name, share, own, n = (free_name(docs, x) for x in ("reference", "reference_share", "reference_lang", "reference_shares"))
    size = F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))
    sizes = stage(docs.groupBy(F.col("lang").alias(own)).agg((F.floor(size / RARE_BYTES) + 1).alias(n)), "shares")
    refs = _reference_table(docs, rules).withColumnRenamed("reference", name).join(sizes, F.col("lang") == F.col(own))
    refs = refs.select("lang", name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(share))
    split = docs.join(sizes, F.col("lang") == F.col(own)).withColumn(share, F.pmod(F.xxhash64("text"), F.col(n))).drop(own, n)
    dealt = split.unionByName(refs, allowMissingColumns=True).repartition("lang", share).sortWithinPartitions("lang", share, F.col(name).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # a language's reference comes before its documents
        for batch in batches:
            for part in slices(batch, "text"):
                is_ref = part.column(name).is_valid()
                new = part.filter(is_ref)
                for lang, row in zip(new.column("lang").to_pylist(), new.column(name).to_pylist(), strict=True):
                    known[lang] = _read_reference(row)
                part = part.filter(pc.invert(is_ref)).drop_columns([name, share])
                if part.num_rows:
                    yield answer(part, _judge(Words(part.column("text")), part, frozenset(known), known, rules))
                known = dict([*known.items()][-1:])

    return dealt.mapInArrow(run, schema)


# ----------------------------------------------------------------- verdict


def js_distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts from ``shares``; 0 for an empty row."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(shares > 0, shares * np.log2(shares / m), 0).sum(axis=1)
    return np.where(counts.sum(axis=1) > 0, np.sqrt(np.maximum(0, (a + b) / 2)), 0.0)


def _judge(w: Words, part: pa.RecordBatch, languages: frozenset, refs: dict, rules: Rules) -> dict[str, np.ndarray]:
    h, text, n = w.hashes(), w.text_of(), len(w.counts)
    repeat = _repeat_words(w, h)
    classes, by_class, by_word = _class_counts(w), np.zeros(n), np.zeros(n)
    for key, held in _groups(part, languages):
        if key not in refs:
            continue
        ref, mine = refs[key], np.flatnonzero(held)
        by_class[mine] = js_distance(classes[mine], ref.class_shares)
        row = np.cumsum(held) - 1
        wide, inside = len(ref.words) + 1, held[text]
        bins = _bins(h[inside], ref.words)
        for lo in range(0, len(mine), 4096):  # bounds the table of counts
            at = (row[text[inside]] >= lo) & (row[text[inside]] < lo + 4096)
            rows = min(4096, len(mine) - lo)
            counts = np.bincount((row[text[inside][at]] - lo) * wide + bins[at], minlength=rows * wide).reshape(rows, wide)
            by_word[mine[lo:lo + rows]] = js_distance(counts, ref.word_shares)
    chars = _per_text(_IN_WORD, w)
    base_failed = (w.counts < rules.min_words) | (100 * repeat > rules.max_repeat_percent * w.counts)
    odd_class = (by_class > rules.class_distance) & (chars >= rules.min_chars)
    odd_words = (by_word > rules.word_distance + rules.word_scatter / np.sqrt(np.maximum(w.counts, 1))) & (w.counts >= rules.min_words)
    return {
        "n_words": w.counts, "word_chars": chars, "n_symbols": _per_text(_IS_SYMBOL, w), "n_dup_lines": _dup_lines(w),
        "n_repeat_words": repeat, "base_failed": base_failed, "kept": ~(base_failed | odd_class | odd_words),
        "class_distance": by_class, "word_distance": by_word,
    }


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                      + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
                      + [T.StructField(n, T.DoubleType()) for n in ("class_distance", "word_distance")])


def judge(docs: DataFrame, carry: list[str], rules: Rules = Rules()) -> DataFrame:
    """The columns ``carry`` of every row of ``docs``, then the counts, distances and verdict of its text.

    ``docs`` needs ``text`` and ``lang`` and may have any other columns.  A null
    or empty text has no words and fails the base rules.  Texts without a
    language are judged by the reference of all such texts.  An empty table gives an empty result.  Repeated
    rows are judged each by itself; nothing depends on the order of rows.  A very
    long text is judged whole, in some 15 times its size of a worker's memory.
    """
    languages, usual, rare = _parted(ready(docs), rules)
    refs = references(usual, languages, rules)
    schema = T.StructType([docs.schema[c] for c in carry] + list(RESULT))
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def answer(part: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(found[f.name], t) for f, t in zip(RESULT, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield answer(part, _judge(Words(part.column("text")), part, languages, refs, rules))

    columns = list(dict.fromkeys([*carry, "text", "lang"]))
    out = usual.select(*columns).mapInArrow(run, schema)
    return out if rare is None else out.union(_judge_rare(rare.select(*columns), rules, schema, answer))


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    languages, usual, rare = _parted(ready(docs), rules)
    refs = references(usual, languages, rules)

    def answer(part: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        return part.filter(pa.array(found["kept"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield answer(part, _judge(Words(part.column("text")), part, languages, refs, rules))

    out = usual.mapInArrow(run, docs.schema)
    return out if rare is None else out.union(_judge_rare(rare, rules, docs.schema, answer))
