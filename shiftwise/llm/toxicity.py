"""Toxicity by a weighted finite-state pattern grammar over clauses.

Three transducers read a clause's words as classes (insult, threat, target, negation,
report, other): the first marks insults and threats that a negation reaches as
denied, the second those after a verb of reporting as told, the third tells
whether the remaining ones are aimed at somebody nearby, before or after.
They are composed into one table, and a clause's matches, not its single
words, are what a text is scored by: each match has a kind and the weight of
its word, lowered by the distance of its target.

Which words insult is learned from labelled texts: words and beginnings of words that
texts marked toxic hold far more often, each weighted by the logarithm of
the two rates.  A logistic model over the matches of each kind, their density
and the length is then fitted on texts whose words were learned from the other half
of the texts, so that it sees the matches as on new texts.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.staging import ready, stage
from shiftwise.llm.words import U64, buffers, mix, span_hashes

# ----------------------------------------------------------------- grammar

#: The closed word classes of the grammar (English, German, Spanish, French).
TARGETS = "you your yours u ya they them he she him her we us du dich dir dein ihr euch sie er tú tu te ti usted ustedes vosotros él ella ellos toi vous tes vos il elle ils elles".split()
NEGATIONS = "not no never nor neither without isnt arent dont wasnt nicht kein keine keinen nie niemals nunca jamás tampoco ni pas jamais aucun".split()
REPORTS = "said says say claimed claims wrote writes quoted quote quotes called reported according sagte sagt schrieb behauptet laut dijo dice escribió según afirmó dit disait écrit selon prétend".split()
THREATS = "kill murder hurt destroy smash strangle shoot stab töten umbringen verletzen schlagen matar golpear herir tuer frapper blesser".split()
INSULTS = "idiot moron stupid loser scum worthless pathetic disgusting dumpf trottel arschloch estúpido imbécil crétin connard".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Kinds of matches.
KINDS = ("plain", "aimed", "denied", "told", "threat", "loose")


@dataclasses.dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: (state, symbol) -> (state, output, weight); it starts in ``start``."""

    start: object
    arcs: dict[tuple[object, object], tuple[object, object, float]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """``second`` reads what ``first`` writes; weights add up."""
    start = (first.start, second.start)
    symbols = {x for _, x in first.arcs}
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = todo.pop()
        for symbol in symbols:
            to_a, between, w1 = first.arcs[a, symbol]
            to_b, output, w2 = second.arcs[b, between]
            arcs[(a, b), symbol] = ((to_a, to_b), output, w1 + w2)
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                todo.append((to_a, to_b))
    return Transducer(start, arcs)


def negation(reach: int = 3) -> Transducer:
    """Insults and threats at most ``reach`` words after a negation are denied."""
    arcs = {}
    for left in range(reach + 1):
        for x in range(7):
            after = reach if x == NEGATION else 0 if x == END else max(0, left - 1)
            arcs[left, x] = (after, "denied" if left and x in (INSULT, THREAT) else OTHER if x == NEGATION else x, 0.0)
    return Transducer(0, arcs)


def reporting() -> Transducer:
    """Insults and threats after a verb of reporting are told, up to the end of the clause."""
    arcs = {}
    for told in (False, True):
        for x in (OTHER, INSULT, THREAT, TARGET, REPORT, END, "denied"):
            after = x == REPORT or (told and x != END)
            arcs[told, x] = (after, "told" if told and x in (INSULT, THREAT) else OTHER if x == REPORT else x, 0.0)
    return Transducer(False, arcs)


def aiming(reach: int = 4, fading: float = 0.1) -> Transducer:
    """Whether a target lies at most ``reach`` words before or after; outputs are (kind, the word held / this word).

    A word without a target before it is held until one comes, the reach or
    the clause ends, or another such word takes its place.
    """
    names = {INSULT: ("plain", "aimed"), THREAT: ("loose", "threat")}
    arcs = {}
    for near, held in itertools.product(range(reach + 1), [None, *itertools.product(names, range(1, reach + 1))]):
        for x in (OTHER, INSULT, THREAT, TARGET, END, "denied", "told"):
            out, weight, after = [], 0.0, held
            if x == TARGET and held:
                out.append((names[held[0]][1], "held"))
                weight, after = -fading * (reach - held[1]), None
            elif held and (x in names or x == END or held[1] == 1):
                out.append((names[held[0]][0], "held"))
                after = None
            elif held:
                after = (held[0], held[1] - 1)
            if x in names:
                if near:
                    out.append((names[x][1], "this"))
                    weight -= fading * (reach - near)
                else:
                    after = (x, reach)
            elif x in ("denied", "told"):
                out.append((x, "this"))
            left = reach if x == TARGET else 0 if x == END else max(0, near - 1)
            arcs[(near, held), x] = ((left, after), tuple(out), weight)
    return Transducer((0, None), arcs)


def grammar() -> Transducer:
    return compose(compose(negation(), reporting()), aiming())


# ------------------------------------------------------------ words of a text

#: Bytes of text read at a time; longer texts are read in pieces that end with a line, a clause or a word.
PIECE = 1 << 20
#: Beginnings of a word that are looked up, in characters, besides the word itself.
STEMS = (4, 5, 6, 7)
_SHORTEST = 3
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = mix(np.arange(1, 16, dtype=np.uint64))


def _cut(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pieces of a text of at most ``PIECE`` bytes; a word of more is cut."""
    while hi - lo > PIECE:
        tail = data[lo + PIECE // 2:lo + PIECE]
        ends = np.flatnonzero(_STOP[tail])
        if not len(ends):
            ends = np.flatnonzero(~_LETTER[tail])
        end = lo + PIECE // 2 + int(ends[-1]) + 1 if len(ends) else lo + PIECE
        yield lo, end
        lo = end
    yield lo, hi


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about ``PIECE`` bytes: the bytes, where each piece of text begins (and the end), and the text each belongs to."""
    data, offsets = buffers(texts)
    spans, size = [], 0
    for row in range(len(offsets) - 1):
        for lo, hi in _cut(data, int(offsets[row]), int(offsets[row + 1])):
            if spans and size + hi - lo > PIECE:
                yield _run(data, spans)
                spans, size = [], 0
            spans.append((row, lo, hi))
            size += hi - lo
    if spans:
        yield _run(data, spans)


def _run(data: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = spans[0][1]
    return data[lo:spans[-1][2]], np.array([x[1] - lo for x in spans] + [spans[-1][2] - lo]), np.array([x[0] for x in spans])


class Tokens:
    """Words of a run of pieces: hashes of the word and of its beginnings, its clause and its piece.

    A word is a run of ASCII letters and digits and of other characters except
    general punctuation; A-Z and the letters of Latin-1 are lower-cased.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        letter = _LETTER[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        data[second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]] += 32
        wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
        low = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0)) if len(data) > 1 else np.zeros(0, np.int64)
        for at, width in ((wide, 3), (low, 2)):
            for i in range(width):
                letter[at + i] = False
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = letter.copy()
        begins[1:] &= ~letter[:-1] | edge[1:n]
        ends = letter.copy()
        ends[:-1] &= ~letter[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.piece = np.searchsorted(offsets, self.starts, side="right") - 1
        stops = np.flatnonzero(_STOP[data])
        self.clause = np.searchsorted(stops, self.starts) + self.piece
        self.hashes = span_hashes(data, self.starts, self.ends)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        first, last = np.searchsorted(chars, self.starts), np.searchsorted(chars, self.ends)
        self.length = last - first
        self.stems = []  # (words that are long enough, hash of their beginning)
        for k in STEMS:
            rows = np.flatnonzero(self.length >= k)
            ends = np.append(chars, n)[first[rows] + k]
            self.stems.append((rows, mix(span_hashes(data, self.starts[rows], ends) ^ _SALTS[k])))


def _fixed_hashes(words: list[str]) -> np.ndarray:
    text = "\n".join(words).encode()
    return Tokens(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])).hashes


class Lexicon:
    """Word classes and the weights of insulting words and beginnings of words."""

    #: Weight of the words that the grammar brings along.
    GIVEN = 3.0

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        given = [(INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)]
        classes = {int(h): c for words, c in given for h in _fixed_hashes(words).tolist()}
        strength = {h: self.GIVEN for h, c in classes.items() if c in (INSULT, THREAT)}
        for key, weight in zip(keys.tolist(), weights.tolist(), strict=True):
            if classes.setdefault(key, INSULT) in (INSULT, THREAT):
                strength[key] = max(weight, strength.get(key, 0.0))
        order = sorted(classes)
        self.keys = np.array(order, dtype=np.uint64)
        self.classes = np.array([classes[x] for x in order], dtype=np.uint8)
        self.weights = np.array([strength.get(x, 0.0) for x in order])
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.maybe[(hashes & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[some]
        return some[hit], at[hit]

    def read(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word; of several entries that fit, the heaviest counts."""
        classes = np.zeros(len(tokens.starts), dtype=np.uint8)
        weights = np.zeros(len(tokens.starts))
        words, at = self._find(tokens.hashes)
        classes[words], weights[words] = self.classes[at], self.weights[at]
        for rows, hashes in tokens.stems:
            found, at = self._find(hashes)
            words = rows[found]
            free = (self.classes[at] == INSULT) & ((classes[words] == OTHER) | (classes[words] == INSULT))
            words, at = words[free], at[free]
            classes[words] = INSULT
            weights[words] = np.maximum(weights[words], self.weights[at])
        return classes, weights


class Reader:
    """Finds the matches of texts and tells each text's figures."""

    NAMES = (*KINDS, "words", "entries")

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        machine = grammar()
        numbers = {machine.start: 0}
        for to, _, _ in machine.arcs.values():
            numbers.setdefault(to, len(numbers))
        place = {k: i for i, k in enumerate(KINDS)}
        self.arcs = {(numbers[s], x): (numbers[to], tuple((place[k], which == "held") for k, which in out), math.exp(w)) for (s, x), (to, out, w) in machine.arcs.items()}

    def clause(self, classes: list[int], weights: list[float], sums: np.ndarray) -> None:
        """Add a clause's matches to the sums of their kinds."""
        state, held = 0, 0.0
        for x, weight in zip([*classes, END], [*weights, 0.0], strict=True):
            state, out, factor = self.arcs[state, x]
            for kind, of_held in out:
                sums[kind] += factor * (held if of_held else weight)
            if x in (INSULT, THREAT):
                held = weight

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: sums of the weights of each kind, words, different insulting words."""
        out = np.zeros((len(texts), len(self.NAMES)))
        distinct: dict[int, set[int]] = {}
        for data, offsets, rows in pieces(texts):
            tokens = Tokens(data, offsets)
            classes, weights = self.lexicon.read(tokens)
            np.add.at(out[:, -2], rows[tokens.piece], 1)
            hits = np.flatnonzero((classes == INSULT) | (classes == THREAT))
            for i in hits.tolist():
                distinct.setdefault(int(rows[tokens.piece[i]]), set()).add(int(tokens.hashes[i]))
            for clause in np.unique(tokens.clause[hits]).tolist():
                a, b = np.searchsorted(tokens.clause, (clause, clause + 1))
                self.clause(classes[a:b].tolist(), weights[a:b].tolist(), out[rows[tokens.piece[a]]])
        for row, words in distinct.items():
            out[row, -1] = len(words)
        return out


def features(figures: np.ndarray) -> np.ndarray:
    """What the model sees of ``Reader`` figures: matches of each kind, their density, different words, length, a constant."""
    kinds, words, entries = figures[:, :len(KINDS)], figures[:, -2], figures[:, -1]
    density = 100 * (kinds[:, 0] + kinds[:, 1] + kinds[:, 4]) / (words + 20)
    return np.column_stack([np.log1p(kinds), np.log1p(density), np.log1p(entries), np.log1p(words) / 5, np.ones(len(words))])


#: Where the fit starts from and is held to where labels say nothing: matches tell, denied and told ones hardly.
PRIOR = np.array([1.0, 1.5, 0.0, 0.2, 1.5, 0.5, 0.5, 0.0, 0.0, -3.0])


@dataclasses.dataclass(frozen=True)
class Fit:
    """Bounds and thresholds of learning.

    At most about ``toxic`` and ``clean`` labelled texts are learned from, drawn by a
    hash of their ids; at most ``entries`` words and beginnings of words are kept, those
    with a likelihood ratio of ``evidence`` or more in ``documents`` toxic texts at least,
    where a text that holds an entry already taken counts ``kept`` of what it did.
    """

    toxic: int = 4096
    clean: int = 8192
    entries: int = 8192
    evidence: float = 20.0
    documents: int = 3
    kept: float = 0.7
    ridge: float = 0.3


@dataclasses.dataclass(frozen=True)
class Model:
    keys: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray

    def scores(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(figures) @ self.coefficients, -30, 30)))


# ------------------------------------------------------------------ learning

_COUNTS = [f"{what}{group}" for what in ("texts", "times") for group in range(4)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and beginning of a word: texts and occurrences in each group (half, label) of a run of texts."""
    for batch in batches:
        group = batch.column("half").to_numpy() * 2 + batch.column("toxic").to_numpy()
        for data, offsets, rows in pieces(batch.column("text")):
            tokens = Tokens(data, offsets)
            long = np.flatnonzero(tokens.length >= _SHORTEST)
            hashes = np.concatenate([tokens.hashes[long], *(h for _, h in tokens.stems)])
            text = rows[tokens.piece[np.concatenate([long, *(r for r, _ in tokens.stems)])]]
            order = np.lexsort((text, hashes))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            keys, place = np.unique(hashes, return_inverse=True)
            table = np.zeros((len(keys), 8), dtype=np.int64)
            np.add.at(table, (place, 4 + group[text]), 1)
            np.add.at(table, (place[new], group[text[new]]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(table[:, i]) for i in range(8))], names=["key", *_COUNTS])


def _evidence(a: Column, b: Column, p: Column, n: Column) -> Column:
    """Likelihood ratio of a of p toxic and b of n clean texts holding a word; 0 where toxic texts don't hold it more often."""
    def part(x: Column, of: Column, share: Column) -> Column:
        return F.when(x > 0, x * F.log(x / (of * share))).otherwise(0.0)
    share = (a + b) / (p + n)
    ratio = 2 * (part(a, p, share) + part(p - a, p, 1 - share) + part(b, n, share) + part(n - b, n, 1 - share))
    return F.when((p > 0) & (n > 0) & (a * n > b * p), ratio).otherwise(0.0)


def _ratio(a: np.ndarray, b: np.ndarray, p: float, n: float) -> np.ndarray:
    """The same for arrays."""
    def part(x: np.ndarray, of: float, share: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(of * share, 1e-300)), 0.0)
    share = (a + b) / (p + n)
    found = 2 * (part(a, p, share) + part(p - a, p, 1 - share) + part(b, n, share) + part(n - b, n, 1 - share))
    return np.where(a * n > b * p, found, 0.0)


def _cover(held: list[np.ndarray], toxic: np.ndarray, entries: int, fit: Fit) -> list[int]:
    """Entries taken one by one, the one with the most evidence first.

    With each entry taken a toxic text that holds it counts less (``Fit.kept``).  Words
    that merely stand beside insulting ones, as in many copies of one text, so
    lose their evidence, and insulting words that stand together keep theirs.
    """
    rows = np.flatnonzero(toxic)
    p, n = len(rows), len(toxic) - len(rows)
    if not p or not n or not entries:
        return []
    clean = np.bincount(np.concatenate([held[i] for i in np.flatnonzero(~toxic)]), minlength=entries).astype(np.float64)
    flat = np.concatenate([held[i] for i in rows])
    text = np.repeat(np.arange(p), [len(held[i]) for i in rows])
    order = np.argsort(flat, kind="stable")
    by_entry = np.split(text[order], np.searchsorted(flat[order], np.arange(1, entries)))
    left = np.ones(p)
    have = np.bincount(flat, minlength=entries).astype(np.float64)
    have[have < fit.documents] = 0
    taken: list[int] = []
    while True:
        evidence = _ratio(have, clean, p, n)
        best = int(np.argmax(evidence))
        if evidence[best] < fit.evidence:
            return taken
        taken.append(best)
        for i in by_entry[best].tolist():
            have[held[rows[i]]] -= (1 - fit.kept) * left[i]
            left[i] *= fit.kept
        have = np.maximum(have, 0)
        have[best] = 0


def _weighed(rows: list, taken: list[int], totals: dict[int, tuple[int, int]], groups: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of these entries, and the logarithms of how much more often toxic texts of the groups (clean, toxic) hold them."""
    words = [sum(totals[g[i]][1] for g in groups) + 1 for i in (0, 1)]
    times = [[sum(rows[x][f"times{g[i]}"] for g in groups) + 0.5 for i in (0, 1)] for x in taken]
    weights = np.array([math.log(t[1] / words[1]) - math.log(t[0] / words[0]) for t in times])
    keys = np.array([rows[x]["key"] for x in taken], dtype=np.int64).view(np.uint64)
    return keys[weights > 0.7], weights[weights > 0.7]


def learn(documents: DataFrame, labels: DataFrame, may_learn: Column, fit: Fit = Fit()) -> Model:
    """Fit on ``labels`` (doc_id, toxic) that ``may_learn`` (a condition on ``doc_id``) allows.

    Rows with a null id or label are left out; an id with several labels is
    toxic if one of them is; of several texts under one id the greatest is
    learned from, of equal texts one.  Without any label the model rests on the given words alone.
    """
    ready(documents)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    counted = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    limits = {1: fit.toxic, 0: fit.clean}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    share = F.when(F.col("toxic") == 1, limits[1] / max(1, counted.get(1, 0))).otherwise(limits[0] / max(1, counted.get(0, 0)))
    drawn = known.where(draw < share)  # about limits rows: what is broadcast is bounded
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies count once
    sample = stage(texts.select(F.col("toxic").cast("long").alias("toxic"), "text", half.cast("long").alias("half")), "labelled")
    table = stage(sample.select("toxic", "half", "text").mapInArrow(_count, "key bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)), "counts")
    totals = {g: (0, 0) for g in range(4)}
    for r in sample.groupBy((F.col("half") * 2 + F.col("toxic")).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect():
        totals[r["g"]] = (r["n"], r["chars"] // 6)  # rates only need the lengths' proportion
    every = {"01": [(0, 1), (2, 3)], "0": [(0, 1)], "1": [(2, 3)]}

    def ratio(groups: list[tuple[int, int]]) -> Column:
        a, b = (sum((F.col(f"texts{g[i]}") for g in groups), F.lit(0)) for i in (1, 0))
        p, n = (F.lit(sum(totals[g[i]][0] for g in groups)) for i in (1, 0))
        return F.when(a >= fit.documents, _evidence(a, b, p, n)).otherwise(0.0)

    words = table.groupBy("key").agg(*(F.sum(c).alias(c) for c in _COUNTS)).withColumns({f"evidence{k}": ratio(g) for k, g in every.items()})
    best = F.greatest(*(f"evidence{k}" for k in every))
    rows = words.where(best >= fit.evidence).orderBy(best.desc(), "key").limit(fit.entries).collect()
    places = np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)
    places, order = np.sort(places), np.argsort(places)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entries that each text holds."""
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for data, offsets, texts_of in pieces(batch.column("text")):
                tokens = Tokens(data, offsets)
                for words, hashes in ((np.arange(len(tokens.hashes)), tokens.hashes), *tokens.stems):
                    at = np.minimum(np.searchsorted(places, hashes), max(0, len(places) - 1))
                    hit = np.flatnonzero(places[at] == hashes) if len(places) else at[:0]
                    owner = texts_of[tokens.piece[words[hit]]]
                    for row in np.unique(owner).tolist():
                        found[row].append(order[at[hit[owner == row]]])
            held = [np.unique(np.concatenate(x)).astype(np.int32) if x else np.zeros(0, np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("half"), batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], names=["half", "toxic", "held"])

    kept = sample.mapInArrow(hold, "half bigint, toxic bigint, held array<int>").collect()  # as many rows as the sample
    lexicons = {}
    for which, groups in every.items():
        some = [r for r in kept if str(r["half"]) in which]
        taken = _cover([np.array(r["held"], dtype=np.int64) for r in some], np.array([r["toxic"] == 1 for r in some], dtype=bool), len(rows), fit)
        lexicons[which] = _weighed(rows, taken, totals, groups)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(Lexicon(*lexicons[k])) for k in ("1", "0")]  # words learned from the other half
        for batch in batches:
            halves = batch.column("half").to_numpy()
            for h in (0, 1):
                some = batch.filter(pa.array(halves == h))
                found = readers[h](some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("toxic"), pa.array(list(found), pa.list_(pa.float64()))], names=["toxic", "figures"])

    seen = sample.mapInArrow(read, "toxic bigint, figures array<double>").collect()  # as many rows as the sample
    y = np.array([r["toxic"] for r in seen], dtype=np.float64)
    figures = np.array([r["figures"] for r in seen], dtype=np.float64).reshape(len(seen), len(Reader.NAMES))
    size = {g: max(1.0, float((y == g).sum())) for g in (0, 1)}
    weight = np.where(y == 1, counted.get(1, 0) / size[1], counted.get(0, 0) / size[0]) * len(seen) / max(1, sum(counted.values()))
    return Model(*lexicons["01"], regression(features(figures), y, weight, fit.ridge))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression held to ``PRIOR``, by Newton's method."""
    beta = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * (beta - PRIOR)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


# ------------------------------------------------------------------- scoring


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``; other columns are left out.

    A null text is empty; an empty one gets what no match gives.  Texts are
    scored whole; one of more than ``PIECE`` bytes is read piece by piece, so that a
    clause of more than half of that may be cut.  Repeated rows are scored
    alike, an empty table gives no rows.
    """
    kind = ready(documents).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(model.keys, model.weights))
        for batch in batches:
            found = np.round(model.scores(reader(batch.column("text"))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Learn from the labels of rows that aren't held out, and score all ``documents``; see ``learn`` and ``score``."""
    return score(documents, learn(documents, labels, ~held_out(), fit))
