"""Token ids of texts by the tokenizers library, for use inside tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from shiftwise.llm.words import Words, slices

#: Token ids fit in 4 bytes; they are written as little-endian unsigned integers.
WIDTH = 4
#: Words whose ids a worker remembers (some 30 bytes each); when it has more, it keeps those of the texts at hand.
REMEMBERED = 3 << 19


class Encoder:
    """Encodes texts to ids.

    Many tokenizers drop white space and never look across it.  For those
    (``by_word``) a text's ids are those of its words, one after the other, so
    each different word goes through the library once and the worker remembers
    its ids, in arrays sorted by the word's hash.  Others get whole texts.  The
    result is the same.

    New words go through the library many at a time where the model marks the
    ends of words: a word of letters alone has one end mark, so the marks part
    the ids.  If there are more marks than words, they are encoded one by one.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)  # where a known word's ids begin in the pool
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.ends[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        texts = [x.decode() for x in words]
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts)) if self.ends.any() else np.zeros(len(texts), dtype=bool)
        size = np.zeros(len(texts), dtype=np.int64)
        pools, order = [self.pool], []
        for rows, encode in ((np.flatnonzero(letters), self._together), (np.flatnonzero(~letters), self._each)):
            for i in range(0, len(rows), 5000):
                some = rows[i:i + 5000]
                ids, size[some] = encode([texts[j] for j in some.tolist()])
                pools.append(ids)
                order.append(some)
        order = np.concatenate(order)
        first = np.zeros(len(texts), dtype=np.int64)
        first[order] = len(self.pool) + np.append(0, np.cumsum(size[order])[:-1])
        self.pool = np.concatenate(pools)
        rows = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[rows])
        self.known, self.first, self.size = (np.insert(old, place, new[rows]) for old, new in ((self.known, hashes), (self.first, first), (self.size, size)))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the known words, and whether it is there."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)

    def _forget(self, used: np.ndarray) -> None:
        at, there = self._find(used)
        at = np.sort(at[there])
        ids = self.pool[_spans(self.first[at], self.size[at])]
        self.known, self.size = self.known[at], self.size[at]
        self.first, self.pool = np.append(0, np.cumsum(self.size)[:-1]) if len(at) else self.size, ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; a null is empty."""
        if not self.by_word:
            return self._each([x or "" for x in texts.to_pylist()])
        w = Words(texts)
        code, used = pd.factorize(w.hashes(), sort=True)  # sorted, they are found nearer to each other among the known words
        at, there = self._find(used)
        if not there.all():
            if len(self.known) + len(used) > REMEMBERED:  # keep what is in use
                self._forget(used)
                there = self._find(used)[1]
            where = np.zeros(len(used), dtype=np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            new = np.flatnonzero(~there)
            data, at = w.data.tobytes(), where[new]
            self._learn(used[new], [data[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            at, _ = self._find(used)
        first, size = self.first[at][code], self.size[at][code]
        before = np.append(0, np.cumsum(size))
        return self.pool[_spans(first, size)], np.diff(before[w.first])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first to first + size - 1 of each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """The worker's encoder for this file, kept from task to task."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end mark after each text's, and where each text's begin (and the end)."""
    offsets = np.append(0, np.cumsum(sizes + 1))
    out = np.empty(int(offsets[-1]), dtype="<u4")
    is_id = np.ones(len(out), dtype=bool)
    is_id[offsets[1:] - 1] = False
    out[is_id] = ids
    out[offsets[1:] - 1] = end
    return out, offsets


def encoded(batches: Iterator[pa.RecordBatch], path: str, by_word: bool, end: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text, their ids with end marks, and where each row's begin."""
    encode = encoder(path, by_word)
    for batch in batches:
        for part in slices(batch, "text", limit):
            yield part, *with_end(*encode(part.column("text")), end)
