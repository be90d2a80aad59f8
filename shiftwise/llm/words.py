"""Words, shingles and windows of an Arrow column of texts, as numpy arrays.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; in UTF-8
none of these bytes occurs inside another character, so splitting bytes equals
splitting code points.  All functions work on the UTF-8 buffer of a whole
record batch, so the cost per word is a few vector operations; nothing here
depends on the process, the machine or Python's hash seed.

Hashes are 64 bits wide: a polynomial over a random byte table, then a
finalizer.  They stand for word sequences in joins inside the operators; the
places that need more confirm the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MAX64 = U64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text hashed at a time; bounds the temporary arrays (8 bytes a byte).
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240601))
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_COEF = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * U64(2) + U64(1)
_WBASE = int(_rng.integers(0, 2**63)) * 2 + 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z lower-cased, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = U64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step
        done += take
    return out


_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(10, (max(n, 1) - 1).bit_length())
    if size > 1 << 21:  # a table this long is not worth keeping
        return _powers(base, n)
    if (base, size) not in _cache:
        _cache[base, size] = _powers(base, size)
    return _cache[base, size][:n]


_INV = {b: pow(b, -1, 1 << 64) for b in (_BASE, _WBASE)}


def _window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum(values[i] * base**(i - start)) over start <= i < end, modulo 2**64."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_INV[base], n + 1)[starts]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        lo = starts[i]
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix(_window_sums(_TABLE[data[lo:lo + e[-1]]], s, e, _BASE) + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """The words of every text of a column, in order.

    ``starts``/``ends`` are byte positions in ``data``; the words of text ``i``
    are ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = buffers(texts)
        if lower and len(self.data):
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        closes = inside
        closes[:-1] &= ~inside[1:] | edge[1:n]
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """For each word, the text it belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def short_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position (entries near the end reach past it: see ``room``)."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(k):
        out[:len(hashes) - j] += hashes[j:] * _COEF[j]
    return mix(out)


def long_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The same for many words, by differences of running sums."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    step = SLICE
    for i in range(0, max(0, len(hashes) - k + 1), step):
        part = hashes[i:i + step + k - 1]
        at = np.arange(len(part) - k + 1)
        out[i:i + len(at)] = mix(_window_sums(part, at, at + k, _WBASE) + U64(k))
    return out


def sliding(values: np.ndarray, k: int, op=np.minimum) -> np.ndarray:
    """op over values[i:i + k]; the last k - 1 entries cover what is left."""
    out, width = values.copy(), 1
    while width * 2 <= k:
        if width < len(out):  # else each entry covers all that is left
            out[:len(out) - width] = op(out[:len(out) - width], out[width:])
        width *= 2
    rest = k - width
    if 0 < rest < len(out):
        out[:len(out) - rest] = op(out[:len(out) - rest].copy(), out[rest:].copy())
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``k``-word shingles, A-Z lower-cased.

    A text of one to ``k - 1`` words has its whole word sequence as its only
    shingle; a text without words (or null) has none.
    """
    w = Words(texts, lower=True)
    h = w.hashes()
    windows = short_windows(h, k) if len(h) else h
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(windows[a:b - k + 1])
        elif b > a:
            tail = np.zeros(b - a, dtype=np.uint64)
            tail[:] = h[a:b] * _COEF[k:k + b - a]
            yield mix(tail.sum(dtype=np.uint64, keepdims=True) + U64(int(b - a)))
        else:
            yield h[:0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``rows`` rows with at most ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(column))
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j
