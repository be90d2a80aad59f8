"""SentencePiece models on the tokenizers library.

The model file is read here (its protobuf has three messages of interest) and
rebuilt as a ``tokenizers`` tokenizer: the normaliser with its precompiled
character map, white-space rules and metaspace marker; unigram scores, or for a
BPE model the merges that its scores imply; byte fallback; the decoder.

Pieces of both model kinds never cross certain boundaries: if no piece holds a
marker after another character, nothing joins over the start of a run of
markers, and a character that no longer piece holds joins with nothing.  A
normalised text then falls into chunks, and its ids are those of its chunks.
Each different chunk is encoded once a worker, by batches, with as many threads
as asked for; the same chunk is encoded by the sentencepiece library itself and
decoded again, and a document whose chunks all agree is marked as verified.
Models without such boundaries, or with a character map, get whole texts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from shiftwise.llm.staging import ready
from shiftwise.llm.tokens import REMEMBERED
from shiftwise.llm.words import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = data[at:at + size], at + size
        yield number, value


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, type
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def read_model(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return Model(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""),
                 bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, those of the best score first."""
    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, UNUSED)}
    found = []
    for text, i in ids.items():
        for at in range(1, len(text)):
            left, right = text[:at], text[at:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [x[4:] for x in sorted(found)]


def normalizer(model: Model):
    from tokenizers import Regex, normalizers
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(model: Model, normalize: bool = True):
    """The model as a tokenizer; without ``normalize`` it takes normalised text."""
    from tokenizers import AddedToken, Tokenizer, decoders, models
    if model.kind == UNIGRAM:
        inner = models.Unigram([(t, s) for t, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {t: i for i, (t, _, _) in enumerate(model.pieces)}
        inner = models.BPE(vocab, _merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models")
    out = Tokenizer(inner)
    if normalize:
        out.normalizer = normalizer(model)
    out.add_tokens([AddedToken(t, normalized=False) for t, _, kind in model.pieces if kind == USER])
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix and normalize else [])])
    return out


def lone_characters(model: Model) -> str:
    """Of line breaks and tabs, those that no piece holds."""
    held = set(chain.from_iterable(t for t, _, kind in model.pieces if kind in (NORMAL, UNUSED, USER)))
    return "".join(c for c in "\n\r\t" if c not in held)


def chunk_pattern(model: Model) -> re.Pattern | None:
    """Matches the chunks of a text after normalisation; null if there are none to rely on."""
    usable = [t for t, _, kind in model.pieces if kind in (NORMAL, UNUSED, USER)]
    if model.charsmap or model.trim_spaces or not model.escape_spaces or not model.byte_fallback or any(kind == USER for _, _, kind in model.pieces):
        return None
    if any(MARK in t.lstrip(MARK) for t in usable):
        return None
    lone = lone_characters(model)
    alone = f"[{re.escape(lone)}]+|" if lone else ""
    return re.compile(f"{alone}{MARK}*[^{MARK}{re.escape(lone)}]+|{MARK}+")


class PieceEncoder:
    """Ids of texts by both libraries.

    ``threads``: of the tokenizers library for a batch; a Spark task has one core.
    """

    def __init__(self, path: str, threads: int = 1):
        import sentencepiece
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = read_model(f.read())
        self.whole, self.inner = build(self.model), build(self.model, normalize=False)
        self.chunks = chunk_pattern(self.model)
        self.native = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.normaliser = self.whole.normalizer
        self.lone = lone_characters(self.model)[:1]
        self.before = len(self.native.encode(self.lone))
        self.known: dict[str, tuple[bytes, bool]] = {}

    def normalise(self, text: str) -> str:
        """The text as the rebuilt normaliser and metaspace step leave it; an empty text stays empty."""
        return self.normaliser.normalize_str(text) if self.normaliser else text

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Little-endian 4-byte ids of each text, and whether both libraries agree and decoding restores it."""
        if self.chunks is None:
            found = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.native.encode(texts, num_threads=self.threads)
            back, restored = self.whole.decode_batch(found, skip_special_tokens=False), self.native.decode(theirs)
            return [(array("I", x).tobytes(), x == y and a == b) for x, y, a, b in zip(found, theirs, back, restored, strict=True)]
        parts = [self.chunks.findall(self.normalise(x)) for x in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set(chain.from_iterable(parts)))
        self.known.update(zip(new, self._chunks(new), strict=True))
        out = []
        for own in parts:
            found = [self.known[x] for x in own]
            out.append((b"".join([x for x, _ in found]), all(ok for _, ok in found)))
        return out

    def _chunks(self, new: list[str]) -> Iterator[tuple[bytes, bool]]:
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            found = [x.ids for x in self.inner.encode_batch_fast(some, add_special_tokens=False)]
            back = self.inner.decode_batch(found, skip_special_tokens=False)
            # the native library marks the start of a text: the marker is left to it, or the chunk stands after a character that joins with nothing
            bare = [self.model.dummy_prefix and not (x.startswith(MARK) and x.strip(MARK)) for x in some]
            plain = [self.lone + x if alone else x[self.model.dummy_prefix:] for x, alone in zip(some, bare, strict=True)]
            theirs = self.native.encode([x.replace(MARK, " ") for x in plain], num_threads=self.threads)
            for chunk, ids, text, alone, other in zip(some, found, back, bare, theirs, strict=True):
                yield array("I", ids).tobytes(), ids == (other[self.before:] if alone else other) and text == chunk.replace(MARK, " ")

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, threads: int = 1) -> PieceEncoder:
    if (path, threads) not in _encoders:
        _encoders[path, threads] = PieceEncoder(path, threads)
    return _encoders[path, threads]


def encode(docs: DataFrame, path: str, threads: int = 1) -> DataFrame:
    """(doc_id, ids, verified): the pieces of every text of ``docs`` (doc_id, text; other columns are left out).

    ``verified``: sentencepiece gives the same ids and decoding them restores
    the normalised text: of the whole text, or, where the model's texts fall into
    chunks that are encoded alike wherever they stand, of each of its different chunks.
    A null or empty text has no ids and is verified.  Rows are encoded each by
    itself, whole, so a text needs room for its ids in a worker; an empty table
    gives no rows.
    """
    kind = ready(docs).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path, threads)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                made = pieces.encode([x or "" for x in part.column("text").to_pylist()])
                values = pa.Array.from_buffers(pa.int32(), sum(len(x) for x, _ in made) // 4, [None, pa.py_buffer(b"".join(x for x, _ in made))])
                offsets = [0]
                for x, _ in made:
                    offsets.append(offsets[-1] + len(x) // 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array([ok for _, ok in made], pa.bool_())], names=["doc_id", "ids", "verified"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, verified boolean")


def decode(encoded: DataFrame, path: str, threads: int = 1) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    kind = ready(encoded).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path, threads)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = iter(pieces.decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else next(texts) for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, path: str, threads: int = 1) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, verified) of every document; the checksum is over little-endian 4-byte ids.

    Nulls, empty and very long texts, repeated rows and empty tables: see ``encode``.
    """
    kind = ready(docs).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path, threads)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                made = pieces.encode([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(x) // 4 for x, _ in made], pa.int64()),
                    pa.array([zlib.crc32(x) for x, _ in made], pa.int64()), pa.array([ok for _, ok in made], pa.bool_()),
                ], names=["doc_id", "n_tokens", "ids_crc32", "verified"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, verified boolean")
