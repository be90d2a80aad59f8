"""Word vectors by skip-gram with negative sampling, for a vocabulary of any size (M7).

Neither the driver nor a task ever holds the whole vocabulary:

1. Training: each block of texts starts from vectors that the words' hashes give,
   alike in all blocks, and trains those of its own words.  A word's vector is the
   mean over the blocks that have it, by its occurrences there: one aggregate.
2. Averaging: the words of a block of texts get their vectors by a join on the
   word, and a cogroup by block brings texts and vectors together.

Blocks hold some megabytes of text, so a task's memory does not grow with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.operators.ml import bytes_of, tokens
from shiftwise.session import checkpoint_dir, ship_package

# Fixed values of the training: text of a block, words trained at once, noise words shared by them, noise words a pair stands for.
BLOCK_BYTES = 8 << 20
BATCH_WORDS, NOISE, NOISE_PER_PAIR = 512, 32, 5


def first_vectors(words: pa.Array, size: int, seed: int) -> np.ndarray:
    """Small vectors that depend on the words and the seed alone."""
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[:, None]
    x = h + np.uint64(0x9E3779B97F4A7C15) * np.arange(1 + seed * size, 1 + (seed + 1) * size, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x >> np.uint64(40)).astype(np.float32) / (1 << 24)) - np.float32(0.5)) / np.float32(size)


def _add_by_word(table: np.ndarray, squares: np.ndarray, code: np.ndarray, slope: np.ndarray, rate: float) -> None:
    """One AdaGrad step of the words at hand, each by the sum of its slopes."""
    order = np.argsort(code, kind="stable")
    found = code[order]
    begin = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    total, word = np.add.reduceat(slope[order], begin, axis=0), found[begin]
    squares[word] += np.mean(total * total, axis=1)
    table[word] += rate * total / np.sqrt(squares[word] + np.float32(1e-8))[:, None]


def train_block(code: np.ndarray, text: np.ndarray, counts: np.ndarray, vectors: np.ndarray, window: int, rate: float, seed: int) -> np.ndarray:
    """Skip-gram over the words of some texts: ``code`` their places in ``vectors``, ``text`` the text of each.

    Each word and each of the up to ``window`` words on both sides in its text is a pair.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros_like(vectors)
    sq_in, sq_out = np.zeros(len(vectors), np.float32), np.zeros(len(vectors), np.float32)
    noise = np.cumsum(counts ** 0.75)
    for a in range(0, len(code), BATCH_WORDS):
        c, t = code[max(0, a - window):a + BATCH_WORDS], text[max(0, a - window):a + BATCH_WORDS]
        v, u = vectors[c], out[c]
        to_v, to_u, pairs = np.zeros_like(v), np.zeros_like(u), np.zeros(len(c), np.float32)
        old = a - max(0, a - window)  # words of the last batch: only their pairs with new ones count
        for d in range(1, min(window, len(c) - 1) + 1):
            near = (t[d:] == t[:-d]) & (np.arange(d, len(c)) >= old)
            for x, y, to_x, to_y in ((v[:-d], u[d:], to_v[:-d], to_u[d:]), (v[d:], u[:-d], to_v[d:], to_u[:-d])):
                g = (near / (1 + np.exp(np.einsum("ij,ij->i", x, y)))).astype(np.float32)[:, None]
                to_x += g * y
                to_y += g * x
            pairs[:-d] += near
            pairs[d:] += near
        bad = np.minimum(np.searchsorted(noise, rng.random(NOISE) * noise[-1]), len(noise) - 1)
        n = out[bad]
        g = pairs[:, None] * np.float32(NOISE_PER_PAIR / NOISE) / (1 + np.exp(-(v @ n.T)))
        to_v -= g @ n
        _add_by_word(vectors, sq_in, c, to_v, rate)
        _add_by_word(out, sq_out, np.append(c, bad), np.concatenate([to_u, -(g.T @ v)]), rate)
    return vectors


def _coded(lists: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of some columns of word lists, the place of each word among them, and the words of each row."""
    coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]) if lists else np.zeros(0, int)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), sizes


def _train(size: int, window: int, rate: float, seed: int, block_words: int):
    """(word, n, v): the words of each run of rows, their occurrences, and their trained vectors."""
    def block(lists: list[pa.Array]) -> pa.RecordBatch:
        words, code, sizes = _coded(lists)
        counts = np.bincount(code, minlength=len(words))
        made = train_block(code, np.repeat(np.arange(len(sizes)), sizes), counts, first_vectors(words, size, seed), window, rate, seed) if len(code) else np.zeros((0, size), np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, size, dtype=np.int32)), pa.array(made.ravel()))
        return pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64()), flat], names=["word", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            column, i = batch.column(0), 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, int)
            while i < len(column):
                before = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + block_words - n, side="right")))
                held.append(column.slice(i, j - i))
                n += int(ends[j - 1] - before)
                i = j
                if n >= block_words or i < len(column):
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)
    return run


def _average(size: int, names: list[str]):
    """The rows of a block, each with the mean of its words' vectors (words without one count as zeros)."""
    def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        words, code, sizes = _coded(rows["_w"].chunks)
        table = np.zeros((vectors.num_rows + 1, size), np.float64)  # the last: words without a vector
        if vectors.num_rows:
            table[:-1] = pc.list_flatten(vectors["v"]).to_numpy().reshape(-1, size)
        known = vectors["word"].combine_chunks()
        place = pc.fill_null(pc.index_in(words, value_set=known), vectors.num_rows).to_numpy(zero_copy_only=False) if vectors.num_rows else np.zeros(len(words), int)
        ends = np.append(0, np.cumsum(sizes))
        mean = np.zeros((len(sizes), size))
        for i in range(len(sizes)):
            if sizes[i]:
                mean[i] = table[place[code[ends[i]:ends[i + 1]]]].mean(axis=0)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, mean.size + 1, size, dtype=np.int32)), pa.array(mean.ravel()))
        return pa.table([*(rows[n] for n in names), flat], names=[*names, "_mean"])
    return run


def _blocks(df: DataFrame, text: str) -> int:
    return bytes_of(df, text) // BLOCK_BYTES + 1


class WordVectors(Estimator):
    """Vectors of the words of ``text`` that occur ``min_count`` times or more."""

    def __init__(self, text: str, out: str, size: int = 50, min_count: int = 2, window: int = 5, rate: float = 0.05, seed: int = 42):
        super().__init__()
        self.text, self.out, self.size, self.min_count, self.window, self.rate, self.seed = text, out, size, min_count, window, rate, seed

    def _fit(self, dataset: DataFrame) -> WordVectorsModel:
        spark = dataset.sparkSession
        ship_package(spark)
        checkpoint_dir(spark)
        n, v = _blocks(dataset, self.text), [f"v{j}" for j in range(self.size)]
        rows = dataset.repartition(n, F.xxhash64(*dataset.columns)).select(tokens(self.text).alias("_w"))
        made = rows.mapInArrow(_train(self.size, self.window, self.rate, self.seed, BLOCK_BYTES // 4), "word string, n bigint, v array<float>").repartition(n, "word")
        made = made.select("word", "n", *((F.col("v")[j].cast("double") * F.col("n")).alias(x) for j, x in enumerate(v))).groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in v))
        made = made.where(F.col("n") >= self.min_count).select("word", F.array(*((F.col(x) / F.col("n")).cast("float") for x in v)).alias("v"))
        return WordVectorsModel(made.checkpoint(), self.text, self.out, self.size)


class WordVectorsModel(Model):
    """``vectors``: word and v, its components, a table that stays in the cluster."""

    def __init__(self, vectors: DataFrame, text: str, out: str, size: int):
        super().__init__()
        self.vectors, self.text, self.out, self.size = vectors, text, out, size

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        n, names = _blocks(dataset, self.text), dataset.columns
        rows = dataset.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(n))).repartition(n, "_block").withColumn("_w", tokens(self.text))
        words = rows.select(F.col("_block").alias("_of"), F.explode("_w").alias("word")).distinct()
        found = words.join(self.vectors.repartition(n, "word"), "word")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dataset.schema)
        made = rows.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(_average(self.size, names), f"{kinds}, _mean array<double>")
        return made.select(*names, array_to_vector("_mean").alias(self.out))
