"""Hard negatives by a vertical scan over columnar dimensions (BOND).

The vectors are cut into blocks that keep every dimension as a column.  An
anchor reads a block's dimensions in the order of its own magnitudes, the
largest first.  After some dimensions a row's score lies between its partial
score plus the least and plus the most that the dimensions still unread can
add, which the least and the largest value of each column in the block bound.
Rows whose bounds fit nothing asked for leave the bitmap; the others are read
to the end, so the result is exact.

The scan runs twice: for the best rows of an anchor's own label (positives),
then for the best rows of other labels inside the score window of each positive.
A unit of work is one block and one set of anchors, both of bounded size;
each task returns what its block has for an anchor, a few rows, and these
are merged by windows in Spark.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.llm.staging import ready, stage


@dataclasses.dataclass(frozen=True)
class Mining:
    """What is mined: scores in ``scale`` steps a unit, ``positives`` of an anchor, ``negatives`` of a pair.

    A negative's score lies between ``low`` and ``high`` hundredths of the
    positive's.  ``block`` rows and ``anchors`` anchors make one unit of work.
    """

    dim: int = 64
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block: int = 4096
    anchors: int = 4096

    @property
    def largest(self) -> int:
        """Components up to this size keep every score inside a long."""
        return int((2 ** 62 // self.dim) ** 0.5)


def usable(mining: Mining) -> Column:
    """Rows that take part: an id, a label, and ``dim`` finite components whose scores fit a long."""
    bound = mining.largest / mining.scale
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") == mining.dim) & fine, F.lit(False))


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dims", pa.list_(pa.binary())), ("key", pa.int64())])
_BLOCK_DDL = "ids array<bigint>, labels array<bigint>, dims array<binary>, key bigint"


def _columnar(mining: Mining, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts a partition's rows into blocks, each a row with one binary column a dimension."""
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, mining.dim)
        whole = np.floor(values * float(mining.scale)).astype(np.int64)
        dims = [np.ascontiguousarray(whole[:, d]).tobytes() for d in range(mining.dim)]
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        return pa.RecordBatch.from_pylist([{"ids": ids, "labels": labels, "dims": dims, "key": ids[0]}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == rows:
                    yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


class Block:
    """A block's columns with the least and largest value of each."""

    def __init__(self, row: dict):
        self.ids = np.asarray(row["ids"], dtype=np.int64)
        self.labels = np.asarray(row["labels"], dtype=np.int64)
        self.dims = [np.frombuffer(x, dtype=np.int64) for x in row["dims"]]
        self.low = np.array([x.min() for x in self.dims])
        self.high = np.array([x.max() for x in self.dims])

    def scan(self, anchor: np.ndarray, rows: np.ndarray, narrow: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ``narrow`` (least and largest possible scores -> rows to keep) leaves, and their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor * self.low, anchor * self.high
        least = _unread(np.minimum(*ends)[order])
        most = _unread(np.maximum(*ends)[order])
        score = np.zeros(len(rows), dtype=np.int64)
        full = len(rows) == len(self.ids)
        for i, d in enumerate(order.tolist()):
            column = self.dims[d]
            score += (column if full else column[rows]) * anchor[d]
            if i % 8 == 7 or i + 1 == len(order):
                keep = narrow(score + least[i + 1], score + most[i + 1])
                if not keep.all():
                    rows, score, full = rows[keep], score[keep], False
                    if not len(rows):
                        break
        return rows, score


def _unread(values: np.ndarray) -> np.ndarray:
    """Sums of what is left from each place on; the last is 0."""
    return np.append(np.cumsum(values[::-1])[::-1], 0)


def _at_least(values: np.ndarray, k: int) -> int | None:
    """The ``k``-th largest, None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _best_of_label(block: Block, anchor: np.ndarray, own: int, label: int, k: int) -> list[tuple[int, int]]:
    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        kth = _at_least(least, k)
        return np.ones(len(most), dtype=bool) if kth is None else most >= kth
    rows, scores = block.scan(anchor, np.flatnonzero((block.labels == label) & (block.ids != own)), narrow)
    ids = block.ids[rows]
    return [(int(ids[i]), int(scores[i])) for i in _first(ids, scores, k)]


def _best_in_windows(block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (least, largest score), the ``k`` best rows of other labels inside."""
    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), dtype=bool)
        for low, high in windows:
            sure = least[(least >= low) & (most <= high)]
            kth = _at_least(sure, k)
            keep |= (most >= (low if kth is None else kth)) & (least <= high)
        return keep
    rows, scores = block.scan(anchor, np.flatnonzero(block.labels != label), narrow)
    ids = block.ids[rows]
    out = []
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        best = inside[_first(ids[inside], scores[inside], k)]
        out.append([(int(ids[i]), int(scores[i])) for i in best])
    return out


def _units(anchors: pa.Table, blocks: pa.Table, mining: Mining) -> Iterator[tuple[Block, list[dict]]]:
    """A group's blocks, one after the other, and its anchors (id, label, vector, positives)."""
    chosen = [x for row in anchors["anchors"].to_pylist() for x in row]
    for x in chosen:
        x["vector"] = np.floor(np.asarray(x["vector"], dtype=np.float64) * mining.scale).astype(np.int64)
    for i in range(blocks.num_rows if chosen else 0):
        yield Block(blocks.slice(i, 1).to_pylist()[0]), chosen


def _positives(anchors: pa.Table, blocks: pa.Table, mining: Mining) -> pa.Table:
    found = [(x["id"], *y) for block, chosen in _units(anchors, blocks, mining) for x in chosen
             for y in _best_of_label(block, x["vector"], x["id"], x["label"], mining.positives)]
    return _rows(found, ("anchor_id", "positive_id", "positive_score"))


def _negatives(anchors: pa.Table, blocks: pa.Table, mining: Mining) -> pa.Table:
    found = []
    for block, chosen in _units(anchors, blocks, mining):
        for x in chosen:
            windows = [(-(-mining.low * y["score"] // 100), mining.high * y["score"] // 100) for y in x["positives"]]
            wanted = [(a, b) for a, b in windows if a <= b]
            if wanted:
                best = dict(zip(wanted, _best_in_windows(block, x["vector"], x["label"], wanted, mining.negatives), strict=True))
                found += [(x["id"], y["place"], y["id"], y["score"], *z) for w, y in zip(windows, x["positives"], strict=True) for z in best.get(w, ())]
    return _rows(found, ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"))


def _rows(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [()] * len(names)
    return pa.table([pa.array(x, pa.int64()) for x in columns], names=list(names))


def _longs(*names: str) -> str:
    return ", ".join(f"{x} bigint" for x in names)


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def mine(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``vectors`` needs ``vec_id``, ``label`` and ``embedding`` and may have any
    other columns; ``is_anchor`` tells the anchors by ``vec_id``.  A component x
    becomes floor(scale * x); scores are exact integer inner products, ties go
    to the smaller id.

    Rows without an id, a label or a vector, with a vector of another length,
    with a null or non-finite component, or with one so large that scores might
    not fit a long, take no part.  Repeated rows each count as a candidate, but
    never for an anchor of their own id; an anchor id with several rows is
    the one with the least label, then vector.  An anchor without rows of
    its label, or a pair without rows in its window, gives no rows; an empty
    table gives none.
    """
    ready(vectors)
    rows = vectors.where(usable(mining)).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    blocks = stage(rows.mapInArrow(_columnar(mining, mining.block), _BLOCK_DDL), "blocks")
    chosen = rows.where(is_anchor).groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("label", "embedding")).alias("least"))
    chosen = stage(chosen.select("id", "least.label", F.col("least.embedding").alias("vector")), "anchors")
    sets = max(1, -(-chosen.count() // mining.anchors))

    places = max(1, blocks.count())

    def scanned(anchors: DataFrame, scan: Callable, ddl: str) -> DataFrame:
        """Every block against every set of anchors: groups of about one block and one set, both of bounded size."""
        dealt = anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(sets)).alias("set")).agg(F.collect_list(F.struct(*(c for c in anchors.columns))).alias("anchors"))
        dealt = dealt.withColumn("place", F.explode(_upto(places)))
        units = blocks.withColumn("place", F.pmod(F.xxhash64("key"), F.lit(places))).withColumn("set", F.explode(_upto(sets)))
        return dealt.groupBy("set", "place").cogroup(units.groupBy("set", "place")).applyInArrow(functools.partial(scan, mining=mining), ddl)

    found = scanned(chosen, _positives, _longs("anchor_id", "positive_id", "positive_score"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= mining.positives)
    positives = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    paired = stage(chosen.join(positives, "id"), "positives")
    names = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
    found = scanned(paired, _negatives, _longs(*names))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
