"""Harmonic packing of documents into training sequences.

Lengths fall into reciprocal-capacity classes: class ``k`` holds lengths of at
most ``capacity / k``, and a bin of the class always takes ``k`` pieces.  A
document is first cut so that its pieces nearly fill their classes:

* full pieces of ``capacity`` tokens (class 1) while it has that many;
* the rest goes whole to the class ``k = capacity // rest`` if ``k`` such pieces
  leave at most ``slack`` tokens of a bin; else a piece of exactly
  ``capacity // (k + 1)`` is cut off and the rest is looked at again.

Bins need nothing but a count, so every worker fills its own as it encodes its
share of the documents; it holds at most one open bin a class.  What is left in
the open bins of all workers is filled once more, class by class, in groups of
bounded size; what is left then - under one bin a class and group - is laid end
to end and cut at the capacity, so that only the last sequence of a group is
short.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.llm.staging import ready, stage
from shiftwise.llm.tokens import WIDTH, encoded

PIECES = "start bigint, length bigint, doc_tokens bigint, class int, sequence_id bigint, offset bigint, ids binary"


@lru_cache(maxsize=1 << 16)
def cut(rest: int, capacity: int, slack: int) -> tuple[tuple[int, int], ...]:
    """(class, length) of the pieces of a rest of under ``capacity`` tokens."""
    out = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append((k, rest))
            break
        out.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    return tuple(out)


def _filled(batches: Iterator[pa.RecordBatch], kind: pa.DataType, tokenizer: str, by_word: bool, end: int, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Encode, cut and fill the bins of one worker."""
    first, made = TaskContext.get().partitionId() << 32, 0
    open_bins: dict[int, list] = defaultdict(list)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "class", "sequence_id", "offset", "ids"])

    for part, ids, offsets in encoded(batches, tokenizer, by_word, end):
        rows: list[tuple] = []
        data = memoryview(ids).cast("B")
        for doc, at, to in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            blob, n, start = data[WIDTH * at:WIDTH * to], to - at, 0
            for k, length in (*[(1, capacity)] * (n // capacity), *cut(n % capacity, capacity, slack)):
                bin_ = open_bins[k]
                bin_.append((doc, start, length, n, bytes(blob[WIDTH * start:WIDTH * (start + length)])))
                start += length
                if len(bin_) == k:
                    offset = 0
                    for d, s, size, of, piece in bin_:
                        rows.append((d, s, size, of, k, first + made, offset, piece))
                        offset += size
                    made += 1
                    del open_bins[k]
        yield told(rows)
    yield told([(d, s, size, of, k, None, None, piece) for k, bin_ in open_bins.items() for d, s, size, of, piece in bin_])


def _refilled(left: DataFrame, capacity: int, group_rows: int) -> DataFrame:
    """Fill the pieces of open bins again, then lay the last ones end to end."""
    groups = max(1, left.count() // group_rows)
    left = left.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", F.crc32("ids")), F.lit(groups)).cast("long"))
    by_class = Window.partitionBy("group", "class")
    order = by_class.orderBy("doc_id", "start", "doc_tokens", "ids")
    row, n = F.row_number().over(order) - 1, F.count("*").over(by_class)
    left = left.withColumn("row", row).withColumn("bin", F.floor(F.col("row") / F.col("class"))).withColumn("full", (F.col("bin") + 1) * F.col("class") <= n)
    # the groups' numbers begin past those of any worker, those of the last sequences past the bins'
    inside = Window.partitionBy("group", "class", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(1 << 60) + F.col("group") * (1 << 36)
    columns = [c for c in left.columns if c not in ("group", "row", "bin", "full")]
    full = left.where("full").withColumn("sequence_id", base + F.col("class").cast("long") * (1 << 20) + F.col("bin")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(columns)
    line = Window.partitionBy("group").orderBy("class", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = left.where("not full").withColumn("at", F.coalesce(F.sum("length").over(line), F.lit(0)))
    head = F.least(F.col("length"), capacity - F.col("at") % capacity)
    parts = F.array(F.struct(F.lit(0).cast("long").alias("skip"), head.alias("size")), F.struct(head.alias("skip"), (F.col("length") - head).alias("size")))
    last = last.withColumn("part", F.explode(F.filter(parts, lambda p: p["size"] > 0)))
    at = F.col("at") + F.col("part.skip")
    last = last.withColumns({
        "sequence_id": base + (1 << 61) + F.floor(at / capacity), "offset": at % capacity, "start": F.col("start") + F.col("part.skip"), "length": F.col("part.size"),
        "ids": F.substring("ids", (F.col("part.skip") * WIDTH + 1).cast("int"), (F.col("part.size") * WIDTH).cast("int")),
    }).select(columns)
    return full.unionByName(last)


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048, by_word: bool = False, slack: int | None = None, group_rows: int = 20_000) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text; other columns are left out) with their place in a sequence, and their ids.

    A null or empty text is its end mark alone.  Repeated rows are packed each
    by itself.  A text is encoded whole and cut freely, however long it is: its
    pieces are as many rows.  An empty table gives no rows.  ``ids`` are little-endian 4-byte
    integers.
    """
    slack = capacity // 128 if slack is None else slack
    kind = ready(docs).schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        yield from _filled(batches, to_arrow_type(kind), tokenizer, by_word, end, capacity, slack)

    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(PIECES)])
    pieces = stage(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")
    left = pieces.where("sequence_id is null")
    return pieces.where("sequence_id is not null").unionByName(_refilled(left, capacity, group_rows))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum instead of their ids; a row for each piece, so none for an empty table."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
