"""Token ids in Parquet: a row for each document, ids in a list column.

The files hold documents in ascending order of ``doc_id``.  Ids are
dictionary-encoded (a vocabulary is small), the integer columns delta-encoded
(format version 2), row groups and pages are kept small and each page has its
bounds in the page index, so a reader of some documents reads their pages, and
a reader of the metadata columns none of the ids.

Columns: doc_id, file_no (the file's place in the order), at (ids before the
document in its file), n_tokens, ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftwise.llm.staging import folder, ready
from shiftwise.llm.tokens import encoded

COLUMNS = ("doc_id", "file_no", "at", "n_tokens", "ids")


@dataclass(frozen=True)
class Layout:
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2000
    dictionary_bytes: int = 1 << 20
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec, "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes), "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(self.dictionary_bytes),
        }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, by_word: bool = False, layout: Layout = Layout()) -> None:
    """Encode ``docs`` (doc_id, text; other columns are left out) and write the files under ``path``.

    A null text has no ids but the end mark.  Rows with a null id come first,
    rows of one id in the order of their texts.  Ranges are cut by id and a hash
    of the text, so many rows of one id still make files of even size.  A text is
    encoded whole, so a very long one needs room for its ids in a worker.  An empty
    table writes files without rows.
    """
    rows = ready(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file_no = 0, TaskContext.get().partitionId()
        for part, ids, offsets in encoded(batches, tokenizer, by_word, end):
            n = np.diff(offsets)
            values = pa.array(ids.view("<i4"))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(np.full(len(n), file_no, np.int32)), pa.array(at + offsets[:-1]), pa.array(n),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
            ], names=COLUMNS)
            at += int(offsets[-1])

    rows.mapInArrow(run, f"doc_id {kind}, file_no int, at bigint, n_tokens bigint, ids array<int>").write.options(**layout.options()).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens; reads no ids."""
    rows = spark.read.parquet(path).select("doc_id", "file_no", "at", "n_tokens")
    return _with_start(spark, path, rows).drop("file_no", "at")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents that ``where`` selects (by its doc_id, pushed to the files)."""
    rows = spark.read.parquet(path)
    return _with_start(spark, path, rows if where is None else rows.where(where)).drop("file_no", "at")


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """A row for each file tells the ids before it."""
    files = spark.read.parquet(path).groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(first, "file_no").withColumn("start", F.col("first") + F.col("at")).drop("first")


def crc_of_ids(df: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned crc32 of them as little-endian 4-byte integers."""
    keep = [f for f in ready(df).schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            off = ids.offsets.to_numpy() * 4
            crc = [zlib.crc32(values[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(crc, pa.int64())], names=[f.name for f in keep] + ["ids_crc32"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end: int, by_word: bool = False) -> DataFrame:
    """Write the files to the shared folder and read back every document's start, length and checksum.

    One row for each row of ``docs``, those without an id first; none for an empty table.  See ``write_tokens``.
    """
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    write_tokens(docs, path, tokenizer, end, by_word)
    sums = crc_of_ids(spark.read.parquet(path))  # before the join, which then moves no ids
    return _with_start(spark, path, sums).select("doc_id", "start", "n_tokens", "ids_crc32")
