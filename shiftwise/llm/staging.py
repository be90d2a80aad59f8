"""Intermediate tables in the shared folder, and other helpers of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.session import checkpoint_dir, ship_package


def folder(spark: SparkSession, name: str) -> str:
    """A new place under ``spark.checkpoint.dir`` for a table called ``name``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at a time: some megabytes of text, of which an executor holds a few copies a core outside its heap.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here hand rows to the workers ``BATCH_ROWS`` at a time, or fewer if the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS if int(held) <= 0 else min(BATCH_ROWS, int(held))))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint: a lost executor costs no more than its
    tasks of the current job.  Unlike one, the table is columnar and
    compressed, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = folder(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(df: DataFrame) -> DataFrame:
    """Ship the package to the workers, before a function of it is made part of a plan."""
    ship_package(df.sparkSession)
    return df


#: Words of 64 bits of the table by which ``likely`` rows are found; bounds what is broadcast, at any size of the tables.
FILTER_WORDS = 1 << 20


def _place(key: Column) -> tuple[Column, Column]:
    """The word of the table that a key has its bit in, and that bit."""
    at = F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def likely(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``ids``: before a join, so that it doesn't move the others.

    Each key of ``ids`` sets a bit of a table of fixed size, which is broadcast.
    Rows whose bit isn't set go; a few others stay, and the join drops them.
    """
    word, bit = _place(ids[key])
    bits = ids.groupBy(word.alias("filter_word")).agg(F.bit_or(bit).alias("filter_bits"))
    word, bit = _place(df[key])
    return df.join(F.broadcast(bits), (word == bits["filter_word"]) & (bit.bitwiseAND(bits["filter_bits"]) != 0), "left_semi")


def told_apart(df: DataFrame, ids: DataFrame, key: str, wanted: str, unclear: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` is surely among the ``wanted`` of ``ids``, and those of which only a join can tell.

    ``ids`` has every key that ``df`` has; each row is wanted, or unclear, or
    both.  As in ``likely`` a table of fixed size is broadcast, with a bit for
    the wanted and one for the unclear keys: a row with the first alone is
    wanted, one without the first is in neither part, and neither moves.  Null
    keys are in no part.
    """
    at, yes, doubt = (free_name(df, x) for x in ("filter_word", "filter_wanted", "filter_unclear"))
    word, bit = _place(ids[key])
    bits = ids.groupBy(word.alias(at)).agg(F.bit_or(F.when(F.col(wanted), bit)).alias(yes), F.coalesce(F.bit_or(F.when(F.col(unclear), bit)), F.lit(0).cast("long")).alias(doubt))
    word, bit = _place(df[key].cast(ids.schema[key].dataType))
    found = df.where(df[key].isNotNull()).join(F.broadcast(bits.where(F.col(yes).isNotNull())), word == F.col(at)).where(bit.bitwiseAND(F.col(yes)) != 0)
    clear = bit.bitwiseAND(F.col(doubt)) == 0
    return found.where(clear).select(*df.columns), found.where(~clear).select(*df.columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
