"""Sharding by rendezvous hashing over weighted shards, in DataFrame functions only.

Every record scores each shard by ``-weight / ln(u)`` with ``u`` in (0, 1) from
``xxhash64(key, shard)`` and goes to the highest score.  A shard then receives
records in proportion to its weight, and the choice between two shards never
depends on the others: a new shard only takes records for itself, a removed one
only gives its own away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.llm.staging import free_name, stage


def _score(key: Sequence[Column], shard: int, weight: float) -> Column:
    # 53 random bits, moved off 0 and 1
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of a record with these key columns.

    A shard of weight 0 receives nothing.  Equal scores go to the smaller shard.
    Records with a null key hash alike and meet in one shard.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    scores = [_score(key, i, w) for i, w in live]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best.getField("shard")


def number_slots(df: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard.

    The rows are written once with their place in their partition.  Blocks of
    (shard, partition) are counted, a running sum over these few counts gives
    each block its first slot, and rows are numbered within their block, so no
    task ever holds a shard.
    """
    row, part, n, first = (free_name(df, x) for x in ("row", "part", "n", "first"))
    placed = stage(df.withColumn(row, F.monotonically_increasing_id()), "slots").withColumn(part, F.shiftright(row, 33))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(shard, part).agg(F.count("*").alias(n)).select(shard, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inner = F.row_number().over(Window.partitionBy(shard, part).orderBy(row))
    return placed.withColumn(slot, inner - 1).join(firsts, [shard, part]).withColumn(slot, F.col(slot) + F.col(first)).drop(row, part, first)


def shard_documents(docs: DataFrame, n_shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Shard of every document by its ``doc_id``: digests, shard, slot and the shard if there were one more.

    ``docs`` needs ``doc_id`` and ``text`` and may have any other columns.  A
    null text has no bytes; documents with a null id share a shard; repeated
    rows share a shard and have a slot each; an empty table gives no rows.
    """
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = [F.col("doc_id")]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
    )
    return number_slots(rows, "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: Sequence[str], weights: Sequence[float], files: int = 1) -> None:
    """Write every row under ``path/shard=N``, each shard in ``files`` files dealt by the key."""
    shard, file = free_name(df, "shard"), free_name(df, "file")
    cols = [F.col(c) for c in key]
    placed = df.withColumn(shard, rendezvous(cols, weights)).withColumn(file, F.pmod(F.xxhash64(*cols, F.lit("file")), F.lit(files)))
    placed.repartition(len(weights) * files, shard, file).drop(file).write.partitionBy(shard).parquet(path)
