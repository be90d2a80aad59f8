"""Many keys found in many texts: one pass over each text (J11, P20 for large lists).

Keys are dealt into shards of bounded size and texts into slices of bounded
size.  A task builds the Aho-Corasick automaton of a shard and reads the texts
of a slice through it, so the cost is linear in the texts and the matches, whatever the
number of keys; a text moves once for each shard, and there is one shard
for every mebi character of keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of keys in a shard, and of texts in a slice.
SHARD_CHARS, SLICE_CHARS = 1 << 20, 1 << 25


def _upto(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _parts(df: DataFrame, text: str, limit: int) -> int:
    return int((df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0) // limit) + 1


def _search(kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(keys: pa.Table, texts: pa.Table) -> pa.Table:
        import ahocorasick

        ids, found = [], []
        if keys.num_rows and texts.num_rows:
            automaton = ahocorasick.Automaton()
            for key, pos in zip(keys["_kl"].to_pylist(), keys["_pos"].to_pylist(), strict=True):
                automaton.add_word(key, pos)
            automaton.make_automaton()
            for i in range(texts.num_rows):
                first = min((pos for _, pos in automaton.iter(texts["_tl"][i].as_py())), default=None)
                if first is not None:
                    ids.append(texts["_id"][i].as_py())
                    found.append(first)
        return pa.table({"_id": pa.array(ids, kind), "_pos": pa.array(found, pa.int64())})
    return run


def first_key_in(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(_id, _pos): of the keys that a text holds the least position.

    ``texts`` (_id, _tl), ``keys`` (_kl, _pos bigint), both as they are to be
    compared.  Null texts and keys match nothing, an empty key everything.  Of
    equal keys the first counts; a text without any key gives no row.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    texts = texts.where(F.col("_tl").isNotNull()).select("_id", "_tl")
    each = keys.where(F.col("_kl").isNotNull()).groupBy("_kl").agg(F.min(F.col("_pos").cast("long")).alias("_pos"))
    real, empty = each.where("_kl <> ''"), each.where("_kl = ''").agg(F.min("_pos").alias("_always"))
    shards, slices = _parts(real, "_kl", SHARD_CHARS), _parts(texts, "_tl", SLICE_CHARS) * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = real.withColumn("_shard", F.pmod(F.xxhash64("_kl"), F.lit(shards))).withColumn("_slice", _upto(slices))
    t = texts.withColumn("_slice", F.pmod(F.xxhash64("_id"), F.lit(slices))).withColumn("_shard", _upto(shards))
    kind = texts.schema["_id"].dataType
    found = k.groupBy("_shard", "_slice").cogroup(t.groupBy("_shard", "_slice")).applyInArrow(_search(to_arrow_type(kind)), f"_id {kind.simpleString()}, _pos bigint")
    always = texts.select("_id").join(F.broadcast(empty), F.col("_always").isNotNull()).select("_id", F.col("_always").alias("_pos"))  # one row
    return found.unionByName(always).groupBy("_id").agg(F.min("_pos").alias("_pos"))
