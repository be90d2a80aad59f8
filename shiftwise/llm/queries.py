"""Driver queries of this subpackage: name -> (Spark builder, oracle SQL)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.llm import oracles
from shiftwise.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a driver query; without ``oracle`` a brute-force test stands for it."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", oracles.QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import quality_rules
    out = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query("op7_chat_formatting", oracles.CHAT)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import chat_format
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat_format.format_conversations(turns.unionByName(tricky))


@query("op8_rendezvous_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import sharding
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def word_bpe() -> dict:
    """The tokenizer of the queries: drops white space, never looks across it."""
    import public_tokenizers
    return {"tokenizer": public_tokenizers.path("word_bpe_49k.json"), "end": 1, "by_word": True}


@query("op2_harmonic_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import packing
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), capacity=2048, **word_bpe()))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import token_files
    return token_files.round_trip(table(spark, sf_dir, "documents"), **word_bpe())


#: The rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op4_url_trust", oracles.URLS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import url_filter
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.Rule(*r) for r in RULES])


@query("op10_stable_projections")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import neighbours
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, dim=64)


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shiftwise.llm import pieces
    cores = int(spark.conf.get("spark.task.cpus", "1"))  # the library's threads of a batch
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cores)


@query("op9_substring_dedup", oracles.SUBSTRINGS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import substring_dedup
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard_join", oracles.JACCARD)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import ngram_join
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", oracles.NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import repair
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiftwise.llm import toxicity
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
