"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fileprune.llm import bpe, chat, media, mixing, nearest, quality, sharding, simhash, tokens, toxicity
from fileprune.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_conversations(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"), words=3, distance=3)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokens.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokens.read_documents(shards)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op1_sharding": op1_sharding, "op2_toxicity": op2_toxicity, "op3_chat": op3_chat, "op4_simhash": op4_simhash, "op5_nearest": op5_nearest, "op6_tokens": op6_tokens, "op7_flac": op7_flac, "op8_quality": op8_quality, "op9_mixing": op9_mixing, "op10_bpe": op10_bpe}

ORACLE_SQL = {"op5_nearest": nearest.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
