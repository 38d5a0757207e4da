"""The queries of the operators in this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, jaccard, mixing, negatives, oracles, pii, quality, secret_scan, sharding, suffix_dedup, token_store
from .common import read_table

#: The tokenizer's file is a parameter of the operators; the queries use the installed public one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).drop("class_id")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label is moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    return negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix": op1_mix, "op2_repeats": op2_repeats, "op3_bpe": op3_bpe, "op4_quality": op4_quality, "op5_neighbours": op5_neighbours, "op6_pii": op6_pii, "op7_secrets": op7_secrets, "op8_jaccard": op8_jaccard, "op9_embeddings": op9_embeddings, "op10_tokens": op10_tokens, "op11_shards": op11_shards, "op12_negatives": op12_negatives}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express. Tokenizers, trained models, whole-corpus byte strings, seeded shuffles and searches that may miss a neighbour are tested against plain versions instead."""
    return {"op1_mix": oracles.mix(), "op7_secrets": oracles.secrets(), "op8_jaccard": oracles.jaccard(), "op9_embeddings": oracles.near_vectors(), "op12_negatives": oracles.hard_negatives()}
