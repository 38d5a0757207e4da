"""From raw documents to token ids: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrafold.llm import bpe, common, jaccard, mixing, quality, secret_scan
from spectrafold.llm.queries import TOKENIZER, table


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    common.let_go(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard similarity 0.8 or more."""
    common.let_go(spark)
    return jaccard.keep_one(docs, size=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by a mark; documents stay."""
    common.let_go(spark)
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it."""
    common.let_go(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    common.let_go(spark)
    return bpe.encoded(docs, TOKENIZER, keep=("lang", "source"), with_ids=True)


STAGES = [
    ("quality classifier", keep_good_text),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A language model can't be expressed in SQL. The operators are tested against plain versions, the stages not yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        first = len(common.TABLES)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage{i}")
            common.drop_since(spark, max(0, first - (i > 0)), keep=1)  # what the stage made, and what it read
    return docs
