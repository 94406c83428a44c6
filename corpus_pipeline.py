"""A corpus made ready for training: the stages in order, each a step over the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import minhash_dedup, mixing, packing, quality_rules, suffix_tree_dedup
from emberline.llm.common import stored
from emberline.llm.queries import TOKENIZER_RANKS


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their bad lines."""
    return quality_rules.clean_documents(docs, n_chars="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.without_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier in the corpus."""
    return suffix_tree_dedup.clean_documents(docs, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of one length."""
    import public_tokenizers

    return packing.packed_documents(docs, TOKENIZER_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
