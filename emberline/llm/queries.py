"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    chat_format,
    compression_classifier,
    conversation_repair,
    cross_polytope,
    filter_audit,
    lpf_dedup,
    minhash_dedup,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    suffix_tree_dedup,
    url_filters,
)
from emberline.llm.common import table

# Fixed values of the url query: the rules, and hosts blocked where no rule fits.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills") for top in ("com", "net", "org")]

# The vocabulary of byte_bpe_50k.json as ranks: same ids.
TOKENIZER_RANKS = "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, line rules and verdict of every document."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same one with a stale last turn."""
    chosen = table(spark, sf_dir, "conversations")
    pairs = chat_format.preference_pairs(chosen, chat_format.stale_replies(chosen), pair="conv_id")
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "prefix_turns",
        "prompt",
        chat_format.text_of(F.col("chosen")).alias("chosen"),
        chat_format.text_of(F.col("rejected")).alias("rejected"),
        chat_format.loss_chars(F.col("chosen")).alias("chosen_loss_chars"),
        chat_format.loss_chars(F.col("rejected")).alias("rejected_loss_chars"),
    )


def op3_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that start elsewhere too."""
    return lpf_dedup.repeated_strings(table(spark, sf_dir, "documents"), keep="none")


def op4_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    taught = labels.where(~compression_classifier.held_out(F.col("doc_id")))
    model = compression_classifier.fit(docs, taught, label="quality")
    scored = compression_classifier.score(docs, model)
    return scored.select("doc_id", compression_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    entries = URL_RULES + [("listed", host, "") for host in LISTED_HOSTS]
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.build_index(spark, entries))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for the target mix of sources."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that start elsewhere too."""
    return suffix_tree_dedup.repeated_passages(table(spark, sf_dir, "documents"), keep="none")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    import public_tokenizers

    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER_RANKS, public_tokenizers.PATTERN)


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every twentieth vector among all others."""
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = {kind})) AS bigint)").alias(f"n_{rule.kind}")
        for kind, rule in enumerate(secret_scan.BASE_RULES)
    ]
    digest = F.sha2(secret_scan.spans_text(base), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in every order."""
    return filter_audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults planted in every conversation and their cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversations, conversation_repair.damaged(conversations))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_lpf_dedup": op3_lpf_dedup,
    "op4_compression_classifier": op4_compression_classifier,
    "op5_url_filters": op5_url_filters,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_mixing": op7_mixing,
    "op8_suffix_tree_dedup": op8_suffix_tree_dedup,
    "op9_packing": op9_packing,
    "op10_cross_polytope": op10_cross_polytope,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
