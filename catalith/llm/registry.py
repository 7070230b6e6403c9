"""The queries of this package: one opN_<name> for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, exact_dedup, fingerprints, html_text, jaccard_join, language, manifest, mixing, packing, quality, secrets, token_counts, toxicity
from .common import bound_batches, documents, labels, tokenizer_path


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes, with the defaults of the contract. Null texts count 0 words, the null source is one of its own."""
    return mixing.mix_sources(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts. Null texts are empty; repeated rows keep one of them."""
    bound_batches(spark)
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text. Null texts are empty and have no hit; without labels every score is 0."""
    bound_batches(spark)
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text. Null texts are empty and have none."""
    bound_batches(spark)
    return secrets.find_secrets(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that four-word shingles link at 0.85. Texts without words are alone."""
    bound_batches(spark)
    return jaccard_join.jaccard_join(documents(spark, sf_dir), k=4, num=85, den=100)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness. Null texts are empty."""
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text as the model counts them. Null texts are empty and have none."""
    bound_batches(spark)
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text. Null texts are scored as empty ones; without labels every score is 1."""
    bound_batches(spark)
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; und for null texts and those without a letter."""
    bound_batches(spark)
    return language.identify(documents(spark, sf_dir))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens. A null or empty text is its end id alone."""
    bound_batches(spark)
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still proves after tampering. Null columns count as a dash."""
    bound_batches(spark)
    return manifest.manifest(documents(spark, sf_dir))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage. Nulls are one space; without rows left nothing is edited."""
    bound_batches(spark)
    return conversations.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null html is empty and has none."""
    bound_batches(spark)
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_exact_dedup, op3_toxicity, op4_find_secrets, op5_jaccard_join, op6_fingerprints, op7_count_tokens, op8_quality, op9_language, op10_pack, op11_merkle_manifest, op12_repair_conversations, op13_extract_html)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE_SQL, "op2_exact_dedup": exact_dedup.ORACLE_SQL, "op11_merkle_manifest": manifest.ORACLE_SQL, "op12_repair_conversations": conversations.ORACLE_SQL}
