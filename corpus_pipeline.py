"""A corpus pipeline over the operators of catalith.llm: each stage works on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, in their order, whatever extra columns there are.

Defined cases, in every stage: null text is empty text; a null doc_id, lang or source is a value like any other (a null
doc_id is the smallest in exact dedup and the last choice in near dedup); of rows that repeat an id and a text the two
dedup stages keep one, the others keep each; equal candidates are told apart by id, then by the text's hash, so reruns
agree; an empty table gives an empty table of the same columns; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalith.llm import exact_dedup, jaccard_join, mixing, packing, quality
from catalith.llm.common import bound_batches, discard, documents, labels, materialize, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without trusted labels nothing is rejected. Empty texts are scored too."""
    bound_batches(spark)
    return quality.keep_good(docs, labels(spark, sf_dir))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays; empty and null texts are equal."""
    bound_batches(spark)
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of similarity 0.8 over five-word shingles connect, the least doc_id stays.

    Texts without words link with nothing and stay.
    """
    bound_batches(spark)
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; a source of empty texts has a target of 0 and goes."""
    return mixing.repeat_rows(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training windows; an empty text is one piece, its end id."""
    bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", windows),
]

#: The classifier, the tokenizer and the window packing are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
