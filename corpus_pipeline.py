"""Corpus pipeline: stages that turn documents into training text, each on what its predecessor kept.

The classifier drops documents it grades poor or toxic; exact copies go, then near copies (five-word shingles, similarity 0.8); sources are mixed to
their weights, so that documents repeat, are cut or fall away as their source's budget asks; the last stage encodes the texts.

Behaviour at the edges, in every stage: null text counts as empty; of rows without identifier equal texts are copies, too; rows that share an
identifier go each by its own text; texts of any length pass whole; ties go to the smallest identifier; an empty table gives an empty table; further columns
of documents are passed on, and one named as a result of the last stage (ids, n_tokens, round_trip) is an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseworks.llm import bpe, exact_dedup, mixing, near_dedup, quality
from caseworks.llm.workspace import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table of labels, takes for good and clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, quality.train(docs, quality.graded(labels)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.without_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.without_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the one where a source's budget ends is cut."""
    return mixing.repeated(docs, settle(mixing.placed_rows(docs), "mixed"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with ids, their number and whether they decode to the text, in place of the text."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mix sources", mix_stage), ("byte-level BPE", bpe_stage)]
#: Not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, "stage")
    return docs
