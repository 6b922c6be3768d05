"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoutframe.llm.best_fit import pack_documents
from scoutframe.llm.durable import durable
from scoutframe.llm.quality_divergence import keep_quality
from scoutframe.llm.queries import vocabulary
from scoutframe.llm.register_dedup import without_near_duplicates
from scoutframe.llm.source_mix import mixed_documents
from scoutframe.llm.suffix_repeats import Repeats, without_repeats

PASSAGE_BYTES = 250


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 7)."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles and a similarity of 0.8, one document (operator 1)."""
    return without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of about 50 words that occur more than once (operator 10); emptied documents go.

    A passage counts from 250 bytes: 50 words and the spaces between them, at four letters a word.
    """
    return without_repeats(docs, plan=Repeats(length=PASSAGE_BYTES))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them (operator 5)."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens (operator 4)."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", packing),
]

#: SQL cannot say what the stages do; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
