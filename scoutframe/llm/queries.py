"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import kdtree_topk, prefix_trie, sharded_lloyd, source_mix
from .backoff_scores import backoff_scores
from .best_fit import pack_documents
from .chat_grammar import format_turns, read_conversations
from .factor_toxicity import fit, score_toxicity
from .projection_forest import nearest_neighbours
from .quality_divergence import judge_quality
from .register_dedup import near_duplicates
from .suffix_repeats import repeat_report
from .token_resync import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(fn):
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)  # Python workers need the operators' modules
            return fn(spark, folder)

        QUERIES[name] = shipped
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_register_near_duplicates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents: two-word shingles, Jaccard similarity of 0.8."""
    return near_duplicates(_table(spark, folder, "documents"))


@_query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and byte-level tokens of every document."""
    return count_tokens(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@_query("op3_backoff_scores")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document by all other documents."""
    return backoff_scores(_table(spark, folder, "documents"))


@_query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return pack_documents(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@_query("op5_source_mix", source_mix.ORACLE)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document; the target is rounded so that engines agree."""
    mixed = source_mix.mix_sources(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@_query("op6_factor_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a machine learned from the labels outside the held-out fold."""
    docs = _table(spark, folder, "documents")
    return score_toxicity(docs, fit(docs, _table(spark, folder, "labels")))


@_query("op7_quality_divergence")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the two distances and the verdict."""
    return judge_quality(_table(spark, folder, "documents"))


@_query("op8_chat_grammar")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that speaks the template's own control strings, formatted and read back."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    return read_conversations(format_turns(rows.unionByName(probe))).withColumnRenamed("conv", "conv_id")


@_query("op9_kdtree_topk", kdtree_topk.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return kdtree_topk.top_inner_products(_table(spark, folder, "embeddings"), "key % 50 = 0")


@_query("op10_repeated_passages")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that belong to strings of 400 bytes found more than once."""
    return repeat_report(_table(spark, folder, "documents"))


@_query("op11_sharded_lloyd", sharded_lloyd.oracle())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds, distances and inertia in whole numbers."""
    return sharded_lloyd.cluster_vectors(_table(spark, folder, "embeddings"))


@_query("op12_projection_forest")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector."""
    return nearest_neighbours(_table(spark, folder, "embeddings"), "key % 20 = 0")


@_query("op13_prefix_trie", prefix_trie.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All prefixes of the rebuilt conversations with their members, subtrees and what sharing them saves."""
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations"))
