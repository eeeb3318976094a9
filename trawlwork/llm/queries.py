"""The registered queries of the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlwork.llm import oracles
from trawlwork.llm.common import read_table
from trawlwork.llm.conversations import damaged, repair_conversations
from trawlwork.llm.decontamination import contaminated_pairs
from trawlwork.llm.lm_scoring import score_against_labels
from trawlwork.llm.main_text import main_texts
from trawlwork.llm.minhash import near_duplicates
from trawlwork.llm.mixing import mix_documents
from trawlwork.llm.quality import quality_scores
from trawlwork.llm.repeats import remove_repeats
from trawlwork.llm.sharding import shard_manifest
from trawlwork.llm.token_counts import token_counts
from trawlwork.llm.toxicity import toxicity_scores
from trawlwork.llm.vector_dedup import near_duplicate_vectors
from trawlwork.llm.whitening import whiten

#: Bounds of the registered queries that are not defaults of their operators.
SHARDS = 16
NEAR_WORDS = 2
TOKENIZER = "word_bpe_49k.json"


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(read_table(spark, sf_dir, "documents"), SHARDS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_against_labels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), NEAR_WORDS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents")).drop("mark", "copy")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(read_table(spark, sf_dir, "conversations")))


def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def all_oracles() -> dict[str, str]:
    return oracles.SQL
