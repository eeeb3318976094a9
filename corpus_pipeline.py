"""The corpus pipeline: toxic documents out, near duplicates out, test items out, sources mixed, shards dealt.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of the stage before; all but the last return the columns
of ``documents``, whatever further columns there are and however they are named. Texts of any length are taken whole, rows in any
order, repeated rows each for itself, and an empty table gives an empty one; what else a stage does with nulls and ties it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawlwork.llm.common import read_table
from trawlwork.llm.decontamination import clean_documents
from trawlwork.llm.minhash import drop_near_duplicates
from trawlwork.llm.mixing import mixed_documents
from trawlwork.llm.sharding import with_shard
from trawlwork.llm.toxicity import drop_toxic
from trawlwork.plans.lineage import cut

#: Shards of the finished corpus.
SHARDS = 16


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go; learned from the labelled documents of the training fold.

    Null and empty texts score as the bias of the model, rows without an id like all others; without labels of both classes one
    score holds for all.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id: five-word shingles, similarity 0.8 or more.

    Texts that are null or without words are nobody's duplicates; rows without an id stay, and rows that share a kept id.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a test item's five-word shingles go, or all words of a shorter one in a row.

    Null and blank items and texts hit nothing; rows without an id stay.
    """
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes its words, a null source being one of its own.

    Rows without words stay as they are; ties are settled by a hash of id and text, so that reruns agree.
    """
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard that their id belongs to, a null id counting as 0; a column ``shard`` is replaced."""
    return with_shard(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The stages learn, draw and follow links, which SQL can't express; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
