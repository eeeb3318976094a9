"""The target profile: attributes, their phrases and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlwork.functions.text import normalize_phrase
from trawlwork.plans.skew import bounded_rows
from trawlwork.settings import MAX_TARGET_PHRASES, NAME_ATTRIBUTE

SCHEMA = "attribute string, phrase string, weight double, scored boolean"


def load_profile(
    spark: SparkSession, attributes: dict[str, list[str]], weights: dict[str, float] | None = None
) -> DataFrame:
    """``(attribute, phrase, weight, scored)``, one row per phrase.

    Without ``weights`` every attribute but the name weighs 1. An attribute without phrases keeps one row
    with a null phrase. A weight for an attribute outside the profile is kept with ``scored = false``.
    """
    if weights is None:
        weights = {a: 1.0 for a in attributes if a != NAME_ATTRIBUTE}
    rows = [(a, list(p), weights.get(a), True) for a, p in attributes.items()]
    rows += [(a, [], w, False) for a, w in weights.items() if a not in attributes]
    raw = spark.createDataFrame(
        [(a, p, None if w is None else float(w), s) for a, p, w, s in rows],
        "attribute string, phrases array<string>, weight double, scored boolean",
    )
    rows = raw.select("attribute", F.explode_outer("phrases").alias("phrase"), "weight", "scored")
    return rows.withColumn("phrase", normalize_phrase(F.col("phrase")))


@dataclass(frozen=True)
class Profile:
    """Attributes with weights, and their phrases: few enough to travel with every task, or as a table."""

    phrases: dict[str, list[str]]
    weights: dict[str, float | None]
    #: ``(attribute, phrase)`` of a profile with too many phrases to carry; ``phrases`` then holds the attributes only.
    table: DataFrame | None = None

    @property
    def total_weight(self) -> float:
        return sum(w for w in self.weights.values() if w is not None)

    @property
    def complete(self) -> bool:
        """False when a scored attribute other than the name lacks a weight."""
        return all(self.weights.get(a) is not None for a in self.phrases if a != NAME_ATTRIBUTE)


def collect_profile(profile: DataFrame, limit: int = MAX_TARGET_PHRASES) -> Profile:
    """A profile of up to ``limit`` phrases as it is; a larger one keeps its phrases in a table, and its attributes, which become
    columns of scores, are ``limit`` at most."""
    phrases: dict[str, list[str]] = {}
    weights: dict[str, float | None] = {}
    rows = profile.limit(limit + 1).collect()
    if len(rows) > limit:
        named = profile.groupBy("attribute").agg(F.first("weight").alias("weight"), F.max("scored").alias("scored"))
        for row in sorted(bounded_rows(named, limit, "list of attributes"), key=lambda r: r["attribute"]):
            weights[row["attribute"]] = row["weight"]
            if row["scored"]:
                phrases[row["attribute"]] = []
        return Profile(phrases, weights, profile.filter("scored and phrase <> ''").select("attribute", "phrase").distinct())
    for row in rows:
        weights[row["attribute"]] = row["weight"]
        if row["scored"]:
            known = phrases.setdefault(row["attribute"], [])
            if row["phrase"]:
                known.append(row["phrase"])
    return Profile(phrases, weights)
