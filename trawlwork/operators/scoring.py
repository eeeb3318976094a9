"""Scores of items against a target profile.

With an embedding function the whole pipeline is one narrow stage: n-grams come from Spark expressions,
similarities from numpy on Arrow batches, and nothing is shuffled. With a table of vectors (for costly
embeddings, see ``phrase_universe`` and ``cache_read_through``) distinct phrases are scored once and
joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.functions.text import normalize_phrase, word_ngrams
from trawlwork.functions.vectors import (
    Embedding,
    Targets,
    embed_rows,
    score_vectors,
    trigram_embedding,
    with_best_similarity,
)
from trawlwork.operators.vectors import best_by_group
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import bounded_rows, lookup_join
from trawlwork.settings import MAX_NGRAM, MAX_TARGET_PHRASES, NAME_ATTRIBUTE, NAME_WEIGHT
from trawlwork.sources.profile import Profile, collect_profile


def _floor(score: Column) -> Column:
    return F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0))


def _as_scores(best: Column, attributes: list[str]) -> Column:
    """``array<struct<attribute, score>>`` from the positional scores of a similarity column."""
    return F.array(
        *[F.struct(F.lit(a).alias("attribute"), _floor(best[i]).alias("score")) for i, a in enumerate(attributes)]
    )


def _targets_from_table(groups: dict[str, list[str]], vectors: DataFrame) -> Targets:
    """Targets whose vectors come from a table; at most as many rows as target phrases are read."""
    wanted = sorted({p for phrases in groups.values() for p in phrases})
    found = bounded_rows(
        vectors.filter(F.col("phrase").isin(wanted)).select("phrase", "embedding"), MAX_TARGET_PHRASES, "targets"
    )
    table = {row["phrase"]: row["embedding"] for row in found}
    return Targets(groups, lambda phrases: [table.get(p) for p in phrases])


def _best_from_table(
    items: DataFrame, keys: list[str], phrases: Column, groups: dict[str, list[str]], vectors: DataFrame
) -> DataFrame:
    """``(keys, best)`` from a table of vectors: each distinct phrase is scored once."""
    targets = _targets_from_table(groups, vectors)
    pieces = items.select(*keys, F.explode(F.array_distinct(phrases)).alias("phrase"))
    scored = cut(score_vectors(vectors, targets), "phrase-scores")
    joined = lookup_join(cut(pieces, "phrases"), scored, ["phrase"], "inner")
    maxima = [F.max(F.col("best")[i]).alias(f"_b{i}") for i in range(len(groups))]
    return joined.groupBy(*keys).agg(*maxima).select(
        *keys, F.array(*[F.col(f"_b{i}") for i in range(len(groups))]).alias("best")
    )


def _with_best(
    items: DataFrame,
    keys: list[str],
    phrases: Column,
    groups: dict[str, list[str]],
    embed: Embedding,
    vectors: DataFrame | None,
    name: str,
    table: DataFrame | None = None,
) -> DataFrame:
    if table is not None:
        best = _best_from_tiles(items, keys, phrases, list(groups), table, embed, vectors).withColumnRenamed("best", name)
        return items.join(best, keys, "left")
    if vectors is None:
        return with_best_similarity(items, phrases, groups, embed, name)
    best = _best_from_table(items, keys, phrases, groups, vectors).withColumnRenamed("best", name)
    return items.join(best, keys, "left")


def _best_from_tiles(
    items: DataFrame, keys: list[str], phrases: Column, groups: list[str], table: DataFrame, embed: Embedding, vectors: DataFrame | None
) -> DataFrame:
    """``(keys, best)`` for targets of any number, ``table(attribute, phrase)``: distinct phrases meet them tile by tile."""
    pieces = cut(items.select(*keys, F.explode(F.array_distinct(phrases)).alias("phrase")), "phrases")
    targets = table.filter(F.col("attribute").isin(groups))
    if vectors is None:
        known = cut(embed_rows(pieces.select("phrase").distinct(), embed), "phrase-vectors")
        aims = embed_rows(targets.select("phrase").distinct(), embed)
    else:
        known = vectors.join(pieces.select("phrase").distinct(), "phrase", "left_semi")
        aims = vectors
    aimed = targets.join(aims, "phrase").select(F.col("attribute").alias("group"), "embedding")
    scored = cut(best_by_group(known, aimed), "phrase-scores")
    joined = lookup_join(pieces, scored, ["phrase"], "inner")
    maxima = [F.max(F.col("best")[g]).alias(f"_b{i}") for i, g in enumerate(groups)]
    return joined.groupBy(*keys).agg(*maxima).select(*keys, F.array(*[F.col(f"_b{i}") for i in range(len(groups))]).alias("best"))


def attribute_similarity(
    items: DataFrame,
    profile: DataFrame | Profile,
    keys: list[str],
    embed: Embedding = trigram_embedding,
    vectors: DataFrame | None = None,
    max_n: int = MAX_NGRAM,
) -> DataFrame:
    """``items`` plus ``attribute_scores``: per attribute the best n-gram of any ingredient, at least 0.

    The name attribute is compared with the ingredients too. ``keys`` identify one item.
    """
    profile = profile if isinstance(profile, Profile) else collect_profile(profile)
    grams = word_ngrams(F.col("ingredients"), max_n)
    scored = _with_best(items, keys, grams, profile.phrases, embed, vectors, "_best", profile.table)
    return scored.withColumn("attribute_scores", _as_scores(F.col("_best"), list(profile.phrases))).drop("_best")


def name_similarity(
    items: DataFrame,
    profile: DataFrame | Profile,
    keys: list[str],
    embed: Embedding = trigram_embedding,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``items`` plus ``name_score``: best similarity of the item name to a target name, at least 0."""
    profile = profile if isinstance(profile, Profile) else collect_profile(profile)
    names = {NAME_ATTRIBUTE: profile.phrases.get(NAME_ATTRIBUTE, [])}
    phrase = F.array(normalize_phrase(F.col("item")))
    scored = _with_best(items, keys, phrase, names, embed, vectors, "_best", profile.table)
    return scored.withColumn("name_score", _floor(F.col("_best")[0])).drop("_best")


def threshold_gate(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds ``passed_scores`` (scores below the threshold become 0) and ``gated``.

    An item with ingredients and no passing attribute is gated: its combined score is 0.
    """
    passed = F.transform(
        "attribute_scores",
        lambda s: F.struct(
            s["attribute"].alias("attribute"),
            F.when(s["score"] >= threshold, s["score"]).otherwise(F.lit(0.0)).alias("score"),
        ),
    )
    return scored.withColumn("passed_scores", passed).withColumn(
        "gated", (F.size("ingredients") > 0) & ~F.exists("passed_scores", lambda s: s["score"] != 0)
    )


def weighted_attribute_score(scored: DataFrame, profile: DataFrame | Profile) -> DataFrame:
    """Adds ``attribute_score``: weighted mean of the passed scores without the name attribute.

    Gated items get 0. Where no mean exists (all weights 0, or a weight missing) other items are dropped.
    """
    profile = profile if isinstance(profile, Profile) else collect_profile(profile)
    total = profile.total_weight
    if total == 0 or not profile.complete:
        return scored.filter("gated").withColumn("attribute_score", F.lit(0.0))
    terms = [
        F.lit(float(profile.weights[a])) * F.col("passed_scores")[i]["score"]
        for i, a in enumerate(profile.phrases)
        if a != NAME_ATTRIBUTE
    ]
    mean = reduce(lambda x, y: x + y, terms, F.lit(0.0)) / F.lit(float(total))
    return scored.withColumn("attribute_score", F.when(F.col("gated"), F.lit(0.0)).otherwise(mean))


def hybrid_score(scored: DataFrame, name_weight: float = NAME_WEIGHT) -> DataFrame:
    """Adds ``combined_score``: name and attributes mixed when there are ingredients, else the name alone."""
    mixed = F.col("name_score") * name_weight + F.col("attribute_score") * (1 - name_weight)
    return scored.withColumn(
        "combined_score",
        F.when(F.col("gated"), F.lit(0.0))
        .when(F.size("ingredients") > 0, mixed)
        .otherwise(F.col("name_score")),
    )


def score_items(
    items: DataFrame,
    profile: DataFrame | Profile,
    keys: list[str],
    embed: Embedding = trigram_embedding,
    vectors: DataFrame | None = None,
    threshold: float = 0.0,
    name_weight: float = NAME_WEIGHT,
    max_n: int = MAX_NGRAM,
) -> DataFrame:
    """``items`` with every intermediate score column."""
    profile = profile if isinstance(profile, Profile) else collect_profile(profile)
    scored = attribute_similarity(items, profile, keys, embed, vectors, max_n)
    scored = name_similarity(scored, profile, keys, embed, vectors)
    scored = weighted_attribute_score(threshold_gate(scored, threshold), profile)
    return hybrid_score(scored, name_weight)


def match_items(
    items: DataFrame,
    profile: DataFrame | Profile,
    keys: list[str],
    embed: Embedding = trigram_embedding,
    vectors: DataFrame | None = None,
    threshold: float = 0.0,
    name_weight: float = NAME_WEIGHT,
) -> DataFrame:
    """``(keys, scraped_item, ingredients, combined_score, attribute_scores)``, scores as a map."""
    scored = score_items(items, profile, keys, embed, vectors, threshold, name_weight)
    return scored.select(
        *[k for k in keys if k != "item"],
        F.col("item").alias("scraped_item"),
        "ingredients",
        "combined_score",
        F.map_from_entries("attribute_scores").alias("attribute_scores"),
    )
