"""Relevance of URLs to a keyword list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.functions.urls import canonical_url, url_segments
from trawlwork.functions.vectors import Embedding, trigram_embedding, with_best_similarity
from trawlwork.operators.cache import cache_read_through
from trawlwork.operators.scoring import _best_from_table, _best_from_tiles
from trawlwork.settings import MAX_TARGET_PHRASES, SIMILARITY_THRESHOLD, TARGET_URL_KEYWORDS


def segment_vocabulary(urls: DataFrame, keywords: list[str] = TARGET_URL_KEYWORDS) -> DataFrame:
    """Distinct ``segment`` of all URLs and the keywords; a keyword is kept whole."""
    found = urls.select(F.explode(url_segments(F.col("url"))).alias("segment"))
    given = urls.sparkSession.createDataFrame([(k,) for k in keywords], "segment string")
    return found.unionByName(given).distinct()


def url_relevance(
    urls: DataFrame,
    keywords: list[str] = TARGET_URL_KEYWORDS,
    embed: Embedding = trigram_embedding,
    vectors: DataFrame | None = None,
    limit: int = MAX_TARGET_PHRASES,
) -> DataFrame:
    """``(url, score)`` for every distinct URL: best similarity of a segment to a keyword, 0 without any.

    With an embedding function the segments are scored where the URL is, without a join. With a table of
    vectors, or more than ``limit`` keywords, each distinct segment is scored once.
    """
    distinct = urls.select("url").distinct()
    groups = {"keyword": list(keywords)}
    segments = url_segments(F.col("url"))
    if len(keywords) > limit:
        table = urls.sparkSession.createDataFrame([("keyword", k) for k in keywords], "attribute string, phrase string").distinct()
        scored = distinct.join(_best_from_tiles(distinct, ["url"], segments, ["keyword"], table, embed, vectors), "url", "left")
    elif vectors is None:
        scored = with_best_similarity(distinct, segments, groups, embed, "best")
    else:
        scored = distinct.join(_best_from_table(distinct, ["url"], segments, groups, vectors), "url", "left")
    return scored.select("url", F.coalesce(F.col("best")[0], F.lit(0.0)).alias("score"))


def filter_relevant_urls(
    urls: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    keywords: list[str] = TARGET_URL_KEYWORDS,
    embed: Embedding = trigram_embedding,
    vectors: DataFrame | None = None,
    cache: DataFrame | None = None,
) -> DataFrame:
    """``(url, score)`` of the distinct canonical URLs scoring strictly above the threshold.

    ``cache(key_hash, value)`` holds earlier scores; only URLs without one are scored.
    """
    # The explode drops URLs without a host; a filter would compute the canonical form a second time.
    found = F.array_compact(F.array(canonical_url(F.col("url"))))
    wanted = urls.select(F.explode(found).alias("url")).distinct()

    def compute(missing: DataFrame) -> DataFrame:
        fresh = url_relevance(missing.select(F.col("key").alias("url")), keywords, embed, vectors)
        return fresh.select(F.col("url").alias("key"), F.col("score").alias("value"))

    if cache is None:
        scored = url_relevance(wanted, keywords, embed, vectors)
    else:
        known, fresh = cache_read_through(wanted.select(F.col("url").alias("key")), cache, compute)
        scored = known.unionByName(fresh).select(F.col("key").alias("url"), F.col("value").alias("score"))
    return scored.filter(F.col("score") > threshold)
