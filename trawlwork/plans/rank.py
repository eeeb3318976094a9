"""The whole run: places, sites, crawl, items, roll-up, scores, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.functions.text import clean_response
from trawlwork.functions.urls import crawl_key_url
from trawlwork.functions.vectors import Embedding, trigram_embedding
from trawlwork.operators.content import extract_links, parse_items, pick_response
from trawlwork.operators.graph import (
    canonical_links,
    crawl_bfs,
    crawl_bfs_relevant,
    dedupe_visited_nodes,
    link_table,
    reachable_nodes,
    subtree_rollup,
)
from trawlwork.operators.relevance import url_relevance
from trawlwork.operators.scoring import match_items
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import lookup_join
from trawlwork.settings import DEPTH_LIMIT, SIMILARITY_THRESHOLD, TARGET_URL_KEYWORDS
from trawlwork.sources.tables import result_columns


def build_trees(
    sites: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    depth_limit: int = DEPTH_LIMIT,
    relevance_threshold: float | None = SIMILARITY_THRESHOLD,
    keywords: list[str] = TARGET_URL_KEYWORDS,
    embed: Embedding = trigram_embedding,
) -> DataFrame:
    """Crawled nodes ``(root, url, parent_url, depth, position, path, has_content, scraped_items)``.

    ``sites(establishment_url)``, ``pages(url, html)``, ``responses(url, n, text)``. Each page is parsed
    once, into links that are written down; the crawl reads those and never the pages. Without a
    ``relevance_threshold`` all links are followed. A page without any response has failed: its ``has_content`` is
    false, as for a page that is not stored, and the roll-up leaves out all below it.
    """
    roots = sites.select(crawl_key_url(F.col("establishment_url")).alias("root")).distinct()
    links = cut(canonical_links(extract_links(pages)), "page-links")
    if relevance_threshold is None:
        crawled = crawl_bfs(roots, cut(link_table(links), "links"), depth_limit)
    else:
        scored = url_relevance(links.select(F.col("link").alias("url")), keywords, embed)
        relevant = scored.filter(F.col("score") > relevance_threshold)
        crawled = crawl_bfs_relevant(roots, links, relevant, depth_limit)
    # One row per page key with all that the nodes need of it; a book comes out of one response, in its row.
    stored = pages.select(crawl_key_url(F.col("url")).alias("url")).distinct()
    answers = pick_response(responses.withColumn("url", crawl_key_url(F.col("url"))), "url")
    books = answers.select("url", F.map_from_entries(parse_items(clean_response(F.col("response")))).alias("scraped_items"))
    known = cut(stored.join(books, "url").withColumn("has_content", F.lit(True)), "known-pages")
    empty = F.create_map().cast("map<string,array<string>>")
    return (
        lookup_join(cut(dedupe_visited_nodes(crawled), "crawled"), known, ["url"])
        .withColumn("has_content", F.coalesce("has_content", F.lit(False)))
        .withColumn("scraped_items", F.coalesce("scraped_items", empty))
    )


def rank_establishments(
    sites: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    profile: DataFrame,
    depth_limit: int = DEPTH_LIMIT,
    relevance_threshold: float | None = SIMILARITY_THRESHOLD,
    keywords: list[str] = TARGET_URL_KEYWORDS,
    embed: Embedding = trigram_embedding,
) -> DataFrame:
    """Unsorted result rows of ``sites(google_url, establishment_url)``; write them ranked with
    ``write_ranked_results``. Sites whose book is empty add no rows."""
    nodes = build_trees(sites, pages, responses, depth_limit, relevance_threshold, keywords, embed)
    books = subtree_rollup(reachable_nodes(cut(nodes, "nodes"))).select("root", "item", "ingredients")
    # A book is scored once, however many places share the site.
    scored = match_items(books, profile, ["root", "item"], embed)
    placed = sites.withColumn("root", crawl_key_url(F.col("establishment_url")))
    return result_columns(scored.join(placed, "root"))
