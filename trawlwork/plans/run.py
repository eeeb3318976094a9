"""The whole run over a stored crawl: places, sites, robots, redirects, crawl, items, scores, forest; caches serve the next run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.functions.text import clean_response
from trawlwork.functions.urls import content_route, crawl_key_url
from trawlwork.functions.vectors import Embedding, trigram_embedding
from trawlwork.operators.cache import KeyedTable
from trawlwork.operators.content import extract_links, items_with_fallback, parse_items, pick_response, robots_filter
from trawlwork.operators.graph import canonical_links, crawl_bfs, crawl_bfs_relevant, dedupe_visited_nodes, link_table, reachable_nodes, subtree_rollup
from trawlwork.operators.places import place_sites
from trawlwork.operators.relevance import url_relevance
from trawlwork.operators.scoring import match_items
from trawlwork.operators.vectors import embed_phrases, phrase_universe
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import lookup_join
from trawlwork.settings import DEPTH_LIMIT, SIMILARITY_THRESHOLD, TARGET_URL_KEYWORDS
from trawlwork.sources.tables import result_columns
from trawlwork.sources.trees import BOOK, NODE_COLUMNS, merge_site_trees

ITEMS = "array<struct<item:string,ingredients:array<string>>>"


@dataclass(frozen=True)
class StoredCrawl:
    """What live fetching would have brought: ``places(place_id)``, ``details(place_id, google_url)``, ``listings(google_url, html)``,
    ``pages(url, html)``, ``responses(url, content_type, n, text)``, ``pdf_pages(url, page_no, text)``, ``redirects(url, final_url)``
    and robots ``rules(domain, agent, rule_no, allow, prefix)``."""

    places: DataFrame
    details: DataFrame
    listings: DataFrame
    pages: DataFrame
    responses: DataFrame
    pdf_pages: DataFrame | None = None
    redirects: DataFrame | None = None
    rules: DataFrame | None = None


@dataclass(frozen=True)
class RunCaches:
    """Keyed tables that outlive a run: phrase vectors (``array<float>``), URL scores (``double``), page items (:data:`ITEMS`)."""

    vectors: KeyedTable | None = None
    relevance: KeyedTable | None = None
    items: KeyedTable | None = None


@dataclass(frozen=True)
class Run:
    """``results``: unsorted rows for ``write_ranked_results``. ``forest``: the nodes of all trees, those of the old forest merged.
    ``nodes``: what the crawl met, one row per tree and request. ``dropped``: places without details or site."""

    results: DataFrame
    forest: DataFrame
    nodes: DataFrame
    dropped: DataFrame


def stored_content(pages: DataFrame, pdf_pages: DataFrame | None = None) -> DataFrame:
    """``(url, has_html, has_pdf)`` per page key that has either."""
    html = pages.select(crawl_key_url(F.col("url")).alias("url"), (F.coalesce("html", F.lit("")) != "").alias("has_html"), F.lit(False).alias("has_pdf"))
    if pdf_pages is not None:
        some = (F.coalesce("text", F.lit("")) != "").alias("has_pdf")
        html = html.unionByName(pdf_pages.select(crawl_key_url(F.col("url")).alias("url"), F.lit(False).alias("has_html"), some))
    known = html.groupBy("url").agg(F.max("has_html").alias("has_html"), F.max("has_pdf").alias("has_pdf"))
    return known.filter("url is not null and (has_html or has_pdf)")


def request_targets(content: DataFrame, redirects: DataFrame | None, rules: DataFrame | None, agent: str) -> DataFrame:
    """``(url, final_url, has_html, has_pdf, expands)``: what a request for a page key brings; a key without a row brings nothing.

    A known redirect to a page with content is taken, without asking for permission again, as for any page already fetched;
    it is followed once. Else the page itself is fetched if the robots rules allow it. Of several redirects of one key the
    least final address counts. A page leads on if it has html and is no PDF.
    """
    direct = content
    if rules is not None:
        direct = robots_filter(content, rules, agent).filter("allowed").drop("allowed")
    direct = direct.withColumn("final_url", F.col("url"))
    if redirects is not None:
        mapped = redirects.select(crawl_key_url(F.col("url")).alias("url"), crawl_key_url(F.col("final_url")).alias("final_url"))
        mapped = cut(mapped.groupBy("url").agg(F.min("final_url").alias("final_url")), "redirects")
        hits = cut(lookup_join(mapped, content.withColumnRenamed("url", "final_url"), ["final_url"], "inner"), "redirect-hits")
        direct = direct.join(hits.select("url"), "url", "left_anti").unionByName(hits)
    expands = F.col("has_html") & (content_route(F.col("final_url")) == "html")
    return direct.select("url", "final_url", "has_html", "has_pdf", expands.alias("expands"))


def page_items(content: DataFrame, responses: DataFrame) -> DataFrame:
    """``(url, items)`` of the pages whose extraction was answered: by the html, or the PDF where the html gave nothing.

    ``content(url, has_html, has_pdf)``. An html page is answered by any response, a PDF by one of its own; a page that is not
    has failed and is absent.
    """
    keyed = responses.withColumn("url", crawl_key_url(F.col("url")))

    def items(kind: str, held: str) -> DataFrame:
        answers = pick_response(keyed.filter(F.col("content_type") == kind), "url")
        parsed = answers.select("url", parse_items(clean_response(F.col("response"))).alias("items"))
        return cut(parsed.join(content.filter(held).select("url"), "url", "left_semi"), f"{kind}-items")

    html, pdf = items("html", "has_html"), items("pdf", "has_pdf")
    answered = html.filter(content_route(F.col("url")) == "html").select("url").unionByName(pdf.select("url")).distinct()
    return items_with_fallback(content.join(answered, "url", "left_semi"), html, pdf)


def crawl_sites(
    roots: DataFrame, crawl: StoredCrawl, targets: DataFrame, caches: RunCaches, depth_limit: int, relevance_threshold: float | None, keywords: list[str], embed: Embedding
) -> DataFrame:
    """``(root, url, final_url, parent_url, depth, position, path)`` of all trees; URL scores come through the cache."""
    links = cut(canonical_links(extract_links(crawl.pages.filter("html is not null"))), "page-links")
    if relevance_threshold is None:
        return crawl_bfs(roots, cut(link_table(links), "links"), depth_limit, targets=targets)
    urls = links.select(F.col("link").alias("key"))
    if caches.relevance is None:
        scored = url_relevance(links.select(F.col("link").alias("url")), keywords, embed)
    else:
        def score(missing: DataFrame) -> DataFrame:
            return url_relevance(missing.select(F.col("key").alias("url")), keywords, embed).select(F.col("url").alias("key"), F.col("score").alias("value"))

        scored = caches.relevance.read_through(urls, score).select(F.col("key").alias("url"), F.col("value").alias("score"))
    return crawl_bfs_relevant(roots, links, scored.filter(F.col("score") > relevance_threshold), depth_limit, targets=targets)


def run_establishments(
    crawl: StoredCrawl,
    profile: DataFrame,
    caches: RunCaches | None = None,
    old_forest: DataFrame | None = None,
    depth_limit: int = DEPTH_LIMIT,
    relevance_threshold: float | None = SIMILARITY_THRESHOLD,
    keywords: list[str] = TARGET_URL_KEYWORDS,
    embed: Embedding = trigram_embedding,
    agent: str = "*",
) -> Run:
    """All that a run does, from places to the ranked rows and the forest to store.

    A place found twice has its rows twice and its tree once. A tree's node is a request; it stands under the address it ended
    at. A page that brought nothing, or whose extraction failed, is a leaf without items and cuts off what lies below it; of
    several nodes of a tree that end at one page, the first one that is reached has the page's items. With caches, page items, URL
    scores and phrase vectors are computed for new keys only and stored for the next run.
    """
    caches = caches or RunCaches()
    found, dropped = place_sites(crawl.places, crawl.details, crawl.listings)
    found = cut(found.withColumn("root", crawl_key_url(F.col("establishment_url"))), "place-sites")
    content = cut(stored_content(crawl.pages, crawl.pdf_pages), "content")
    targets = cut(request_targets(content, crawl.redirects, crawl.rules, agent), "targets")
    roots = found.select("root").distinct()
    crawled = cut(crawl_sites(roots, crawl, targets.select("url", "final_url", "expands"), caches, depth_limit, relevance_threshold, keywords, embed), "crawled")
    # Items of the pages that a request ends at; a page without a row has failed.
    ends = targets.select(F.col("final_url").alias("url"), "has_html", "has_pdf").distinct()
    if caches.items is None:
        items = page_items(ends, crawl.responses)
    else:
        def extract(missing: DataFrame) -> DataFrame:
            asked = ends.join(missing.select(F.col("key").alias("url")), "url", "left_semi")
            return page_items(asked, crawl.responses).select(F.col("url").alias("key"), F.col("items").alias("value"))

        items = caches.items.read_through(ends.select(F.col("url").alias("key")), extract).select(F.col("key").alias("url"), F.col("value").alias("items"))
    brought = targets.select("url", F.lit(True).alias("fetched"))
    fetched = cut(lookup_join(crawled, brought, ["url"]), "fetched-nodes")
    books = items.select(F.col("url").alias("final_url"), F.map_from_entries("items").alias("scraped_items"))
    joined = lookup_join(fetched, cut(books, "page-items"), ["final_url"])
    fetched_too = F.coalesce("fetched", F.lit(False))
    nodes = cut(joined.withColumn("has_content", fetched_too & F.col("scraped_items").isNotNull()).withColumn("fetched", fetched_too), "nodes")
    read = cut(dedupe_visited_nodes(reachable_nodes(nodes), url="final_url"), "read-nodes")
    rollup = cut(subtree_rollup(read, every_node=True), "books")
    whole = rollup.filter(F.size("node_path") == 0).select("root", "item", "ingredients")
    vectors = None
    if caches.vectors is not None:
        phrases = phrase_universe(whole).unionByName(profile.select("phrase").filter("phrase is not null")).distinct()

        def embedded(missing: DataFrame) -> DataFrame:
            return embed_phrases(missing.select(F.col("key").alias("phrase")), embed).select(F.col("phrase").alias("key"), F.col("embedding").alias("value"))

        vectors = caches.vectors.read_through(phrases.select(F.col("phrase").alias("key")), embedded)
        vectors = cut(vectors.select(F.col("key").alias("phrase"), F.col("value").alias("embedding")), "vectors")
    scored = match_items(whole, profile, ["root", "item"], embed, vectors)
    results = result_columns(scored.join(found.select("root", "google_url", "establishment_url"), "root"))
    forest = forest_rows(nodes, read, rollup, found)
    return Run(results, forest if old_forest is None else merge_site_trees(old_forest, forest), nodes, dropped)


def forest_rows(nodes: DataFrame, read: DataFrame, rollup: DataFrame, found: DataFrame) -> DataFrame:
    """The trees as stored: every node of every place's tree, with its own items and the book of all below it.

    A node's book is one value there, as the format has it.
    """
    empty = F.create_map().cast(BOOK)
    menus = rollup.groupBy("root", F.col("node_path").alias("path")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", "ingredients")))).alias("menu_book"))
    own = read.select("root", "path", F.col("scraped_items").alias("_own"))
    full = nodes.drop("scraped_items").join(own, ["root", "path"], "left").join(menus, ["root", "path"], "left")
    trees = found.select("place_id", "root", "establishment_url").dropDuplicates(["place_id"]).withColumn("place_id", F.col("place_id").cast("string"))
    above = F.when(F.col("depth") > 0, F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    return full.join(trees, "root").select(
        "place_id",
        "path",
        above.alias("parent_path"),
        "depth",
        "position",
        F.col("final_url").alias("url"),
        "parent_url",
        F.when(F.col("depth") == 0, F.col("establishment_url")).otherwise(F.col("url")).alias("descriptor"),
        F.coalesce("_own", empty).alias("scraped_items"),
        F.coalesce("menu_book", empty).alias("menu_book"),
    ).select(*NODE_COLUMNS)
