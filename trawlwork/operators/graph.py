"""Crawl-graph operators: breadth-first crawl of stored links, and roll-up of items along site trees.

A node is identified inside its tree by ``path``, the link positions from the root down to it. Comparing
paths of one depth gives the order in which a queue would have visited them, so "first discoverer" needs
no global sort, and all ancestors of a node are the prefixes of its path, so a roll-up needs no joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.functions.urls import canonical_url, content_route, crawl_key_url, path_has_repeat
from trawlwork.plans.lineage import cut, scratch_path
from trawlwork.plans.skew import bounded_broadcast, lookup_join, sorted_join
from trawlwork.settings import DEPTH_LIMIT, HOT_KEY_ROWS, SHARE_LINKS


def frontier_step(candidates: DataFrame, visited: DataFrame, depth: int, depth_limit: int = DEPTH_LIMIT) -> DataFrame:
    """One level of a crawl: ``(root, url, parent_url, depth, position, path, admitted)``.

    ``candidates(root, url, parent_url, position, path)`` are discovered links, ``path`` ending in the
    link's position; ``visited(root, url)`` is per root. Beyond the depth limit nothing is kept. Of several
    discoverers the first in queue order becomes the parent. Every returned row counts as visited; only
    ``admitted`` rows (no repeated path segment) are nodes. Further columns of the candidates, which follow from
    the URL, are kept.
    """
    known = ["root", "url", "parent_url", "position", "path"]
    more = [c for c in candidates.columns if c not in known]
    if depth > depth_limit:
        candidates = candidates.limit(0)
    # URLs begin alike: behind a hash of both keys a sort hardly ever compares them.
    both = F.xxhash64("root", "url").alias("_hash")
    first = candidates.groupBy(both, "root", "url").agg(
        F.min(F.struct("path", "parent_url", "position", *more)).alias("found")
    )
    fresh = sorted_join(first, visited.select(both, "root", "url"), ["_hash", "root", "url"], "left_anti")
    return fresh.select(
        "root",
        "url",
        F.col("found.parent_url").alias("parent_url"),
        F.lit(depth).alias("depth"),
        F.col("found.position").alias("position"),
        F.col("found.path").alias("path"),
        (~path_has_repeat(F.col("url"))).alias("admitted"),
        *(F.col(f"found.{c}").alias(c) for c in more),
    )


class LinkStore:
    """The links of all pages, shuffled and written once for all levels of a crawl.

    ``(url, share, link, position, final_url, next, next_shares)``: a page's links in shares of about ``share_links``, in buckets
    of (page, share), and with each link what the crawl needs to know of its target: the URL it ends at, the page whose links
    come next (null if there is none to read), and in how many shares these lie. So no level looks anything up.
    """

    def __init__(self, links: DataFrame, targets: DataFrame | None, share_links: int = SHARE_LINKS):
        """``links(url, link, position)``, ``targets(url, final_url, expands)`` with one row per URL, see :func:`crawl_bfs`."""
        self.spark, self.share_links = links.sparkSession, share_links
        links = links.filter(content_route(F.col("url")) == "html").select("url", "link", F.col("position").cast("int").alias("position"))
        # Most pages lie in one share; those that do not are counted here, however many they are.
        counts = links.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share_links)
        self.shares = cut(counts.select("url", F.ceil(F.col("n") / share_links).cast("int").alias("shares")), "link-shares")
        self.divided = not self.shares.isEmpty()
        self.targets = None if targets is None else targets.select("url", "final_url", "expands")
        aimed = self.aimed(links, "link")
        if self.divided:
            split = lookup_join(cut(aimed, "aimed-links"), self.shares.withColumnRenamed("shares", "_shares"), ["url"])
            share = F.pmod(F.xxhash64("link"), F.coalesce("_shares", F.lit(1))).cast("int")
        else:
            split, share = aimed, F.lit(0)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"crawl_links_{uuid.uuid4().hex}"
        rows = split.withColumn("share", share).drop("_shares")
        # One task writes one bucket, so that there is one file a bucket; the columns of the buckets are those of the joins.
        rows.repartition(buckets, "url", "share").write.option("path", scratch_path(self.spark, "links")).bucketBy(buckets, "url", "share").sortBy(
            "url", "share"
        ).saveAsTable(self.table)
        self.links = self.spark.table(self.table)

    def aimed(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with where the URL in ``column`` leads."""
        if self.targets is None:
            known = rows.withColumn("final_url", F.col(column))
            known = known.withColumn("next", F.when(content_route(F.col(column)) == "html", F.col(column)))
        else:
            found = lookup_join(cut(rows, "links-to-aim"), self.targets.withColumnRenamed("url", column), [column])
            known = found.withColumn("next", F.when(F.col("expands"), F.col("final_url"))).drop("expands")
            known = known.withColumn("final_url", F.coalesce("final_url", F.col(column)))
        if not self.divided:
            return known.withColumn("next_shares", F.lit(1))
        shares = self.shares.select(F.col("url").alias("next"), F.col("shares").alias("next_shares"))
        joined = lookup_join(cut(known, "links-with-targets"), shares, ["next"])
        return joined.withColumn("next_shares", F.coalesce("next_shares", F.lit(1)))

    def follow(self, frontier: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
        """Candidates of the next level: the links of every frontier row's page.

        A row meets every share of its page. Pages that very many rows stand on (one page under many roots) are split on that
        side too: their links, and no others, are copied to as many tasks as their rows need.
        """
        parents = frontier.filter(F.col("next").isNotNull()).select("root", F.col("next").alias("url"), F.col("path").alias("_path"), "next_shares")
        spread = parents.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("next_shares") - 1))).drop("next_shares")
        keys = ["url", "share"]
        if frontier.count() < hot_rows:  # then no page is that often there
            return _candidates(sorted_join(spread, self.links, keys))
        counts = parents.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows)
        hot = cut(counts.select("url", F.ceil(F.col("n") / hot_rows).cast("int").alias("_splits")), "hot-pages")
        if hot.isEmpty():
            return _candidates(sorted_join(spread, self.links, keys))
        few = bounded_broadcast(hot)
        usual = _candidates(sorted_join(spread.join(few, "url", "left_anti"), self.links, keys))
        rows = spread.join(few, "url").withColumn("_split", F.pmod(F.xxhash64("root"), "_splits").cast("int")).drop("_splits")
        copies = self.links.join(few, "url").withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))).drop("_splits")
        return usual.unionByName(_candidates(sorted_join(rows, copies, [*keys, "_split"])))

    def drop(self) -> None:
        """Forget the table's name; its files go with the run's folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _candidates(joined: DataFrame) -> DataFrame:
    return joined.select(
        "root",
        F.col("link").alias("url"),
        F.col("url").alias("parent_url"),
        "position",
        F.array_append("_path", F.col("position")).alias("path"),
        "final_url",
        "next",
        "next_shares",
    )


def crawl_bfs(
    roots: DataFrame,
    links: DataFrame,
    depth_limit: int = DEPTH_LIMIT,
    hub_rows: int = HOT_KEY_ROWS,
    targets: DataFrame | None = None,
    share_links: int = SHARE_LINKS,
) -> DataFrame:
    """``(root, url, parent_url, depth, position, path)``: breadth-first crawl over ``links(url, link, position)``.

    ``roots(root)`` and the links hold crawl keys. All roots advance together, one written table per level.
    A page without links stays as a leaf; PDFs are not expanded. With ``targets(url, final_url, expands)`` every node has
    its ``final_url`` too: a request that is redirected goes on with the links of the page it ends at, if ``expands``, and a
    URL that is not in the table leads nowhere. Visited are requested URLs: two nodes of a tree may end at one page, and
    the first in queue order has all its children (:func:`dedupe_visited_nodes`). A page's redirect is followed once, so
    cycles of redirects end.
    """
    store = LinkStore(links, targets, share_links)
    start = store.aimed(roots.select("root").distinct().withColumn("url", F.col("root")), "url").select(
        "root",
        "url",
        F.lit(None).cast("string").alias("parent_url"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("position"),
        F.array().cast("array<int>").alias("path"),
        F.lit(True).alias("admitted"),
        "final_url",
        "next",
        "next_shares",
    )
    levels = [cut(start, "level-0")]
    for depth in range(1, depth_limit + 1):
        visited = _union([level.select("root", "url") for level in levels])
        frontier = levels[-1].filter("admitted")
        level = cut(frontier_step(store.follow(frontier, hub_rows), visited, depth, depth_limit), f"level-{depth}")
        if level.isEmpty():
            break
        levels.append(level)
    store.drop()
    found = _union(levels).filter("admitted")
    return found.select("root", "url", "parent_url", "depth", "position", "path", *([] if targets is None else ["final_url"]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def canonical_links(page_links: DataFrame) -> DataFrame:
    """``(url, link, position)`` with canonical links; a link without a host goes."""
    found = F.array_compact(F.array(canonical_url(F.col("link"))))
    return page_links.select("url", "position", F.explode(found).alias("link")).select("url", "link", "position")


def link_table(page_links: DataFrame) -> DataFrame:
    """``(url, link, position)`` with crawl keys, from ``(url, link, position)`` as extracted."""
    keyed = page_links.select(
        crawl_key_url(F.col("url")).alias("url"), crawl_key_url(F.col("link")).alias("link"), "position"
    )
    return keyed.groupBy("url", "link").agg(F.min("position").alias("position"))


def crawl_bfs_relevant(
    roots: DataFrame,
    page_links: DataFrame,
    relevant: DataFrame,
    depth_limit: int = DEPTH_LIMIT,
    hub_rows: int = HOT_KEY_ROWS,
    targets: DataFrame | None = None,
) -> DataFrame:
    """:func:`crawl_bfs` along the :func:`canonical_links` that are in ``relevant(url)``, one row per URL.

    Relevance depends on the URL alone, so it is applied once, ahead of the loop.
    """
    # Some link, such as a home page, is on very many pages.
    kept = lookup_join(page_links, relevant.select(F.col("url").alias("link")), ["link"], "inner")
    return crawl_bfs(roots, cut(link_table(kept.select("url", "link", "position")), "links"), depth_limit, hub_rows, targets)


def dedupe_visited_nodes(nodes: DataFrame, tree: str = "root", url: str = "url") -> DataFrame:
    """One node per tree and ``url`` (name ``final_url`` where requests were redirected), the first by depth and queue order.

    What goes has no children: the first of several nodes that end at one page is read first, and takes all its links.
    """
    others = [c for c in nodes.columns if c not in (tree, url)]
    first = F.min_by(F.struct(*others), F.struct("depth", "path")).alias("node")
    return nodes.groupBy(tree, url).agg(first).select(tree, url, "node.*").select(*nodes.columns)


def _prefixes(path: Column, include_self: bool = True) -> Column:
    last = F.size(path) if include_self else F.size(path) - 1
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.transform(steps, lambda n: F.slice(path, F.lit(1), n))


def reachable_nodes(nodes: DataFrame, tree: str = "root") -> DataFrame:
    """Nodes with content all the way up: a page without content cuts off its subtree.

    ``nodes(tree, path, has_content, ...)``.
    """
    missing = nodes.filter(~F.col("has_content")).select(tree, F.col("path").alias("_prefix")).distinct()
    above = nodes.select(tree, "path", F.explode(_prefixes(F.col("path"))).alias("_prefix"))
    lost = sorted_join(above, missing, [tree, "_prefix"], "left_semi").select(tree, "path").distinct()
    return sorted_join(nodes, lost, [tree, "path"], "left_anti")


def book_entries(nodes: DataFrame, tree: str = "root", every_node: bool = False) -> DataFrame:
    """``(tree, node_path, item, ingredient)``, distinct: the union of all items below each node.

    Items without ingredients keep one row with a null ingredient. Only root books are made unless
    ``every_node`` is set. Long form: a site of any size stays many small rows.
    """
    at = _prefixes(F.col("path")) if every_node else F.array(F.array().cast("array<int>"))
    return (
        nodes.select(tree, F.col("path").alias("_path"), F.explode("scraped_items").alias("item", "ingredients"))
        .withColumnRenamed("_path", "path")
        .select(tree, F.explode(at).alias("node_path"), "item", "ingredients")
        .select(tree, "node_path", "item", F.explode_outer("ingredients").alias("ingredient"))
        .distinct()
    )


def subtree_rollup(nodes: DataFrame, tree: str = "root", every_node: bool = False) -> DataFrame:
    """``(tree, node_path, item, ingredients)``: :func:`book_entries` with one sorted ingredient list per item."""
    entries = book_entries(nodes, tree, every_node)
    # Entries are distinct already, so a list holds an item's different ingredients and nothing else.
    return entries.groupBy(tree, "node_path", "item").agg(
        F.sort_array(F.collect_list("ingredient")).alias("ingredients")
    )
