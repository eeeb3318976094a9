"""Registered queries: every operator over the given tables, or over data Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlwork.functions import text as X
from trawlwork.functions import urls as U
from trawlwork.functions import vectors as V
from trawlwork.operators import cache as C
from trawlwork.operators import content as K
from trawlwork.operators import graph as G
from trawlwork.operators import places as P
from trawlwork.operators import relevance as R
from trawlwork.operators import scoring as S
from trawlwork.operators import vectors as W
from trawlwork.plans.lineage import cut, scratch_path
from trawlwork.plans.rank import rank_establishments
from trawlwork.plans.run import ITEMS, Run, RunCaches, StoredCrawl, run_establishments
from trawlwork.sources import tables as T
from trawlwork.sources import trees
from trawlwork.sources.profile import collect_profile, load_profile
from trawlwork.streaming import streams

# Parameters shared with the SQL in oracles.py.
PART_PROFILE = {
    "name": ["red widget", "Small Ring "],
    "ingredient_1": ["economy", "standard"],
    "ingredient_2": ["brand#12", "promo"],
    "ingredient_3": [],
}
CENTER = (29.76, -95.37)
CACHE_SPLIT = "2024-01-15"
CHUNK_LIMIT = 128
SHARD_DOCS = 250
TILE_ROWS = 128
AGENT = "trawler/1.0"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its operator."""
    _QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """The table dealt over all tasks by its key: of narrow rows, millions lie in one small file, and each makes long ones."""
    return _table(spark, sf, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


# ---- derived inputs -------------------------------------------------------------------------------


def _url_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Each page URL as stored, and in a form with user info, port, params and an unsorted query."""
    netloc = F.upper(F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    path = F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    loud = F.concat(
        F.lit("HTTP://User:pw@"), netloc, F.lit(":8080"), path, F.lit(";v=1?b=2&a=x+y&e=&c=%7E*%20z#f_1&g")
    )
    return _table(spark, sf, "pages").select(
        "page_id", F.posexplode(F.array("url", loud)).alias("variant", "url")
    )


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of ``part``: some without ingredients, some with one blank ingredient."""
    size = F.col("p_size") % 10
    return _table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("item"),
        F.when(size == 0, F.array().cast("array<string>"))
        .when(size == 1, F.array(F.lit("")))
        .otherwise(F.array("p_type", "p_brand"))
        .alias("ingredients"),
    )


def _part_profile(spark: SparkSession) -> DataFrame:
    return load_profile(spark, PART_PROFILE)


def _forest(spark: SparkSession, sf: str) -> DataFrame:
    """A site tree per brand: brand page, one page per type, one page per part with one item."""
    place = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    root_url = F.concat(F.lit("https://"), place, F.lit(".example.com"))
    kinds = F.array(*[F.lit(k) for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    number = (F.array_position(kinds, F.col("p_type")) - 1).cast("int")
    part = _table(spark, sf, "part").select(
        place.alias("place_id"),
        root_url.alias("root_url"),
        F.concat(root_url, F.lit("/"), F.lower("p_type")).alias("type_url"),
        number.alias("n"),
        F.col("p_partkey").cast("int").alias("k"),
        "p_name",
        F.array(F.lower("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("made_of"),
    )
    none = F.create_map().cast(trees.BOOK)

    def node(path: Column, parent: Column, depth: int, position: Column, url: str, above: Column, items: Column) -> list:
        return [
            "place_id",
            path.cast("array<int>").alias("path"),
            parent.cast("array<int>").alias("parent_path"),
            F.lit(depth).alias("depth"),
            position.alias("position"),
            F.col(url).alias("url"),
            above.cast("string").alias("parent_url"),
            F.col(url).alias("descriptor"),
            items.alias("scraped_items"),
            none.alias("menu_book"),
        ]

    root = part.select("place_id", "root_url").distinct()
    types = part.select("place_id", "root_url", "type_url", "n").distinct()
    nothing = F.lit(None)
    part = part.withColumn("part_url", F.concat("type_url", F.lit("/"), F.col("k").cast("string")))
    return (
        root.select(*node(F.array(), nothing, 0, F.lit(0), "root_url", nothing, none))
        .unionByName(types.select(*node(F.array("n"), F.array(), 1, F.col("n"), "type_url", F.col("root_url"), none)))
        .unionByName(
            part.select(
                *node(
                    F.array("n", "k"), F.array("n"), 2, F.col("k"), "part_url", F.col("type_url"),
                    F.create_map("p_name", "made_of"),
                )
            )
        )
    )


def _shop(key: Column) -> Column:
    return F.concat(F.lit("https://shop.example/p/"), key.cast("string"))


def _part_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links between part pages: three children, one page back, and one path that repeats a segment."""
    k = F.col("p_partkey")
    targets = F.array(
        _shop(k * 3 + 1), _shop(k * 3 + 2), _shop(k * 3 + 3), _shop(F.floor(k / 2)), F.concat(_shop(k), F.lit("/p"))
    )
    part = _spread(spark, sf, "part", "p_partkey")
    return part.select(_shop(k).alias("url"), F.posexplode(targets).alias("position", "link"))


def _part_roots(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(_shop(F.col("p_partkey")).alias("root"))


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listing pages of customers in five shapes: attribute order, quoting and missing links differ."""
    key = F.col("c_custkey")
    site = F.concat(F.lit("https://c"), key.cast("string"), F.lit(".example.com/"))
    menu = F.concat(
        F.lit('<a class="x" data-item-id="menu" href="'), site, F.lit('menu?a=1&amp;b=2" data-tooltip="Open menu link">Menu</a>')
    )
    website = F.concat(
        F.lit("<A data-tooltip='Open website' data-item-id=authority href='"), site, F.lit("'>Site</A>")
    )
    other = F.lit('<a href="/x">x</a><!-- <a data-item-id="menu" data-tooltip="Open menu link" href="/no"> -->')
    blank = F.lit('<a data-item-id="menu" data-tooltip="Open menu link" href="">Menu</a>')
    html = (
        F.when(key % 5 == 0, F.concat(other, menu, website))
        .when(key % 5 == 1, F.concat(other, website))
        .when(key % 5 == 2, F.concat(blank, website))
        .when(key % 5 == 3, F.concat(website, menu))
        .otherwise(other)
    )
    return _table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("https://maps.example/?cid="), key.cast("string")).alias("google_url"), html.alias("html")
    )


def _places(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf, "customer").select(
        key.cast("string").alias("place_id"),
        F.col("c_name").alias("name"),
        (F.lit(29.76) + (key % 41 - 20) * F.lit(0.01)).alias("lat"),
        (F.lit(-95.37) + ((key * 7) % 43 - 21) * F.lit(0.01)).alias("lon"),
        F.array(F.lower("c_mktsegment"), F.when(key % 2 == 0, "shop").otherwise("store")).alias("types"),
    )


def _cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(
        "event_id",
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
        "value",
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


def _cache_halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The cache made of early events, and the late events."""
    rows = _cache_rows(spark, sf)
    split = F.lit(CACHE_SPLIT).cast("timestamp")
    early = rows.filter(F.col("updated_at") < split).withColumn("key_hash", C.cache_key(F.col("key")))
    cache = C.latest(early, ["updated_at", "event_id"]).select("key_hash", "key", "value", "updated_at")
    return cache, rows.filter(F.col("updated_at") >= split)


# ---- sources and sinks ----------------------------------------------------------------------------


@query
def read_site_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Forest of part pages, written as nested JSON and flattened again."""
    path = scratch_path(spark, "forest")
    trees.export_nested_trees(_forest(spark, sf), path)
    nodes = trees.read_site_trees(spark, path)
    items = F.transform(
        F.map_entries("scraped_items"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))
    )
    return nodes.select(
        "place_id", "url", "parent_url", "depth", "descriptor", F.array_join(items, ";").alias("items")
    )


@query
def write_site_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of the forest's nodes, through the writer and the reader; items stand as books too."""
    path = scratch_path(spark, "stored-forest")
    trees.write_site_trees(_forest(spark, sf).withColumn("menu_book", F.col("scraped_items")), path)

    def shown(book: str) -> Column:
        parts = F.transform(F.map_entries(book), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
        return F.array_join(parts, ";").alias(book)

    def steps(path: str) -> Column:
        return F.array_join(F.transform(path, lambda n: n.cast("string")), "/").alias(path)

    return trees.read_site_trees(spark, path).select(
        "place_id", steps("path"), steps("parent_path"), "depth", "position", "url", "parent_url", "descriptor",
        shown("scraped_items"), shown("menu_book"),
    )


@query
def nest_site_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON of the forest: its size and its child order per place."""
    nested = trees.nest_site_trees(_forest(spark, sf))
    urls = F.regexp_extract_all("json", F.lit('"url":"([^"]*)"'), F.lit(1))
    return nested.select("place_id", F.array_join(_renumbered(urls), " ").alias("urls"))


def _renumbered(urls: Column) -> Column:
    # Children stand in position order: types by name, parts by key.
    return F.transform(urls, lambda u: F.regexp_replace(u, r"^https://[^/]*", ""))


@query
def merge_site_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as places, orders as nodes: late orders replace all earlier ones of their customer."""
    orders = _table(spark, sf, "orders").select(
        F.col("o_custkey").alias("place_id"), F.col("o_orderkey").alias("node"), "o_totalprice", "o_orderdate"
    )
    new = orders.filter(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    merged = trees.merge_site_trees(orders.withColumn("version", F.lit("old")), new.withColumn("version", F.lit("new")))
    return merged.drop("o_orderdate")


@query
def read_page_archive(spark: SparkSession, sf: str) -> DataFrame:
    return T.read_page_archive(spark, f"{sf}/pages.parquet").select("page_id", "url", "html")


@query
def read_places(spark: SparkSession, sf: str) -> DataFrame:
    """Search responses of 20 places each, written as JSON lines; every seventh has no results."""
    place = F.struct(
        "place_id",
        "name",
        F.struct(F.struct("lat", F.col("lon").alias("lng")).alias("location")).alias("geometry"),
        "types",
    )
    page = F.floor(F.col("place_id").cast("bigint") / 20)
    responses = (
        _places(spark, sf)
        .groupBy(page.alias("page"))
        .agg(F.collect_list(place).alias("results"))
        .select(
            F.concat(F.lit("type"), (F.col("page") % 3).cast("string")).alias("searched_type"),
            F.lit("OK").alias("status"),
            F.when(F.col("page") % 7 != 3, F.col("results")).alias("results"),
        )
    )
    path = scratch_path(spark, "responses")
    responses.write.json(path)
    read = T.read_places(spark, path)
    return read.select(
        "searched_type", "place_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        F.array_join("types", ",").alias("types"),
    )


@query
def write_ranked_results(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked CSV of matched parts, read back with the row numbers the files hold them in."""
    results = match_rows(spark, sf).withColumn("ingredients", F.array_join("ingredients", ", "))
    # Rounded before the ranking: the last bits of a sum must not decide between equal scores.
    results = results.withColumn("combined_score", F.round("combined_score", 6))
    path = scratch_path(spark, "ranked")
    T.write_ranked_results(results, path, ["p_partkey"])
    schema = "p_partkey bigint, scraped_item string, ingredients string, combined_score double, attribute_scores string"
    read = spark.read.schema(schema).csv(path, header=True, escape='"')
    # Numbered inside each file, whose totals say where the next one begins.
    placed = read.select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"),
    )
    files = placed.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return placed.withColumn("inside", inside).join(begins, "file").select(
        (F.col("begin") + F.col("inside")).alias("place"),
        "p_partkey",
        "scraped_item",
        F.coalesce("ingredients", F.lit("")).alias("ingredients"),
        F.round("combined_score", 6).alias("combined_score"),
        F.round(F.get_json_object("attribute_scores", "$.ingredient_1").cast("double"), 6).alias("ingredient_1"),
    )


@query
def load_profile_query(spark: SparkSession, sf: str) -> DataFrame:
    """Profile rows with the number of parts whose name, type or brand is the phrase."""
    phrases = _table(spark, sf, "part").select(
        F.explode(F.array(F.lower("p_name"), F.lower("p_type"), F.lower("p_brand"))).alias("phrase")
    )
    counts = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return (
        _part_profile(spark)
        .join(counts, "phrase", "left")
        .select("attribute", "phrase", "weight", F.coalesce("n", F.lit(0)).alias("parts"))
    )


# ---- URLs -----------------------------------------------------------------------------------------


@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = _url_variants(spark, sf).withColumn("p", U.url_parts(F.col("url")))
    return parts.select("page_id", "variant", "p.*")


@query
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return _url_variants(spark, sf).select("page_id", "variant", U.canonical_url(F.col("url")).alias("canonical"))


@query
def crawl_key_url(spark: SparkSession, sf: str) -> DataFrame:
    return _url_variants(spark, sf).select("page_id", "variant", U.crawl_key_url(F.col("url")).alias("crawl_key"))


@query
def resolve_link(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of every page, and one reference of each kind, resolved against the page."""
    kinds = ["/abs/x", "rel", "./y", "../z", "?q=1", "#f", "//other.example/p", "https://o.example/k", "mailto:a@b", ""]
    pages = _table(spark, sf, "pages")
    found = F.transform(X.anchor_attributes(F.col("html")), lambda t: X.attribute_value(t, "href"))
    hrefs = pages.select("page_id", "url", F.explode(F.concat(found, F.array(*[F.lit(k) for k in kinds]))).alias("href"))
    resolved = hrefs.withColumn("link", U.resolve_link(F.col("url"), F.col("href")))
    return resolved.select("page_id", "href", "link").distinct()


@query
def path_has_repeat(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl keys, and crawl keys with their first path segment once more at the end."""
    key = U.crawl_key_url(F.col("url"))
    again = F.concat(key, F.regexp_extract(key, "^https?://[^/]*(/[^/]*)", 1))
    keys = _table(spark, sf, "pages").select("page_id", F.posexplode(F.array(key, again)).alias("variant", "crawl_key"))
    return keys.withColumn("repeats", U.path_has_repeat(F.col("crawl_key")))


@query
def valid_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.array(
        F.col("url"),
        F.regexp_replace("url", "^https?://", ""),
        F.regexp_replace("url", "^https?:", ""),
        F.regexp_replace("url", "^https?://", "mailto:"),
    )
    urls = _table(spark, sf, "pages").select("page_id", F.posexplode(forms).alias("variant", "url"))
    return urls.filter(U.is_valid_url(F.col("url")))


@query
def content_route(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.array(F.col("url"), F.concat("url", F.lit(".PDF")), F.concat("url", F.lit(".pdf?x=1")))
    urls = _table(spark, sf, "pages").select("page_id", F.posexplode(forms).alias("variant", "url"))
    return urls.select("page_id", "variant", U.content_route(F.col("url")).alias("route"))


@query
def url_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _url_variants(spark, sf).select(
        "page_id", "variant", F.array_join(U.url_segments(F.col("url")), "|").alias("segments")
    )


@query
def segment_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return R.segment_vocabulary(_url_variants(spark, sf))


# ---- page content ---------------------------------------------------------------------------------


@query
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return K.extract_links(_table(spark, sf, "pages"), ["page_id"])


@query
def find_menu_link(spark: SparkSession, sf: str) -> DataFrame:
    return _listings(spark, sf).select("c_custkey", K.find_menu_link(F.col("html")).alias("site"))


@query
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query
def pages_to_document_text(spark: SparkSession, sf: str) -> DataFrame:
    return K.pages_to_document_text(_table(spark, sf, "conversations"), "conv_id", "turn")


@query
def dispatch_content(spark: SparkSession, sf: str) -> DataFrame:
    """Html pages and documents of joined page texts in one table, dispatched by type."""
    none = F.lit(None).cast("string")
    html = _table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.when(F.col("page_id") % 10 == 9, F.lit("image")).otherwise(U.content_route(F.col("url"))).alias("content_type"),
        "html",
        none.alias("pdf_text"),
    )
    pdf = K.pages_to_document_text(_table(spark, sf, "conversations"), "conv_id", "turn").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"),
        U.content_route(F.concat(F.lit("https://docs.example/"), F.col("conv_id").cast("string"), F.lit(".PDF"))).alias(
            "content_type"
        ),
        none.alias("html"),
        F.col("text").alias("pdf_text"),
    )
    text = K.dispatch_content(F.col("content_type"), F.col("html"), F.col("pdf_text"))
    return html.unionByName(pdf).select("id", "content_type", text.alias("text"))


@query
def extraction_prompts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("html").alias("content_type"), "text"
    )
    prompts = K.extraction_prompts(docs)
    return prompts.select("doc_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", X.token_counts(F.col("text")).alias("n_tokens"))


@query
def chunk_by_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return K.chunk_by_tokens(_table(spark, sf, "documents"), "doc_id", CHUNK_LIMIT)


@query
def token_budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return K.token_budget_batches(docs, "doc_id", shard=F.floor(F.col("doc_id") / SHARD_DOCS))


@query
def token_budget_batches_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """One run of batches over all documents."""
    return K.token_budget_batches(_table(spark, sf, "documents"), "doc_id", part_rows=200)


@query
def pick_response(spark: SparkSession, sf: str) -> DataFrame:
    return K.pick_response(_table(spark, sf, "conversations"), "conv_id", "turn")


@query
def clean_response(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns fenced in four ways, then cleaned."""
    form, text = F.col("turn") % 4, F.col("text")
    fenced = (
        F.when(form == 0, F.concat(F.lit("```output\n"), text, F.lit("\n```")))
        .when(form == 1, F.concat(F.lit("```output"), text, F.lit("```")))
        .when(form == 2, F.concat(F.lit(" \t"), text, F.lit("\n```\n")))
        .otherwise(text)
    )
    return _table(spark, sf, "conversations").select("conv_id", "turn", X.clean_response(fenced).alias("response"))


def _part_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of 20 lines, one per part, in five line shapes."""
    form, name = F.col("p_partkey") % 5, F.col("p_name")
    line = (
        F.when(form == 0, F.concat(name, F.lit(":N/A")))
        .when(form == 1, F.concat(name, F.lit(": "), "p_type", F.lit(" | "), "p_brand"))
        .when(form == 2, F.concat(F.lit(":"), name, F.lit(":"), "p_type"))
        .when(form == 3, name)
        .otherwise(F.concat(F.lit(" "), name, F.lit(":")))
    )
    lines = F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    return (
        _table(spark, sf, "part")
        .groupBy(F.floor(F.col("p_partkey") / 20).alias("response_id"))
        .agg(F.lower(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("response"))
        .withColumn("response", F.concat(F.lit("```output\n"), "response", F.lit("\n```")))
    )


@query
def parse_item_lines(spark: SparkSession, sf: str) -> DataFrame:
    items = K.parse_item_lines(_part_responses(spark, sf), ["response_id"])
    return items.select(
        "response_id", "item", F.array_join("ingredients", "|").alias("ingredients"), F.size("ingredients").alias("n")
    )


@query
def items_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.concat(_shop(k), F.when(k % 3 == 0, ".pdf").otherwise(""))
    part = _table(spark, sf, "part").select(
        url.alias("url"), "p_partkey", "p_name", "p_type", "p_brand",
        (k % 2 == 0).alias("has_html"), (k % 5 != 0).alias("has_pdf"),
    )

    def entry(item: Column, ingredient: str) -> Column:
        return F.array(F.struct(item.alias("item"), F.array(ingredient).alias("ingredients")))

    none = F.array().cast("array<struct<item:string,ingredients:array<string>>>")
    html = part.filter("has_html").select(
        "url", F.when(F.col("p_partkey") % 4 == 0, entry(F.col("p_name"), "p_type")).otherwise(none).alias("items")
    )
    pdf = part.filter("has_pdf").select(
        "url", entry(F.concat("p_name", F.lit(" (pdf)")), "p_brand").alias("items")
    )
    out = K.items_with_fallback(part.select("url", "has_html", "has_pdf"), html, pdf)
    shown = F.transform("items", lambda i: F.concat(i["item"], F.lit("="), F.array_join(i["ingredients"], ",")))
    return out.select("url", F.array_join(shown, ";").alias("items"))


@query
def resolve_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Every page URL and a noisy form of it, looked up through redirects of the even pages."""
    pages = _table(spark, sf, "pages")
    canonical = U.canonical_url(F.col("url"))
    first = pages.groupBy(canonical.alias("url")).agg(F.min("page_id").alias("page_id"))
    final = F.concat(F.lit("https://final.example/"), (F.col("page_id") % 50).cast("string"))
    redirects = first.filter(F.col("page_id") % 2 == 0).select("url", final.alias("final_url"))
    content = redirects.select(F.col("final_url").alias("url")).distinct().withColumn(
        "has_content", ~F.col("url").endswith("4")
    )
    requests = pages.select(
        "page_id", F.explode(F.array(F.col("url"), F.concat(F.col("url"), F.lit("#x")))).alias("url")
    )
    return K.resolve_redirects(requests, redirects, content)


@query
def robots_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rules derived from the page domains: mobile sites have none, blogs name the agent."""
    pages = _table(spark, sf, "pages").select("page_id", "url")
    domains = pages.select(U.url_domain(F.col("url")).alias("domain")).distinct()

    def rule(agent: str, number: int, allow: bool, prefix: str) -> Column:
        return F.struct(
            F.lit(agent).alias("agent"), F.lit(number).alias("rule_no"), F.lit(allow).alias("allow"), F.lit(prefix).alias("prefix")
        )

    general = [rule("*", 1, False, "/fr"), rule("*", 2, True, "/en/1"), rule("*", 3, False, "/en")]
    named = [rule("Trawler", 1, False, "/es"), rule("Trawler", 2, False, "")]
    rules = domains.filter(~F.col("domain").startswith("m.")).select(
        "domain",
        F.inline(F.when(F.col("domain").startswith("blog."), F.array(*general, *named)).otherwise(F.array(*general))),
    )
    return K.robots_filter(pages, rules, AGENT)


# ---- crawl graph ----------------------------------------------------------------------------------

_NODE = ["root", "url", "parent_url", "depth", "position"]


@query
def frontier_step(spark: SparkSession, sf: str) -> DataFrame:
    """The first level of a crawl from every part, all part pages below 3p+1 counting as visited roots."""
    roots = _part_roots(spark, sf)
    candidates = _part_links(spark, sf).select(
        F.col("url").alias("root"), F.col("link").alias("url"), F.col("url").alias("parent_url"), "position",
        F.array("position").alias("path"),
    )
    visited = roots.select("root", F.col("root").alias("url"))
    return G.frontier_step(candidates, visited, 1).select(*_NODE, "admitted")


@query
def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return G.crawl_bfs(_part_roots(spark, sf), _part_links(spark, sf)).select(*_NODE)


@query
def crawl_bfs_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl along links whose target is a part of a larger size."""
    relevant = _table(spark, sf, "part").filter(F.col("p_size") > 20).select(_shop(F.col("p_partkey")).alias("url"))
    return G.crawl_bfs_relevant(_part_roots(spark, sf), _part_links(spark, sf), relevant).select(*_NODE)


@query
def crawl_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The stored pages crawled from every page along the links in their html."""
    pages = _table(spark, sf, "pages")
    links = cut(G.link_table(K.extract_links(pages)), "links")
    roots = pages.select(U.crawl_key_url(F.col("url")).alias("root"))
    return G.crawl_bfs(roots, links).select(*_NODE)


@query
def subtree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The book of every node of the part forest."""
    books = G.subtree_rollup(_forest(spark, sf), "place_id", every_node=True)
    return books.select(
        "place_id",
        F.concat_ws("/", F.transform("node_path", lambda n: n.cast("string"))).alias("node_path"),
        "item",
        F.array_join("ingredients", ",").alias("ingredients"),
    )


@query
def reachable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The part forest when the pages of one type have no content: their parts are cut off."""
    nodes = _forest(spark, sf).withColumn("has_content", ~F.col("url").endswith("/promo"))
    return G.reachable_nodes(nodes, "place_id").select("place_id", "url", "depth")


@query
def dedupe_visited_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Part pages of a brand keep the first page per name."""
    nodes = _table(spark, sf, "part").select(
        F.col("p_brand").alias("root"),
        F.col("p_name").alias("url"),
        (F.col("p_size") % 4).alias("depth"),
        F.array(F.col("p_partkey").cast("int")).alias("path"),
        "p_partkey",
    )
    return G.dedupe_visited_nodes(nodes).drop("path")


# ---- phrases and vectors --------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))


@query
def normalize_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return W.normalize_phrases(_lines(spark, sf).select(F.explode("lines").alias("phrase")))


@query
def word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """All n-grams of every document's lines, in order, as one digest per document."""
    grams = _lines(spark, sf).select("doc_id", X.word_ngrams(F.col("lines")).alias("grams"))
    return grams.select("doc_id", F.size("grams").alias("n_grams"), F.md5(F.array_join("grams", "|")).alias("grams_md5"))


def _word_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of all documents, lower-cased once per text."""
    words = X.words(F.lower("text"))
    return _table(spark, sf, "documents").select(F.explode(words).alias("phrase")).distinct()


@query
def embed_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of every distinct word, its cells as one digest."""
    embedded = W.embed_phrases(_word_phrases(spark, sf))
    counts = F.col("embedding").cast("array<int>").cast("array<string>")
    return embedded.select("phrase", F.md5(F.array_join(counts, " ")).alias("cells_md5"))


@query
def phrase_universe(spark: SparkSession, sf: str) -> DataFrame:
    return W.phrase_universe(_items(spark, sf))


@query
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one."""
    left = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = V.cosine_similarity(F.col("embedding"), F.col("other"))
    return left.join(right, "vec_id").select("vec_id", F.round(score, 6).alias("score"))


def _label_means(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of each label: as many rows as labels."""
    cells = _table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "v")))
    return means.groupBy("label").agg(F.transform(ordered, lambda c: c["v"]).alias("embedding"))


@query
def pairwise_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity matrix of all vectors with the label means, one row per vector."""
    matrix = W.pairwise_similarity(_table(spark, sf, "embeddings"), _label_means(spark, sf), "vec_id", "label")
    shown = F.transform("scores", lambda s: F.format_string("%.4f", s))
    return matrix.select("vec_id", F.array_join(shown, " ").alias("scores"))


@query
def pairwise_similarity_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors with all vectors, in tiles."""
    vectors = _table(spark, sf, "embeddings")
    return W.similarity_tiles(vectors, vectors.withColumnRenamed("vec_id", "right_id"), "vec_id", "right_id", TILE_ROWS, decimals=4)


@query
def match_items_large_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and types against a profile of all part names, met tile by tile."""
    names = _table(spark, sf, "part").select(F.lit("name").alias("attribute"), F.lower("p_name").alias("phrase"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("scored"))
    kinds = _table(spark, sf, "part").select(F.lit("kind").alias("attribute"), F.lower("p_type").alias("phrase"), F.lit(1.0).alias("weight"), F.lit(True).alias("scored"))
    profile = collect_profile(names.unionByName(kinds), limit=64)
    items = _table(spark, sf, "supplier").select("s_suppkey", F.lower("s_name").alias("item"), F.array(F.lit("promo"), F.lower("s_name")).alias("ingredients"))
    scored = S.name_similarity(S.attribute_similarity(items, profile, ["s_suppkey"]), profile, ["s_suppkey"])
    attribute = F.map_from_entries("attribute_scores")
    return scored.select("s_suppkey", F.round("name_score", 6).alias("name_score"), F.round(attribute["kind"], 6).alias("kind_score"), F.round(attribute["name"], 6).alias("name_on_ingredients"))


@query
def max_similarity(spark: SparkSession, sf: str) -> DataFrame:
    best = W.max_similarity(_table(spark, sf, "embeddings"), _label_means(spark, sf), "vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


@query
def url_relevance(spark: SparkSession, sf: str) -> DataFrame:
    scored = R.url_relevance(_url_variants(spark, sf))
    return scored.select("url", F.round("score", 6).alias("score"))


@query
def url_relevance_from_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores through a table of vectors of the distinct segments."""
    urls = _url_variants(spark, sf)
    vocabulary = R.segment_vocabulary(urls).select(F.col("segment").alias("phrase")).filter("phrase <> ''")
    vectors = cut(W.embed_phrases(vocabulary), "vectors")
    return R.url_relevance(urls, vectors=vectors).select("url", F.round("score", 6).alias("score"))


@query
def filter_relevant_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical URLs of pages and of their links above a threshold, with scores of even pages cached."""
    pages = _table(spark, sf, "pages")
    links = K.extract_links(pages).select(F.col("link").alias("url"))
    urls = cut(pages.select("url").unionByName(links), "urls")
    known = R.url_relevance(
        pages.filter(F.col("page_id") % 2 == 0).select(U.canonical_url(F.col("url")).alias("url"))
    )
    cache = known.select(C.cache_key(F.col("url")).alias("key_hash"), F.col("score").alias("value"))
    relevant = R.filter_relevant_urls(urls, threshold=0.3, cache=cut(cache, "cache"))
    return relevant.select("url", F.round("score", 6).alias("score"))


@query
def attribute_similarity(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.attribute_similarity(_items(spark, sf), _part_profile(spark), ["p_partkey"])
    return scored.select("p_partkey", F.inline("attribute_scores")).withColumn("score", F.round("score", 6))


@query
def attribute_similarity_from_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores through a table of vectors of all phrases and n-grams."""
    items = _items(spark, sf)
    targets = _part_profile(spark).select("phrase").filter("phrase <> ''")
    vectors = cut(W.embed_phrases(W.phrase_universe(items).union(targets).distinct()), "vectors")
    scored = S.attribute_similarity(items, _part_profile(spark), ["p_partkey"], vectors=vectors)
    return scored.select("p_partkey", F.inline("attribute_scores")).withColumn("score", F.round("score", 6))


@query
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.name_similarity(_items(spark, sf), _part_profile(spark), ["p_partkey"])
    return scored.select("p_partkey", F.round("name_score", 6).alias("name_score"))


@query
def threshold_gate(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.attribute_similarity(_items(spark, sf), _part_profile(spark), ["p_partkey"])
    gated = S.threshold_gate(scored, 0.9)
    passed = F.aggregate("passed_scores", F.lit(0), lambda n, s: n + (s["score"] > 0).cast("int"))
    return gated.select("p_partkey", "gated", passed.alias("passed"))


@query
def weighted_attribute_score(spark: SparkSession, sf: str) -> DataFrame:
    weights = {"ingredient_1": 2.0, "ingredient_2": 1.0, "ingredient_3": 1.0}
    profile = load_profile(spark, PART_PROFILE, weights)
    gated = S.threshold_gate(S.attribute_similarity(_items(spark, sf), profile, ["p_partkey"]))
    scored = S.weighted_attribute_score(gated, profile)
    return scored.select("p_partkey", F.round("attribute_score", 6).alias("attribute_score"))


@query
def hybrid_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.score_items(_items(spark, sf), _part_profile(spark), ["p_partkey"], name_weight=0.7)
    return scored.select("p_partkey", F.round("combined_score", 6).alias("combined_score"))


def match_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.match_items(_items(spark, sf), _part_profile(spark), ["p_partkey"])


@query
def match_items(spark: SparkSession, sf: str) -> DataFrame:
    return match_rows(spark, sf).select(
        "p_partkey",
        "scraped_item",
        F.array_join("ingredients", ", ").alias("ingredients"),
        F.round("combined_score", 6).alias("combined_score"),
        *[F.round(F.col("attribute_scores")[a], 6).alias(f"score_{a}") for a in PART_PROFILE],
    )


# ---- caches ---------------------------------------------------------------------------------------


@query
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(
        "event_id",
        C.cache_key(F.col("event_type")).alias("single"),
        C.cache_key(F.col("user_id"), F.col("event_type")).alias("composite"),
    )


@query
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cache, late = _cache_halves(spark, sf)
    return C.cache_lookup(late.select("event_id", "key"), cache).select("event_id", "key", "value")


@query
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    cache, late = _cache_halves(spark, sf)
    table = C.cache_upsert(cache, late, ["updated_at", "event_id"])
    return table.select("key_hash", "key", "value")


@query
def cache_table_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches written to a cache table, the second one twice, then read and compacted."""
    rows = _cache_rows(spark, sf)
    split = F.lit(CACHE_SPLIT).cast("timestamp")
    path, packed = scratch_path(spark, "cache"), scratch_path(spark, "compacted")
    order = ["updated_at", "event_id"]
    C.write_cache_batch(rows.filter(F.col("updated_at") < split), path, 0, order)
    for _ in range(2):
        C.write_cache_batch(rows.filter(F.col("updated_at") >= split), path, 1, order)
    typed = {"updated_at": "timestamp", "event_id": "bigint"}
    C.compact_cache(spark, path, "double", packed, typed)
    return C.read_cache(spark, packed, "double", typed).select("key_hash", "key", "value")


@query
def cache_overwrite_report(spark: SparkSession, sf: str) -> DataFrame:
    cache, late = _cache_halves(spark, sf)
    return C.cache_overwrite_report(cache, late)


@query
def cache_read_through(spark: SparkSession, sf: str) -> DataFrame:
    """Late keys: early ones answer from the cache, the others are computed as their length."""
    cache, late = _cache_halves(spark, sf)
    known, fresh = C.cache_read_through(
        late, cache, lambda missing: missing.select("key", F.length("key").cast("double").alias("value"))
    )
    return known.withColumn("source", F.lit("cache")).unionByName(fresh.withColumn("source", F.lit("computed")))


@query
def cache_hit_report(spark: SparkSession, sf: str) -> DataFrame:
    cache, late = _cache_halves(spark, sf)
    namespace = F.substring_index("key", ":", -1)
    return C.cache_hit_report(
        late.select(namespace.alias("namespace"), "key"), cache.select(namespace.alias("namespace"), "key_hash")
    )


# ---- places and the whole run ---------------------------------------------------------------------


@query
def places_nearby(spark: SparkSession, sf: str) -> DataFrame:
    near = P.places_nearby(_places(spark, sf), *CENTER, types=["shop", "building", "store"], radius_m=12000)
    return near.select("place_id", "searched_type", F.round("distance_m", 2).alias("distance_m"))


@query
def places_nearby_keyword(spark: SparkSession, sf: str) -> DataFrame:
    near = P.places_nearby(
        _places(spark, sf), *CENTER, types=["building", "shop"], radius_m=20000, keyword="CUSTOMER#0000000", dedupe=True
    )
    return near.select("place_id", "searched_type", F.round("distance_m", 2).alias("distance_m"))


@query
def place_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as places: every seventh lacks details, some listings lack links; dropped ones are marked."""
    listings = _listings(spark, sf)
    details = listings.filter(F.col("c_custkey") % 7 != 0).select(F.col("c_custkey").alias("place_id"), "google_url")
    places = listings.select(F.col("c_custkey").alias("place_id"))
    found, dropped = P.place_sites(places, details, listings)
    return found.select("place_id", "google_url", "establishment_url").unionByName(dropped, allowMissingColumns=True)


def _menu_url(key: Column, section: str = "menu") -> Column:
    return F.concat(F.lit(f"https://shop.example/{section}/item-"), key.cast("string"))


@query
def rank_establishments_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run over sites of suppliers: part pages link to part pages, responses name their items."""
    part = _spread(spark, sf, "part", "p_partkey")
    k = F.col("p_partkey")
    html = F.concat(
        F.lit("<html><body><h1>"), F.col("p_name"), F.lit("</h1><a href='/menu/item-"), (k * 3 + 1).cast("string"),
        F.lit("'>a</a><a href=\"../menu/item-"), (k * 3 + 2).cast("string"),
        F.lit('?from=list#top">b</a><a href="/imprint/item-'), (k * 3 + 3).cast("string"), F.lit('">c</a></body></html>'),
    )
    pages = part.select(_menu_url(k).alias("url"), html.alias("html"))
    answer = F.concat(F.lit("```output\n"), F.initcap("p_name"), F.lit(": "), "p_type", F.lit("|"), "p_brand", F.lit("\n```"))
    # Pages of one size have no response at all: they fail, and nothing below them is reached.
    answered = part.filter(F.col("p_size") != 13)
    responses = answered.select(_menu_url(k).alias("url"), F.posexplode(F.array(F.lit("none"), answer)).alias("n", "text"))
    supplier = _spread(spark, sf, "supplier", "s_suppkey")
    sites = supplier.select(
        F.concat(F.lit("https://maps.example/?cid="), F.col("s_suppkey").cast("string")).alias("google_url"),
        F.concat(_menu_url(F.col("s_suppkey")), F.lit("/?utm=maps")).alias("establishment_url"),
    )
    ranked = rank_establishments(sites, pages, responses, _part_profile(spark))
    return ranked.select(
        "google_url", "establishment_url", "scraped_item", "ingredients",
        F.round("combined_score", 6).alias("combined_score"),
    )


def _run(spark: SparkSession, sf: str) -> Run:
    """Suppliers as places, parts as pages: some PDFs, some redirects (two to one, cycles, roots), a robots rule, failures."""
    part, supplier = _spread(spark, sf, "part", "p_partkey"), _spread(spark, sf, "supplier", "s_suppkey")
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    google = F.concat(F.lit("https://maps.example/?cid="), s.cast("string"))
    listing = F.when(
        s % 13 != 0, F.concat(F.lit('<a data-tooltip="Open menu link" data-item-id="menu" href="'), _menu_url(s), F.lit('?utm=maps">menu</a>'))
    ).otherwise("<p>no link</p>")
    html = F.concat(
        F.lit("<a href='/menu/item-"), (k * 3 + 1).cast("string"), F.lit("'>a</a><a href=\"../menu/item-"), (k * 3 + 2).cast("string"),
        F.lit('?from=list#top">b</a><a href="/imprint">c</a>'),
    )
    pages = part.select(_menu_url(k).alias("url"), F.when(k % 7 != 3, html).alias("html"))
    sheets = part.filter((k % 7 == 3) | (k % 9 == 2)).select(_menu_url(k).alias("url"), F.lit(1).alias("page_no"), F.col("p_name").alias("text"))
    goes = F.when(k % 50 == 6, k + 1).when(k % 50 == 7, k - 1).when(k % 10 == 4, F.floor(k / 2))
    redirects = part.filter(goes.isNotNull()).select(_menu_url(k).alias("url"), _menu_url(goes).alias("final_url"))
    rules = spark.createDataFrame([("shop.example", "*", 1, False, "/menu/item-9")], "domain string, agent string, rule_no int, allow boolean, prefix string")
    menu = F.when(k % 9 == 2, F.lit("No menu items found")).otherwise(F.concat(F.initcap("p_name"), F.lit(": "), "p_type", F.lit("|"), "p_brand"))
    answered = part.filter(F.col("p_size") != 13)
    responses = answered.filter(k % 7 != 3).select(_menu_url(k).alias("url"), F.lit("html").alias("content_type"), F.posexplode(F.array(F.lit("none"), menu)).alias("n", "text"))
    sheet = F.concat("p_name", F.lit(" sheet:"), "p_brand")
    responses = responses.unionByName(
        answered.filter((k % 7 == 3) | (k % 9 == 2)).select(_menu_url(k).alias("url"), F.lit("pdf").alias("content_type"), F.posexplode(F.array(sheet)).alias("n", "text"))
    )
    crawl = StoredCrawl(
        places=supplier.select(s.alias("place_id")),
        details=supplier.filter(s % 11 != 0).select(s.alias("place_id"), google.alias("google_url")),
        listings=supplier.select(google.alias("google_url"), listing.alias("html")),
        pages=pages, responses=responses, pdf_pages=sheets, redirects=redirects, rules=rules,
    )
    kinds = {"vectors": "array<float>", "relevance": "double", "items": ITEMS}
    caches = RunCaches(**{name: C.KeyedTable(spark, scratch_path(spark, name), kind, buckets=8) for name, kind in kinds.items()})
    return run_establishments(crawl, _part_profile(spark), caches, agent=AGENT)


@query
def run_establishments_query(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking of the whole run, with caches that start empty."""
    return _run(spark, sf).results.select(
        "google_url", "establishment_url", "scraped_item", "ingredients", F.round("combined_score", 6).alias("combined_score")
    )


@query
def run_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The forest that the whole run stores: every request of every tree, where it ended, and how many items it has."""
    forest = _run(spark, sf).forest
    path = F.concat_ws("/", F.transform("path", lambda n: n.cast("string"))).alias("path")
    return forest.select("place_id", path, "depth", "url", F.size("scraped_items").alias("n_items"), F.size("menu_book").alias("n_book"))


@query
def crawl_redirected(spark: SparkSession, sf: str) -> DataFrame:
    """The part crawl where some pages redirect: roots, two URLs to one page, cycles; every final page once per tree."""
    k = F.col("p_partkey")
    goes = F.when(k % 50 == 6, k + 1).when(k % 50 == 7, k - 1).when(k % 10 == 4, F.floor(k / 2)).otherwise(k)
    targets = _table(spark, sf, "part").select(_shop(k).alias("url"), _shop(goes).alias("final_url"), (k % 7 != 3).alias("expands"))
    nodes = G.crawl_bfs(_part_roots(spark, sf), _part_links(spark, sf), targets=targets)
    return G.dedupe_visited_nodes(nodes, url="final_url").select(*_NODE, "final_url")


# ---- streams --------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = _table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def stream_visited_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each user once; the delay is longer than the data, so no state expires."""
    admitted = streams.stream_visited_dedup(_event_stream(spark, sf), "user_id", "ts", "31 days").select("user_id")
    path = scratch_path(spark, "stream-visited")
    streams.write_stream(admitted, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("user_id bigint").parquet(f"{path}/out")


@query
def stream_visited_by_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Users as crawls that end with every purchase: each kind of event once between two ends."""
    events = _event_stream(spark, sf).withColumn("ends", F.col("event_type") == "purchase")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        admitted = streams.stream_visited_by_crawl(events, "user_id", "event_type", "ts", "ends", shares=2)
        path = scratch_path(spark, "stream-crawls")
        streams.write_stream(admitted, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    out = spark.read.schema("crawl bigint, url string, ts timestamp").parquet(f"{path}/out")
    shown = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select(F.col("crawl").alias("user_id"), F.col("url").alias("event_type"), shown.alias("admitted_at"))


@query
def stream_cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last value per user, kept by a stream in a table that has the first half of the events already."""
    rows = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("key"), "value", F.col("ts").cast("timestamp").alias("updated_at"), "event_id"
    )
    path = scratch_path(spark, "stream-cache")
    early = _table(spark, sf, "events").filter(F.col("event_id") % 2 == 0).select(
        F.col("user_id").cast("string").alias("key"), "value", F.col("ts").cast("timestamp").alias("updated_at"), "event_id"
    )
    C.write_cache_batch(early, f"{path}/table", 0, ["updated_at", "event_id"])
    streams.stream_cache_upsert(rows, f"{path}/table", f"{path}/checkpoint", ["updated_at", "event_id"]).awaitTermination()
    typed = {"updated_at": "timestamp", "event_id": "bigint"}
    return C.read_cache(spark, f"{path}/table", "double", typed).select("key_hash", "key", "value")
