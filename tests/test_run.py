"""The whole run on a small stored crawl: robots, redirects, PDFs, failures, caches, forests."""

import pytest

from trawlwork.operators.cache import KeyedTable
from trawlwork.plans.run import ITEMS, RunCaches, StoredCrawl, run_establishments
from trawlwork.sources.profile import load_profile
from trawlwork.sources.trees import export_nested_trees, read_site_trees, write_site_trees

SITE = "https://a.example"


def links(*paths):
    return "".join(f'<a href="{p}">x</a>' for p in paths)


@pytest.fixture(scope="module")
def crawl(spark):
    pages = {
        f"{SITE}/menu": links("/menu/soups", "/menu/old", "/menu/old2", "/menu/card.pdf", "/menu/secret", "/menu/broken", "/menu/missing", "/menu/new"),
        f"{SITE}/menu/soups": links("/menu", "/menu/soups/beet"),
        f"{SITE}/menu/soups/beet": "<p>beet</p>",
        f"{SITE}/menu/new": links("/menu/new/cake"),
        f"{SITE}/menu/new/cake": "<p>cake</p>",
        f"{SITE}/menu/secret": links("/menu/secret/deep"),
        f"{SITE}/menu/secret/deep": "<p>deep</p>",
        f"{SITE}/menu/broken": links("/menu/broken/below"),
        f"{SITE}/menu/broken/below": "<p>below</p>",
        f"{SITE}/menu/home": "<p>never linked</p>",
    }
    answers = {
        (f"{SITE}/menu", "html"): "Bread:flour",
        (f"{SITE}/menu/soups", "html"): "No menu items found",
        (f"{SITE}/menu/soups", "pdf"): "Soup:beet|salt",
        (f"{SITE}/menu/soups/beet", "html"): "Beet soup:beet",
        (f"{SITE}/menu/new", "html"): "Pie:apple",
        (f"{SITE}/menu/new/cake", "html"): "Cake:egg",
        (f"{SITE}/menu/card.pdf", "pdf"): "Card dish:carrot",
        (f"{SITE}/menu/secret", "html"): "Secret:x",
        (f"{SITE}/menu/secret/deep", "html"): "Deep:x",
        (f"{SITE}/menu/broken/below", "html"): "Below:x",
    }
    listing = '<a data-item-id="menu" data-tooltip="Open menu link" href="{}">m</a>'
    make = spark.createDataFrame
    return StoredCrawl(
        places=make([("p1",), ("p2",), ("p2",), ("p3",), ("p4",)], "place_id string"),
        details=make([("p1", "g1"), ("p2", "g2"), ("p3", "g3")], "place_id string, google_url string"),
        listings=make([("g1", listing.format(f"{SITE}/menu?x=1")), ("g2", listing.format(f"{SITE}/start")), ("g3", "<p>none</p>")], "google_url string, html string"),
        pages=make([*pages.items(), (f"{SITE}/menu/empty", None)], "url string, html string"),
        responses=make([(u, kind, 0, text) for (u, kind), text in answers.items()], "url string, content_type string, n int, text string"),
        pdf_pages=make([(f"{SITE}/menu/card.pdf", 1, "card"), (f"{SITE}/menu/soups", 1, "soup sheet")], "url string, page_no int, text string"),
        # Two addresses of one page, a redirected root, a cycle, and one that leads to nothing.
        redirects=make([(f"{SITE}/menu/old", f"{SITE}/menu/new"), (f"{SITE}/menu/old2", f"{SITE}/menu/new/"), (f"{SITE}/start", f"{SITE}/menu"), (f"{SITE}/menu/home", f"{SITE}/gone")], "url string, final_url string"),
        rules=make([("a.example", "*", 1, False, "/menu/secret"), ("a.example", "*", 2, False, "/menu/ol")], "domain string, agent string, rule_no int, allow boolean, prefix string"),
    )


def embed(phrases):
    from trawlwork.functions.vectors import trigram_embedding

    return trigram_embedding(phrases)


def profile(spark):
    return load_profile(spark, {"name": ["soup"], "ingredient_1": ["beet", "carrot"]})


BOOK = {"bread", "soup", "beet soup", "pie", "cake", "card dish"}


def test_run(spark, crawl, tmp_path):
    run = run_establishments(crawl, profile(spark), relevance_threshold=None)
    rows = run.results.collect()
    by_site = {}
    for r in rows:
        by_site.setdefault((r.google_url, r.establishment_url), []).append(r.scraped_item)
    # Allowed, redirected and PDF pages are there; disallowed, failed and missing ones, and what lies below them, are not.
    assert set(by_site[("'g1'", f"'{SITE}/menu?x=1'")]) == BOOK
    assert sorted(by_site[("'g2'", f"'{SITE}/start'")]) == sorted([*BOOK, *BOOK])  # found twice, rows twice
    assert {r.place_id for r in run.dropped.collect()} == {"p3", "p4"}
    assert {r.scraped_item: r.ingredients for r in rows}["soup"] == "beet, salt"
    forest = run.forest.collect()
    assert {r.place_id for r in forest} == {"p1", "p2"}
    first = {r.descriptor: r for r in forest if r.place_id == "p1"}
    assert first[f"{SITE}/menu/old"].url == first[f"{SITE}/menu/old2"].url == first[f"{SITE}/menu/new"].url == f"{SITE}/menu/new"
    # The first request that ends there has the page's items and children, although robots would not let it in.
    assert set(first[f"{SITE}/menu/old"].menu_book) == {"pie", "cake"} and not first[f"{SITE}/menu/new"].scraped_items
    assert first[f"{SITE}/menu/new/cake"].parent_url == f"{SITE}/menu/new" and first[f"{SITE}/menu/new/cake"].parent_path == first[f"{SITE}/menu/old"].path
    assert not first[f"{SITE}/menu/secret"].menu_book and f"{SITE}/menu/secret/deep" not in first
    assert not first[f"{SITE}/menu/broken/below"].scraped_items and not first[f"{SITE}/menu/missing"].scraped_items
    second = {r.descriptor: r for r in forest if r.place_id == "p2"}
    # The redirected root stands under the address it ended at, and comes again below itself without items.
    assert second[f"{SITE}/start"].url == f"{SITE}/menu" and set(second[f"{SITE}/start"].menu_book) == BOOK
    assert second[f"{SITE}/menu"].depth == 2 and not second[f"{SITE}/menu"].scraped_items
    status = {(r.fetched, r.has_content): r["count"] for r in run.nodes.filter(f"root = '{SITE}/menu'").groupBy("fetched", "has_content").count().collect()}
    assert status == {(True, True): 9, (False, False): 2, (True, False): 1}


def test_caches_and_forest_of_the_next_run(spark, crawl, tmp_path):
    kinds = {"vectors": "array<float>", "relevance": "double", "items": ITEMS}

    def caches():
        return RunCaches(**{n: KeyedTable(spark, str(tmp_path / n), k, buckets=4) for n, k in kinds.items()})

    old = read_site_trees(spark, str(tmp_path / "none"))
    first = run_establishments(crawl, profile(spark), caches(), old)
    ranked = sorted(map(str, first.results.collect()))
    assert len(ranked) == 3 * len(BOOK)
    versions = {n: KeyedTable(spark, str(tmp_path / n), k, buckets=4).version()[0] for n, k in kinds.items()}
    assert versions == {"vectors": 1, "relevance": 1, "items": 1}
    write_site_trees(first.forest, str(tmp_path / "forest"))
    # The next run extracts, scores and embeds nothing: without responses its rows are the same.
    later = StoredCrawl(crawl.places.filter("place_id = 'p1'"), crawl.details, crawl.listings, crawl.pages, crawl.responses.filter("n > 99"), crawl.pdf_pages, crawl.redirects, crawl.rules)

    def fails(phrases):
        raise AssertionError(phrases)

    second = run_establishments(later, profile(spark), caches(), read_site_trees(spark, str(tmp_path / "forest")), embed=fails)
    assert {str(r) for r in second.results.collect()} == {r for r in ranked if "'g1'" in r}
    known = {n: KeyedTable(spark, str(tmp_path / n), k, buckets=4).version()[0] for n, k in kinds.items()}
    assert known["vectors"] == 1 and known["relevance"] == 1 and known["items"] <= 2
    assert {r.place_id for r in second.forest.select("place_id").distinct().collect()} == {"p1", "p2"}
    export_nested_trees(second.forest, str(tmp_path / "nested"))
    assert read_site_trees(spark, str(tmp_path / "nested")).count() == second.forest.count()
