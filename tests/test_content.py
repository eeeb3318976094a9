import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawlwork.functions import text as X
from trawlwork.operators import content as K

PAGES = {
    "<p>a&nbsp;</p> <b>x</b>y &lt;i&gt; &#8217;&#x41;&#150; &amp;lt;": "a x y <i> ’A– &lt;",
    '<!DOCTYPE html><title>T</title><script>if(a<b)"</p>"</script><style>p{}</style>z<!-- c > -->w': "T z w",
    '<a title="x>y" href=z>q</a> 1 < 2 & 3': "q 1 < 2 & 3",
    "a<br/>b<template><p>t</p></template>c": "a b c",
    "&eacute;&Eacute;&copy 2020": "éÉ© 2020",
    "<STYLE>x": "",
    "no tags": "no tags",
    "": "",
}


def test_html_to_text(column):
    assert column(X.html_to_text, list(PAGES)) == list(PAGES.values())


def test_entities(column):
    cases = {"&foo; &amp &#1114112; &#0; &#xD800; & &;": "&foo & � � � & &;", "&apos;&hellip;": "'…"}
    assert column(X.decode_entities, list(cases)) == list(cases.values())


def test_odd_markup_stays_linear(column):
    many = "<a " + "x=1 " * 50_000 + "> y"
    assert column(X.html_to_text, [many, "<a " * 2000, "=" * 200_000]) == ["y", ("<a " * 2000).strip(), "=" * 200_000]


def test_links(spark):
    html = (
        '<a href="/x">1</a><A HREF=\'y?b=1&amp;c=2\'>2</a><a id=q href=/x#t>3</a><a href="//other/x">4</a>'
        '<a href="mailto:a@b">5</a><abbr href="/no">6</abbr><!--<a href="/no">--><a data-href="/no">7</a><a href="/x">8</a>'
    )
    pages = spark.createDataFrame([("http://h.example/d/p.html", html)], "url string, html string")
    found = {(r.link, r.position) for r in K.extract_links(pages).collect()}
    assert found == {
        ("http://h.example/x", 0),
        ("http://h.example/d/y?b=1&c=2", 1),
        ("http://h.example/x#t", 2),
    }


def test_menu_link(column):
    menu = '<a data-item-id="menu" data-tooltip="Open menu link" href="{}">'
    site = "<a href='http://s' data-tooltip='Open website' data-item-id=authority>"
    pages = [
        site + menu.format("http://m?a&amp;b"),
        site,
        menu.format("") + menu.format("http://m2") + site,
        "<a href=x data-item-id=menu>",
        "",
    ]
    assert column(K.find_menu_link, pages) == ["http://m?a&b", "http://s", "http://s", None, None]


def test_document_text(spark):
    rows = [("d", 2, "b"), ("d", 1, "a"), ("d", 3, ""), ("d", 4, None), ("d", 11, "z"), ("e", 1, None)]
    pages = spark.createDataFrame(rows, "url string, page_no int, text string")
    parts = K.pages_to_document_text(pages, "url", "page_no", pages_per_part=10).orderBy("part_no").collect()
    assert [(r.url, r.part_no, r.text) for r in parts] == [("d", 0, "ab"), ("d", 1, "z")]


def test_long_document_text_is_whole(spark, tmp_path):
    from trawlwork import queries

    pages = [(1, n, "user", f"{n},") for n in range(2500)] + [(2, 1000, "user", "a"), (2, 999, "user", "b")]
    table = spark.createDataFrame(pages, "conv_id long, turn int, role string, text string")
    want = {1: "".join(f"{n}," for n in range(2500)), 2: "ba"}
    out = K.pages_to_document_text(table, "conv_id", "turn").collect()
    assert sorted((r.conv_id, r.part_no, r.text) for r in out) == [(i, 0, t) for i, t in want.items()]
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "http://a", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = [(r.id, r.text) for r in queries.dispatch_content(spark, str(tmp_path)).collect() if r.id.startswith("conv")]
    assert sorted(found) == [(f"conv-{i}", t) for i, t in want.items()]


def test_dispatch(column):
    rows = [("html", "<p>a</p>", "b"), ("pdf", "<p>a</p>", "b"), ("png", "x", "y"), ("pdf", "x", None)]
    assert column(K.dispatch_content, rows, "t string, h string, p string") == ["a", "b", None, None]


def test_prompt_has_text_in_its_slot(column):
    assert column(lambda t: X.fill_prompt("a {} b", t), ["{x}"]) == ["a {x} b"]


def test_tokens_and_chunks(column):
    assert column(X.token_counts, [" a b\n", "", " "]) == [2, 0, 0]
    assert column(lambda t: X.chunk_tokens(t, 2), ["a b c d e", " ", "a b"]) == [["a b", "c d", "e"], [], ["a b"]]


def greedy(sizes, limit):
    """Batch numbers of an ordered packing, by the definition."""
    out, batch, used, filled = [], 0, 0, False
    for size in sizes:
        if filled and used + size > limit:
            batch, used = batch + 1, 0
        used, filled = used + size, True
        out.append(batch)
    return out


def test_packing(spark):
    counts = [3, 4, 3, 0, 12, 1, 10, 10, 0, 5, 25, 5]
    texts = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(counts)], "id bigint, text string")
    packed = K.token_budget_batches(texts, "id", limit=10, shard=F.lit(0)).orderBy("id", "chunk_no").collect()
    sizes = [s for n in counts for s in ([10] * (n // 10) + ([n % 10] if n % 10 or not n else []))]
    assert [r.batch_no for r in packed] == greedy(sizes, 10)
    totals = {}
    for row, size in zip(packed, sizes, strict=True):
        totals[row.batch_no] = totals.get(row.batch_no, 0) + size
    assert max(totals.values()) <= 10
    assert K.token_budget_batches(texts, "id", limit=10).orderBy("id", "chunk_no").collect() == packed  # one run over all texts
    assert K.token_budget_batches(texts.limit(0), "id").count() == 0


def test_packing_by_ranges(spark):
    """Cut into ranges anywhere, the batches are those of the greedy loop; shards begin anew wherever they begin."""
    rng = np.random.default_rng(4)
    counts = [int(n) for n in rng.choice([0, 0, 1, 2, 3, 5, 8, 11, 24], 400)]
    texts = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(counts)], "id bigint, text string").repartition(5)
    entries = [(i, s) for i, n in enumerate(counts) for s in ([10] * (n // 10) + ([n % 10] if n % 10 or not n else []))]
    for part_rows in (9, 60):
        packed = K.token_budget_batches(texts, "id", limit=10, part_rows=part_rows).orderBy("id", "chunk_no").collect()
        assert [r.batch_no for r in packed] == greedy([s for _, s in entries], 10)
        sharded = K.token_budget_batches(texts, "id", limit=10, shard=F.floor(F.col("id") / 37), part_rows=part_rows).orderBy("id", "chunk_no").collect()
        want = [b for shard in range(11) for b in greedy([s for i, s in entries if i // 37 == shard], 10)]
        assert [r.batch_no for r in sharded] == want


def test_packing_of_one_key(spark):
    """A key that nearly all rows have is cut into ranges too; null keys come first."""
    rows = [(7, "w w w")] * 200 + [(None, "w w")] * 5 + [(9, "w")]
    packed = K.token_budget_batches(spark.createDataFrame(rows, "id bigint, text string"), "id", limit=10, part_rows=20).collect()
    assert len(packed) == 206 and sorted(r.batch_no for r in packed) == greedy([2] * 5 + [3] * 200 + [1], 10)


def test_range_steps_equal_the_loop():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n, limit = int(rng.integers(1, 12)), 10
        sizes = rng.integers(0, 11, n)
        shards = np.sort(rng.integers(0, 2, n)) if rng.random() < 0.3 else np.zeros(n, dtype=int)
        steps = K.range_steps(pd.DataFrame({"part": 3, "shard": shards, "n": sizes}), limit)
        for fill in range(limit + 2):
            full, opened, now = fill, 0, shards[0]
            for size, shard in zip(sizes, shards, strict=True):
                if shard != now:
                    full, opened, now = limit + 1, 0, shard
                if full + size > limit:
                    full, opened = 0, opened + 1
                full += size
            step = steps[steps["least"] <= fill].iloc[-1]
            assert (step["fill"], step["opened"]) == (full, opened)


def test_responses(spark):
    rows = [("u", 0, "First"), ("u", 1, "LAST"), ("v", None, None)]
    picked = K.pick_response(spark.createDataFrame(rows, "url string, n int, text string"), "url").collect()
    assert {r.url: r.response for r in picked} == {"u": "last", "v": ""}


@pytest.mark.parametrize(
    ("response", "items"),
    [
        ("```output\nsoup: water | salt\nbread:n/a\n```", {"soup": ["water", "salt"], "bread": []}),
        ("no menu items found", {}),
        ("item:", {"item": [""]}),
        (":a:b", {":a": ["b"]}),
        (":abc", {}),
        ("x: 1\n\nx :2|\ny:p:q", {"x": ["2", ""], "y": ["p:q"]}),
        ("", {}),
    ],
)
def test_item_lines(spark, response, items):
    df = spark.createDataFrame([("u", response)], "url string, response string")
    got = K.parse_item_lines(df, ["url"]).collect()
    assert {r.item: r.ingredients for r in got} == items and len(got) == len(items)


def test_fallback(spark):
    kind = "url string, items array<struct<item:string, ingredients:array<string>>>"
    pages = spark.createDataFrame(
        [("a", True, True), ("b", True, True), ("c.pdf", True, True), ("d", False, False), ("e", True, False)],
        "url string, has_html boolean, has_pdf boolean",
    )
    html = spark.createDataFrame([("a", [("h", [])]), ("b", []), ("c.pdf", [("h", [])]), ("e", [])], kind)
    pdf = spark.createDataFrame([("a", [("p", [])]), ("b", [("p", [])]), ("c.pdf", [("p", [])])], kind)
    got = {r.url: [i.item for i in r["items"]] for r in K.items_with_fallback(pages, html, pdf).collect()}
    assert got == {"a": ["h"], "b": ["p"], "c.pdf": ["p"], "e": []}


def test_redirects(spark):
    requests = spark.createDataFrame([("http://A/x#1",), ("http://a/y",), ("http://a/z",)], "url string")
    redirects = spark.createDataFrame([("http://a/x", "http://f/"), ("http://a/y", "http://g/")], "url string, final_url string")
    content = spark.createDataFrame([("http://f/", True), ("http://g/", False)], "url string, has_content boolean")
    got = {r.url: (r.final_url, r.hit) for r in K.resolve_redirects(requests, redirects, content).collect()}
    assert got == {"http://A/x#1": ("http://f/", True), "http://a/y": (None, False), "http://a/z": (None, False)}


def test_robots(spark):
    rules = spark.createDataFrame(
        [
            ("h", "*", 1, True, "/a/ok"),
            ("h", "*", 2, False, "/a"),
            ("h", "bot", 3, False, "/b"),
            ("n", "*", 1, False, "/"),
            ("maps.google.com", "*", 1, False, "/"),
            ("e", "*", 1, False, ""),
        ],
        "domain string, agent string, rule_no int, allow boolean, prefix string",
    )
    urls = {
        "http://h/a/ok/x": (True, True),
        "http://h/a/no": (False, True),
        "http://h/b": (True, False),
        "http://n": (False, False),
        "http://free/x": (True, True),
        "http://maps.google.com/x": (True, True),
        "http://e/x": (True, True),
    }
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    for i, agent in enumerate(("other", "Bot/2.0")):
        got = {r.url: r.allowed for r in K.robots_filter(pages, rules, agent).collect()}
        assert got == {u: v[i] for u, v in urls.items()}


def test_attribute_entities(column):
    cases = {
        "/x?page=1&lang=en&prod=5&part=2": "/x?page=1&lang=en&prod=5&part=2",
        "a&amp;b&ampx&amp=1&copy;&copy 1&foo;": "a&b&ampx&amp=1©© 1&foo;",
        "&check;&#0000000000000065;&#x00000000000000041;": "✓AA",
    }
    assert column(lambda c: X.decode_entities(c, attribute=True), list(cases)) == list(cases.values())
    assert column(X.decode_entities, ["&check;&comma;&#0000000000000065;&#99999999999999999999;"]) == ["✓,A�"]


def test_anchor_with_many_attributes(spark):
    many = "".join(f' data-{i}="v>{i}"' for i in range(5000))
    query = "&".join(f"k{i}={i}" for i in range(400))
    html = f'<a{many} href="/x">1</a><a href=/y?{query}>2</a><template><a href="/t">3</a></template><!--<a href="/no">-->'
    rows = K.extract_links(spark.createDataFrame([("http://h/", html)], "url string, html string")).collect()
    assert [r.link for r in sorted(rows, key=lambda r: r.position)] == ["http://h/x", f"http://h/y?{query}", "http://h/t"]


def test_robots_first_group_by_product(spark):
    rules = [("h", "bot", 1, False, "/a"), ("h", "trawler", 2, False, "/b"), ("h", "1.0", 3, False, "/c"), ("h", "*", 4, False, "/")]
    rules = spark.createDataFrame(rules, "domain string, agent string, rule_no int, allow boolean, prefix string")
    pages = spark.createDataFrame([(f"http://h/{p}",) for p in "abc"], "url string")
    got = {r.url[-1]: r.allowed for r in K.robots_filter(pages, rules, "trawlerbot/1.0").collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_robots_of_any_size(spark):
    """Very many rules on one domain, by path prefixes, decide as the first matching one in file order does."""
    rng = np.random.default_rng(12)
    rules = [("big.example", "*", i, bool(rng.random() < 0.5), f"/{'abc'[int(rng.integers(0, 3))]}{i % 977}{'/x' * int(rng.integers(0, 4))}") for i in range(20_000)]
    rules += [("small.example", "*", 1, False, "/a"), ("named.example", "*", 1, False, "*"), ("named.example", "Trawl", 5, True, "/b"), ("named.example", "trawl", 6, False, "/")]
    paths = [f"/{'abc'[int(rng.integers(0, 3))]}{int(rng.integers(0, 1100))}{'/x' * int(rng.integers(0, 5))}" for _ in range(300)]
    urls = [f"https://{d}.example{p}" for p in paths for d in ("big", "small", "named", "none")] + ["https://big.example", "https://maps.google.com/a"]
    df = spark.createDataFrame(rules, "domain string, agent string, rule_no int, allow boolean, prefix string")
    out = K.robots_filter(spark.createDataFrame([(u,) for u in urls], "url string"), df, "trawler/1.0")
    got = {r.url: r.allowed for r in out.collect()}

    def allowed(url):
        domain, _, path = url.removeprefix("https://").partition("/")
        mine = [r for r in rules if r[0] == domain]
        named = [r for r in mine if r[1].lower() != "*"]
        for _, _, _, allow, prefix in named or mine:
            if prefix == "*" or ("/" + path).startswith(prefix):
                return allow
        return True

    assert got == {u: "google.com" in u or allowed(u) for u in urls} and set(got.values()) == {True, False}
