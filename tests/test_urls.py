from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlwork.functions import urls as U

URLS = [
    "HTTP://User:pw@EXAMPLE.com:8080/a/b;v=1?b=2&a=x+y&e=&c=%7E*%zz%20#f&g",
    "https://h.example/",
    "https://h.example",
    "http://h:80/x",
    "http://h:0/x",
    "http://[::1]:80/x",
    "//h/x",
    "mailto:a@b",
    "http://h/a b|c?q#",
    "/rel/./x/../y",
    "x.pdf?x=1",
    "http://h/a;p/b;q",
    "http://h/?=v&a=1&a=0&b",
    "",
]

word = st.text("abAB.~*+%é;=", max_size=5)
urls = st.builds(
    lambda scheme, host, path, query, fragment: f"{scheme}://{host}{path}{query}{fragment}",
    st.sampled_from(["http", "HTTPS", "ftp"]),
    st.sampled_from(["h.example", "H.Example:8080", "u:p@h", "a-b.c:0"]),
    st.lists(word, max_size=4).map(lambda p: "".join("/" + x for x in p)),
    st.lists(st.tuples(word, word), max_size=3).map(lambda q: "?" + "&".join(f"{a}={b}" for a, b in q)),
    st.sampled_from(["", "#", "#x", "#a?b#c"]),
)
quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def expected_canonical(url):
    p = urlparse(url)
    if p.hostname is None:
        return None
    host = p.hostname + (f":{p.port}" if p.port else "")
    return urlunparse((p.scheme, host, p.path or "/", "", urlencode(sorted(parse_qsl(p.query))), ""))


def test_parts_match_the_standard_library(column):
    for url, row in zip(URLS, column(U.url_parts, URLS), strict=True):
        p = urlparse(url)
        assert (row.scheme, row.netloc, row.path, row.params, row.query, row.fragment) == tuple(p), url
        assert (row.host, row.port) == (p.hostname, p.port), url


def test_canonical_known(column):
    assert column(U.canonical_url, URLS) == [expected_canonical(u) for u in URLS]


@quick
@given(st.lists(urls, min_size=80, max_size=80))
def test_canonical_matches_and_is_idempotent(column, many):
    once = column(U.canonical_url, many)
    assert once == [expected_canonical(u) for u in many]
    assert column(U.canonical_url, once) == once


BASES = [
    "http://h.example/a/b/c?x=1#f",
    "https://H.example:8/",
    "http://h.example",
    "http://h.example/a//b/./c/",
    "http://h/d;p?q",
]
HREFS = (
    " g ./g g/ /g //g ?y g?y #s g#s ;x g;x . ./ .. ../ ../g ../.. ../../g ../../../g /./g /../g g. ..g ./../g g/./h"
    " g/../h http:g mailto:x javascript:void(0) https://o.example/x/../y a//b //o/x/../y"
).split(" ")


def test_resolve_link_matches_urljoin(column):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = column(U.resolve_link, pairs, "b string, h string")
    assert [(p, g) for p, g in zip(pairs, got, strict=True) if g != urljoin(*p)] == []


def test_crawl_key(column):
    cases = [
        (" http://H.example/a/b//?q#f ", "http://H.example/a/b"),
        ("https://h.example/", "https://h.example"),
        ("http://u@h:80/x;p?q", "http://u@h:80/x"),
    ]
    keys = column(U.crawl_key_url, [c for c, _ in cases])
    assert keys == [k for _, k in cases]
    assert column(U.crawl_key_url, keys) == keys
    assert column(lambda u, b: U.crawl_key_url(u, b), [("../x?y", "http://h/a/b/c")], "u string, b string") == ["http://h/a/x"]


def repeats_by_windows(path, longest=10):
    """The definition: some run of 1..min(10, n/2) segments occurs twice."""
    segs = path.strip("/").split("/") if path.strip("/") else []
    for size in range(1, min(longest, len(segs) // 2) + 1):
        runs = [tuple(segs[i : i + size]) for i in range(len(segs) - size + 1)]
        if len(set(runs)) < len(runs):
            return True
    return False


@quick
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "", "d"]), max_size=7).map("/".join), min_size=120, max_size=120))
def test_path_repeat_equals_the_window_definition(column, paths):
    assert column(U.path_has_repeat, paths) == [repeats_by_windows(p) for p in paths]


def test_route_validity_segments(column):
    assert column(U.content_route, ["http://h/a.PDF", "http://h/a.pdf?x=1", "x", None]) == ["pdf", "html", "html", "html"]
    assert column(U.is_valid_url, ["http://h", "//h/x", "mailto:a@b", "h/x", None]) == [True, False, False, False, False]
    assert column(U.url_segments, ["http://h/Menu-a_b.html?page=2&x.y#To p&q", "http://h"]) == [
        ["menu", "a", "b", "html", "page=2", "x", "y", "to p", "q"],
        [],
    ]


def test_vocabulary_keeps_keywords_whole(spark):
    from trawlwork.operators.relevance import segment_vocabulary

    urls = spark.createDataFrame([("http://h/happy-hour",), ("http://h/happy",)], "url string")
    words = {r.segment for r in segment_vocabulary(urls, ["happy-hour"]).collect()}
    assert words == {"happy", "hour", "happy-hour"}


def test_strip_removes_unicode_blanks(column):
    assert column(U.strip, ["　 a b\t \x85", "\n", "x"]) == ["a b", "", "x"]
    assert column(lambda v: F.length(U.strip(v)), [" " * 100_000 + "x" + " " * 100_000]) == [1]
