"""URL expressions. Every function maps Columns to a Column and stays inside the JVM.

One regular expression splits a URL (RFC 3986, appendix B, plus the ``;params`` of the last path
segment). ``parse_url`` is not used: it rejects spaces and pipes, which real links contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits one URL into scheme, netloc, path, params, query and fragment in a single match.
URL_REGEX = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^/?#;]*)(?:;([^/?#]*))?(?:\?([^#]*))?(?:#([\s\S]*))?\z"
)
_SEP = "\u0001"
_PART_NAMES = ("scheme", "netloc", "host", "port", "path", "params", "query", "fragment")
# Whitespace as text tools define it (Spark's ``trim`` alone removes spaces only).
_BLANKS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_BLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends. The costly trim runs only where an end is blank."""
    blanks = F.lit(_BLANKS)

    def trim(t: Column) -> Column:
        blank_end = (F.position(F.left(t, F.lit(1)), blanks) > 0) | (F.position(F.right(t, F.lit(1)), blanks) > 0)
        return F.when(blank_end, F.btrim(t, blanks)).otherwise(t)

    return let(text, trim)


def url_parts(url: Column) -> Column:
    """``struct<scheme, netloc, host, port, path, params, query, fragment>``.

    The scheme is lower-cased and the netloc keeps its case. Absent parts are empty strings; a missing
    host or port is null.
    """
    clean = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    split = F.split(F.regexp_replace(clean, URL_REGEX, _SEP.join(f"${i}" for i in range(1, 7))), _SEP)

    def named(bits: Column) -> Column:
        address = F.regexp_extract(bits[1], r"([^@]*)\z", 1)
        host = F.lower(F.regexp_extract(address, r"^\[?((?<=\[)[^\]]*|[^:\[]*)", 1))
        return F.struct(
            F.lower(bits[0]).alias("scheme"),
            bits[1].alias("netloc"),
            F.nullif(host, F.lit("")).alias("host"),
            # Nine digits always fit; casting '' would throw (and catch) an exception per row.
            let(
                F.regexp_extract(address, r":([0-9]{1,9})\z", 1), lambda digits: F.when(digits != "", digits.cast("int"))
            ).alias("port"),
            bits[2].alias("path"),
            bits[3].alias("params"),
            bits[4].alias("query"),
            bits[5].alias("fragment"),
        )

    return let(split, named)


def url_domain(url: Column) -> Column:
    """The netloc as written (user info, port and case kept)."""
    return url_parts(url)["netloc"]


def is_valid_url(url: Column) -> Column:
    """True when the URL has both a scheme and a netloc."""
    return F.coalesce(let(url_parts(url), lambda p: (p["scheme"] != "") & (p["netloc"] != "")), F.lit(False))


def _form_decode(text: Column) -> Column:
    # A percent sign without two hex digits stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(text: Column) -> Column:
    # Form encoding leaves '~' alone and escapes '*'; the JVM encoder does the opposite.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _canonical_query(query: Column) -> Column:
    """Drop blank-valued pairs, decode, sort by (name, value) and encode again."""
    valued = F.filter(F.split(query, "&"), lambda pair: pair.rlike(r"^[^=]*=[\s\S]"))
    pairs = F.transform(
        valued,
        lambda pair: F.struct(
            _form_decode(F.substring_index(pair, "=", 1)).alias("name"),
            _form_decode(F.regexp_replace(pair, r"^[^=]*=", "")).alias("value"),
        ),
    )
    encoded = F.transform(
        F.array_sort(pairs),
        lambda p: F.concat(_form_encode(p["name"]), F.lit("="), _form_encode(p["value"])),
    )
    return F.array_join(encoded, "&")


def canonical_url(url: Column) -> Column:
    """Canonical form: lower-case scheme and host, no user info, ``;params`` or fragment, sorted query.

    An explicit port is kept, also a default one; port 0 is dropped. A URL without a host gives null.
    """

    def build(p: Column) -> Column:
        query = F.when(p["query"] == "", F.lit("")).otherwise(_canonical_query(p["query"]))
        return F.when(
            p["host"].isNotNull(),
            F.concat(
                F.when(p["scheme"] == "", F.lit("")).otherwise(F.concat(p["scheme"], F.lit(":"))),
                F.lit("//"),
                p["host"],
                F.when(p["port"] > 0, F.concat(F.lit(":"), p["port"].cast("string"))).otherwise(F.lit("")),
                F.when(p["path"].startswith("/"), p["path"]).otherwise(F.concat(F.lit("/"), p["path"])),
                let(query, lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q))),
            ),
        )

    return let(url_parts(url), build)


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path; inner empty segments go, as in a relative-reference merge."""

    def shorter(done: Column) -> Column:
        return F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))

    def resolve(segs: Column) -> Column:
        last = F.element_at(segs, -1)
        kept = F.aggregate(
            F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 2, F.lit(0))),
            F.slice(segs, 1, 0),
            lambda done, seg: F.when((seg == "") | (seg == "."), done)
            .when(seg == "..", shorter(done))
            .otherwise(F.array_append(done, seg)),
        )
        tail = let(
            kept,
            lambda k: F.when(last == ".", F.array_append(k, F.lit("")))
            .when(last == "..", F.array_append(shorter(k), F.lit("")))
            .otherwise(F.array_append(k, last)),
        )
        return F.concat(F.lit("/"), F.array_join(tail, "/"))

    return let(F.split(path, "/"), resolve)


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text == "", text).otherwise(F.concat(F.lit(mark), text))


def resolve_links(base: Column, hrefs: Column) -> Column:
    """Absolute forms of the references ``hrefs`` found on the page ``base``; the base is split once.

    Covers absolute, scheme-relative, root-relative, relative, query-only, fragment-only and
    dot-segment references. References of another scheme come back unchanged.
    """

    def merge(b: Column, h: Column) -> Column:
        """``struct<netloc, path, params, query>`` of a reference within the base's scheme."""
        bare = (h["path"] == "") & (h["params"] == "")
        directory = F.regexp_replace(b["path"], r"[^/]*\z", "")
        merged = F.when(h["path"].startswith("/"), h["path"]).otherwise(
            F.concat(F.when(directory == "", F.lit("/")).otherwise(directory), h["path"])
        )
        # The fold over segments runs only for paths that need it.
        clean = let(merged, lambda m: F.when(m.rlike(r"/\.|//"), _remove_dot_segments(m)).otherwise(m))
        own = h["netloc"] != ""
        return F.struct(
            F.when(own, h["netloc"]).otherwise(b["netloc"]).alias("netloc"),
            F.when(own, h["path"]).when(bare, b["path"]).otherwise(clean).alias("path"),
            F.when(~own & bare, b["params"]).otherwise(h["params"]).alias("params"),
            F.when(~own & bare & (h["query"] == ""), b["query"]).otherwise(h["query"]).alias("query"),
        )

    def build(b: Column, h: Column) -> Column:
        hierarchical = h["scheme"].rlike("^(https?|ftp|file)?$")
        same_scheme = (h["scheme"] == "") | (h["scheme"] == b["scheme"])
        joined = let(
            merge(b, h),
            lambda m: F.concat(
                b["scheme"],
                F.lit("://"),
                m["netloc"],
                F.when(m["path"].startswith("/"), m["path"]).otherwise(_prefixed("/", m["path"])),
                _prefixed(";", m["params"]),
                _prefixed("?", m["query"]),
                _prefixed("#", h["fragment"]),
            ),
        )
        return F.when(same_scheme & hierarchical, joined).otherwise(h["whole"])

    def with_base(b: Column) -> Column:
        def one(href: Column) -> Column:
            parts = let(
                url_parts(href), lambda p: F.struct(*[p[f].alias(f) for f in _PART_NAMES], href.alias("whole"))
            )
            resolved = let(parts, lambda h: build(b["parts"], h))
            return F.when(href == "", b["url"]).when(b["url"] == "", href).otherwise(resolved)

        return F.transform(hrefs, one)

    return let(F.struct(F.coalesce(base, F.lit("")).alias("url"), url_parts(base).alias("parts")), with_base)


def resolve_link(base: Column, href: Column) -> Column:
    """:func:`resolve_links` for one reference."""
    return F.element_at(resolve_links(base, F.array(F.coalesce(href, F.lit("")))), 1)


def same_site(base: Column, links: Column) -> Column:
    """The links with the netloc of ``base`` (exact case) and a path."""
    return let(
        url_domain(base),
        lambda domain: F.filter(
            links, lambda link: let(url_parts(link), lambda p: (p["netloc"] == domain) & (p["path"] != ""))
        ),
    )


def crawl_key_url(url: Column, base: Column | None = None) -> Column:
    """Key of a page inside a crawl: ``scheme://netloc/path`` without query, fragment and end slashes."""
    trimmed = strip(url)
    whole = let(
        url_parts(trimmed if base is None else resolve_link(base, trimmed)),
        lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"]),
    )
    return F.regexp_replace(whole, r"(?<!/)/+\z", "")


def path_has_repeat(path: Column) -> Column:
    """True when any run of segments occurs twice.

    A longer repeated run repeats its first segment too, so looking at single segments is enough.
    """
    segments = F.split(F.btrim(path, F.lit("/")), "/")
    return let(segments, lambda segs: F.size(F.array_distinct(segs)) < F.size(segs))


def content_route(url: Column) -> Column:
    """``'pdf'`` when the URL ends in ``.pdf`` (any case), else ``'html'``; null counts as html."""
    return F.when(F.lower(url).endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("html"))


def url_segments(url: Column) -> Column:
    """Words of a URL: path parts, query pairs and fragment pairs, each split on ``.``, ``_`` and ``-``.

    Empty pieces go before trimming, nothing is percent-decoded, order and duplicates stay.
    """
    components = let(
        url_parts(url),
        lambda p: F.concat(F.split(p["path"], "/"), F.split(p["query"], "&"), F.split(p["fragment"], "&")),
    )
    pieces = F.flatten(F.transform(components, lambda c: F.split(c, "[._-]")))
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: strip(F.lower(p)))
