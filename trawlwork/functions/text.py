"""Text expressions: markup to text, links in markup, responses, n-grams and token chunks."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawlwork.functions.urls import SPACE, let, strip
from trawlwork.settings import MAX_NGRAM

# A noncharacter: it cannot occur in exchanged text, so it marks where a tag stood.
_MARK = "\uffff"

# What may follow a '<'. First the parts of a page that hold neither text nor links: comments, script and style
# bodies, declarations. A template's body holds no text, but its links count.
_DEAD = (
    r"!--[\s\S]*?(?:--!?>|\z)"
    r"|script\b[\s\S]*?(?:</script[^>]*>|\z)"
    r"|style\b[\s\S]*?(?:</style[^>]*>|\z)"
    r"|[!?][^>]*>"
)
_OPAQUE = rf"{_DEAD}|template\b[\s\S]*?(?:</template[^>]*>|\z)"
# Attributes of a tag, any number; a '>' inside quotes does not end it. Atomic groups keep the match linear, and the
# possessive repetition is a loop in the matcher, not a stack.
_ATTRIBUTES = r"""(?>[^>=]*(?:=\s*(?>"[^"]*"|'[^']*'|)[^>=]*)*+)"""
_TAG = rf"/?[a-z]{_ATTRIBUTES}>|/?[a-z][^>]*>"
_ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_ATTRIBUTE_ENTITY = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)"
# Names that HTML knows without a semicolon.
_OPEN_NAMES = sorted(name for name in html5 if not name.endswith(";"))
_ENTITY = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*)"


@lru_cache(maxsize=1)
def _entity_table() -> str:
    """``name=text`` entries: all names of the standard library's HTML 5 table, and 128-159 as Windows-1252.

    Short names come first: they are the frequent ones, the lookup is a scan.
    """
    table = {name.rstrip(";"): text for name, text in html5.items()}
    for code in range(128, 160):
        text = bytes([code]).decode("cp1252", errors="ignore")
        if text:
            table[f"#{code}"] = text
    names = sorted(table, key=lambda name: (len(name), name))
    return "\u0002".join(f"{name}\u0003{table[name]}" for name in names)


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Replace character references.

    Text: a name counts with or without its semicolon, an unknown name stays without it. Attribute values: a name without a
    semicolon counts only if HTML allows that for it and no ``=`` follows, so that ``?x=1&lang=en`` stays a query; whatever does
    not count stays as it is.
    """
    # One string literal, folded to a map when the plan is optimized.
    table = F.str_to_map(F.lit(_entity_table()), F.lit("\u0002"), F.lit("\u0003"))

    def decode_number(token: Column) -> Column:
        digits = F.regexp_replace(token, "^#[xX]?0*(?=[0-9a-fA-F])", "")
        # More than 12 digits after leading zeros are no character in either base.
        code = F.when(F.length(digits) > 12, F.lit(None)).when(F.lower(token).startswith("#x"), F.conv(digits, 16, 10)).otherwise(digits)
        return let(
            code.try_cast("bigint"),
            lambda c: F.coalesce(
                F.try_element_at(table, F.concat(F.lit("#"), c.cast("string"))),
                F.when(
                    c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF),
                    F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"),
                ),
                F.lit("\ufffd"),
            ),
        )

    def decode_piece(piece: Column) -> Column:
        def in_attribute(token: Column) -> Column:
            rest = F.substr(piece, F.length(token) + 1)
            bare = token.isin(_OPEN_NAMES) & ~rest.startswith("=")
            named = F.when(rest.startswith(";") | bare, F.try_element_at(table, token))
            decoded = F.when(token.startswith("#"), decode_number(token)).otherwise(named)
            whole = F.concat(decoded, F.when(rest.startswith(";"), F.substr(rest, F.lit(2))).otherwise(rest))
            return F.coalesce(F.when(token != "", whole), F.concat(F.lit("&"), piece))

        def with_token(token: Column) -> Column:
            decoded = F.when(token.startswith("#"), decode_number(token)).otherwise(
                F.coalesce(F.try_element_at(table, token), F.concat(F.lit("&"), token))
            )
            rest = F.substr(piece, F.length(token) + 1)
            return F.when(token == "", F.concat(F.lit("&"), piece)).otherwise(
                F.concat(decoded, F.when(rest.startswith(";"), F.substr(rest, F.lit(2))).otherwise(rest))
            )

        if attribute:
            return let(F.regexp_extract(piece, _ATTRIBUTE_ENTITY, 1), in_attribute)
        return let(F.regexp_extract(piece, _ENTITY, 1), with_token)

    def decode(whole: Column) -> Column:
        decoded = let(
            F.split(whole, "&"),
            lambda pieces: F.concat(
                pieces[0],
                F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode_piece), ""),
            ),
        )
        return F.when(whole.contains("&"), decoded).otherwise(whole)

    return let(text, decode)


def html_to_text(html: Column) -> Column:
    """Text nodes of a page, each stripped, empty ones dropped, joined with one space.

    The title counts as text; comments, declarations, script, style and template bodies do not.
    """
    marked = F.regexp_replace(html, f"(?i)<(?:{_OPAQUE}|{_TAG})", _MARK)
    nodes = F.transform(F.split(decode_entities(marked), _MARK), strip)
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def anchor_attributes(html: Column) -> Column:
    """Attribute text of every ``<a>`` tag outside comments, scripts and styles, in page order."""
    visible = F.regexp_replace(html, f"(?i)<(?:{_DEAD})", " ")
    return F.regexp_extract_all(visible, F.lit(rf"(?i)<a([\s/]{_ATTRIBUTES})>"), F.lit(1))


def raw_attribute(attributes: Column, name: str) -> Column:
    """Value of one attribute of a tag as written, without its quotes; null when absent."""
    pairs = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(0))
    mine = F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)) == F.lit(name))
    value = F.regexp_replace(F.try_element_at(mine, F.lit(-1)), r"^[^\s=]+(?:\s*=\s*)?", "")
    return F.regexp_replace(value, r"""^(["'])([\s\S]*)\1\z""", "$2")


def attribute_value(attributes: Column, name: str) -> Column:
    """Value of one attribute of a tag: quotes removed, entities decoded, null when absent."""
    return decode_entities(raw_attribute(attributes, name), attribute=True)


def fill_prompt(template: str, text: Column) -> Column:
    """``template`` with its single ``{}`` slot filled."""
    head, tail = template.split("{}")
    return F.concat(F.lit(head), text, F.lit(tail))


def clean_response(response: Column) -> Column:
    """Remove code-fence markers, output-tagged ones first, then strip."""
    text = response
    for marker in ("```output\n", "```output", "\n```", "```"):
        text = F.replace(text, F.lit(marker), F.lit(""))
    return strip(text)


def normalize_phrase(phrase: Column) -> Column:
    return strip(F.lower(phrase))


def words(text: Column) -> Column:
    """Whitespace-separated words of a text; no words for a blank text."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def word_ngrams(texts: Column, max_n: int = MAX_NGRAM) -> Column:
    """All 1..``max_n`` word grams of each text, ordered by text, then length, then start.

    No gram crosses two texts; duplicates stay.
    """

    def longer(tokens: Column, shorter: Column, n: int) -> Column:
        """Grams of ``n`` words and more: each gram one word shorter, with the word that follows it."""
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(shorter, F.lit(1), count),
            F.slice(tokens, F.lit(n), count),
            lambda gram, word: F.concat(gram, F.lit(" "), word),
        )
        return grams if n == max_n else let(grams, lambda g: F.concat(g, longer(tokens, g, n + 1)))

    def grams_of(tokens: Column) -> Column:
        return tokens if max_n == 1 else F.concat(tokens, longer(tokens, tokens, 2))

    tokenized = F.transform(texts, lambda t: words(F.lower(t)))
    return F.flatten(F.transform(tokenized, grams_of))


def token_counts(text: Column) -> Column:
    """Number of whitespace tokens. Pass a ``pandas_udf`` to the operators for another tokenizer."""
    return F.size(words(text))


def chunk_tokens(text: Column, limit: int) -> Column:
    """Consecutive chunks of at most ``limit`` tokens; a blank text has none."""
    def chunks_of(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(limit))
        chunks = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(limit)), " "))
        return F.when(n > 0, chunks).otherwise(F.slice(tokens, 1, 0))

    # The one-element array binds the token list, so that it is built once per text and not per chunk.
    return F.flatten(F.transform(F.array(words(text)), chunks_of))
