"""Pages as trees of blocks: what the main-text model needs of HTML, no more."""

from __future__ import annotations

import html
import re
from functools import lru_cache

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comments
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)(?P<whole>>|\Z)"
    r"|<[!?/](?:[^>]*+)(?:>|\Z)",  # declarations and what is no tag
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML: elements without content, those whose content is no text of the page, and those that stand in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title svg math iframe object canvas audio video select datalist textarea button noframes".split())
RAW = frozenset("script style title textarea iframe noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var map picture".split()
)
#: What a new element of this kind ends, up to the nearest of the second list.
_ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_ENDS |= {t: ("tbody thead tfoot tr td th caption colgroup", "table") for t in ("tbody", "thead", "tfoot")}
_ENDS = {k: tuple(frozenset(x.split()) for x in v) for k, v in _ENDS.items()}
_IN_PARAGRAPH = frozenset({"p"})
_SCOPE = frozenset("table td th caption html body button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside each other, as browsers limit them too; what is nested deeper stands side by side.
DEEPEST = 256
CONTROLS = frozenset("input select textarea button".split())


@lru_cache(maxsize=1 << 14)
def attribute_tokens(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The lower-case words of class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value.lower() == "true"
        else:
            words += [w.lower() for w in _PART.findall(value)]
    return tuple(dict.fromkeys(words)), hidden


class Page:
    """Blocks and runs of text in page order: parent, tag (``#`` for text), attributes, place of each, and the runs' texts."""

    def __init__(self, source: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["body"]
        self.attributes: list[str] = [""]
        self.depth: list[int] = [0]
        self.last: list[int] = [0]  # one past the last node below
        self.text: list[str] = [""]
        self.linked: list[int] = [0]  # characters of a run that stand in links
        self.inner: list[int] = [0]  # tags in a line of a run
        self.controls: list[int] = [0]
        self.images: list[int] = [0]
        self._read(source or "")

    def _node(self, tag: str, attributes: str, parent: int) -> int:
        at = len(self.tag)
        for values, value in zip(
            (self.parent, self.tag, self.attributes, self.depth, self.last, self.text, self.linked, self.inner, self.controls, self.images),
            (parent, tag, attributes, self.depth[parent] + 1, at + 1, "", 0, 0, 0, 0),
            strict=True,
        ):
            values.append(value)
        return at

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("body", 0)]
        parts: list[str] = []
        links, in_links, inner, unseen = 0, 0, 0, 0
        at, size = 0, len(source)

        def flush() -> None:
            nonlocal in_links, inner
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    node = self._node("#", "", open_[-1][1])
                    self.text[node], self.linked[node], self.inner[node] = text, min(in_links, len(text)), inner
                parts.clear()
            in_links = inner = 0

        def close(down_to: int) -> None:
            flush()
            while len(open_) > down_to:
                self.last[open_.pop()[1]] = len(self.tag)

        def end_of(kinds: frozenset[str], stops: frozenset[str]) -> int | None:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in kinds:
                    return k
                if open_[k][0] in stops:
                    return None
            return None

        while at < size:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else size
            if stop > at and not unseen:
                piece = html.unescape(source[at:stop])
                parts.append(piece)
                if links:
                    in_links += len(piece.strip())
            if not m:
                break
            at = m.end()
            tag = m["tag"]
            if tag is None or not m["whole"]:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in UNSEEN:
                    unseen = max(0, unseen - 1)
                elif tag == "a":
                    links = 0
                elif tag == "p" or tag not in INLINE and tag not in VOID:
                    k = end_of(frozenset({tag}), _SCOPE if tag == "p" else frozenset())
                    if k is not None:
                        links = 0
                        close(k)
                    elif tag == "p":
                        flush()
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in CONTROLS:
                self.controls[open_[-1][1]] += 1
            if tag in UNSEEN:
                if tag in RAW:
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    at = found.start() if found else size
                    unseen += bool(found)  # its end tag comes next
                elif not m["attributes"].endswith("/"):
                    unseen += 1
                parts.append(" ")
                continue
            if unseen:
                # What can't stand in a head ends it, where its end tag was left out.
                if tag == "body":
                    unseen = 0
                else:
                    continue
            if tag in ("html", "body"):
                continue
            if tag in VOID:
                if tag == "br":
                    parts.append("\n")
                elif tag == "hr":
                    flush()
                elif tag == "img":
                    self.images[open_[-1][1]] += 1
                inner += 1
                continue
            if tag in INLINE:
                inner += 1
                links = links or tag == "a"
                continue
            if tag in _ENDS:
                while (k := end_of(*_ENDS[tag])) is not None:
                    close(k)
            elif (k := end_of(_IN_PARAGRAPH, _SCOPE)) is not None:
                close(k)
            flush()
            links = 0
            if len(open_) > DEEPEST:
                close(len(open_) - 1)
            open_.append((tag, self._node(tag, m["attributes"], open_[-1][1])))
        close(0)
