"""Pages in many layouts, made of given texts, with the article's runs marked: what the main-text model learns from."""

from __future__ import annotations

import html

import numpy as np

#: Stands in every run of an article.
MARK = "\ue000"

ARTICLE = "article content post entry story main-content article-body post-content entry-content story-body page-content text body-text content-body articleBody post_body detail news-text prose document single-post".split()
COLUMN = "main primary content-area column left-col col-md-8 content-wrap main-col center maincol site-main region-content".split()
WRAPPER = "container wrapper page site row layout inner outer wrap grid root app content-wrapper page-wrapper".split()
HEADER = "header site-header masthead top-bar topbar page-header head branding banner-top".split()
MENU = "nav navigation menu main-menu navbar top-nav primary-nav site-nav links main-navigation mega-menu".split()
CRUMBS = "breadcrumb breadcrumbs crumbs path".split()
SIDE = "sidebar side aside right-col col-md-4 secondary widget-area rail left-nav related-sidebar".split()
WIDGET = "widget box module panel block recent-posts popular categories tag-cloud archive most-read".split()
ADVERT = "ad ads advert advertisement sponsored promo adsbox banner ad-slot ad-container sponsor google-ad promotion".split()
NOTICE = "cookie cookie-notice notice alert gdpr consent message disclaimer announcement cookie-banner site-notice popup modal".split()
FORM = "form search newsletter subscribe signup contact-form search-form login newsletter-box".split()
COMMENTS = "comments comment-list comments-area responses discussion commentlist user-comments reviews replies".split()
SHARE = "share social sharing share-buttons social-links tools".split()
RELATED = "related related-posts more-stories recommended read-more see-also you-may-like teasers".split()
FOOTER = "footer site-footer bottom copyright page-footer colophon footer-widgets credits legal".split()


class _Layout:
    def __init__(self, rng: np.random.Generator, long: list[str], short: list[str]):
        self.rng, self.long, self.short = rng, long, short
        self.plain = rng.random() < 0.2  # no telling attributes on this page
        self.semantic = rng.random() < 0.6  # article, nav, footer and the like as tags
        self.loose = rng.random() < 0.3  # end tags left out

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, values: list[str]) -> str:
        return values[int(self.rng.integers(0, len(values)))]

    def words(self, least: int, most: int) -> str:
        words = self.pick(self.long).split()
        n = int(self.rng.integers(least, most + 1))
        at = int(self.rng.integers(0, max(1, len(words) - n)))
        return html.escape(" ".join(words[at : at + n]), quote=False)

    def named(self, names: list[str]) -> str:
        r = self.rng.random()
        if self.plain or r < 0.12:
            return ""
        if r < 0.2:
            return f' class="{"".join(chr(97 + int(x)) for x in self.rng.integers(0, 26, 6))}"'
        name = self.pick(names) if r < 0.8 else f"{self.pick(names)} {self.pick(names)}"
        return f' {"id" if r > 0.65 and " " not in name else "class"}="{name}"'

    def block(self, inner: str, names: list[str], tag: str = "div", often: float = 1.0) -> str:
        tag = tag if tag == "div" or self.semantic and self.chance(often) else "div"
        return f"<{tag}{self.named(names)}>{inner}</{tag}>\n"

    def link(self, least: int = 1, most: int = 4) -> str:
        return f'<a href="/{int(self.rng.integers(0, 999))}">{self.words(least, most)}</a>'

    def links(self, least: int, most: int, words: int = 3) -> str:
        items = [self.link(1, words) for _ in range(int(self.rng.integers(least, most + 1)))]
        r = self.rng.random()
        if r < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + ("" if self.loose else "</li>") for x in items) + "</ul>"
        return (" | " if r < 0.8 else " ").join(items) if r < 0.9 else "".join(f"<div>{x}</div>" for x in items)

    def own(self, text: str) -> str:
        return MARK + text

    def paragraph(self) -> str:
        text = html.escape(self.pick(self.long if self.chance(0.85) else self.short), quote=False)
        words = text.split(" ")
        if self.chance(0.5):
            words = words[: int(self.rng.integers(1, 60))]
        if self.chance(0.3) and len(words) > 4:
            k = int(self.rng.integers(0, len(words) - 2))
            words[k] = f'<a href="/x">{words[k]}</a>' if self.chance(0.6) else f"<em>{words[k]}</em>"
        text = self.own(" ".join(words))
        r = self.rng.random()
        if r < 0.15:
            return f"<p><b>{text}<br>" + ("" if self.loose else "</b></p>")
        if r < 0.2:
            return f"{text}<br><br>"
        if r < 0.26:
            return f"<div>{text}</div>"
        return f"<p>{text}" + ("" if self.loose and self.chance(0.7) else "</p>\n")

    def article(self) -> str:
        parts = [f"<h1>{self.own(self.words(2, 10))}</h1>"] if self.chance(0.8) else []
        if self.chance(0.15):
            parts.append(self.block(self.links(2, 4), SHARE))
        for _ in range(1 + int(self.rng.geometric(0.13)) if self.chance(0.85) else 1):
            r = self.rng.random()
            if r < 0.08:
                parts.append(f"<h2>{self.own(self.words(1, 7))}</h2>")
            elif r < 0.12:
                parts.append("<ul>" + "".join(f"<li>{self.own(self.words(3, 20))}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif r < 0.15:
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif r < 0.17:
                parts.append(f'<figure><img src="i.jpg"><figcaption>{self.own(self.words(3, 12))}</figcaption></figure>')
            elif r < 0.19:
                parts.append("<table>" + "".join(f"<tr><td>{self.own(self.words(1, 3))}</td><td>{self.own(self.words(1, 3))}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.22 and len(parts) > 2:
                parts.append(self.block(self.advert(), ADVERT, "aside", 0.3))
            elif r < 0.24 and len(parts) > 2:
                parts.append(self.block(self.related(), RELATED, "aside", 0.5))
            else:
                parts.append(self.paragraph())
        if not any(MARK in x for x in parts):
            parts.append(f"<p>{self.own(self.words(5, 40))}</p>")
        return "".join(parts)

    def advert(self) -> str:
        text = self.words(4, 25)
        return text if self.chance(0.5) else f"<p>{text}</p>" if self.chance(0.4) else f'<img src="a.gif"><a href="/ad">{text}</a>'

    def related(self) -> str:
        return f"<h3>{self.words(1, 3)}</h3>" + "".join(f"<div>{self.link(3, 9)}{f'<p>{self.words(6, 18)}</p>' if self.chance(0.4) else ''}</div>" for _ in range(int(self.rng.integers(2, 6))))

    def form(self) -> str:
        return f'<form{self.named(FORM)}><label>{self.words(1, 4)}</label><input name="q"><select><option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>{f"<p>{self.words(4, 15)}</p>" if self.chance(0.4) else ""}</form>'

    def comments(self) -> str:
        said = [
            f"<div{self.named(['comment', 'comment-body', 'reply', 'review'])}><span>{self.words(1, 2)}</span><p>{self.words(4, 45)}</p>{self.link(1, 1) if self.chance(0.5) else ''}</div>"
            for _ in range(int(self.rng.integers(1, 9)))
        ]
        if self.chance(0.4):
            said = ["<ol>" + "".join(f"<li{self.named(['comment', 'depth-1'])}>{x}</li>" for x in said) + "</ol>"]
        return f"<h3>{self.words(1, 3)}</h3>" * self.chance(0.7) + "".join(said) + (self.form() if self.chance(0.4) else "")

    def widget(self) -> str:
        r = self.rng.random()
        inner = self.links(3, 8, 6) if r < 0.6 else f"<p>{self.words(8, 40)}</p>" if r < 0.8 else self.advert() if r < 0.9 else self.form()
        return self.block(f"<h3>{self.words(1, 3)}</h3>{inner}", WIDGET)

    def page(self) -> str:
        top = []
        if self.chance(0.25):
            top.append(self.block(f"<p>{self.words(6, 30)}</p><button>{self.words(1, 1)}</button>" if self.chance(0.6) else self.words(5, 20), NOTICE))
        menu = self.block(self.links(3, 12), MENU, "nav", 0.9)
        if self.chance(0.6):
            top.append(self.block(f"<div>{self.link(1, 3)}</div>{menu if self.chance(0.7) else ''}{self.form() if self.chance(0.3) else ''}", HEADER, "header", 0.9))
        else:
            top.append(menu)
        if self.chance(0.3):
            top.append(self.block(self.links(2, 4), CRUMBS, "nav", 0.3))
        if self.chance(0.5):
            top.append(self.block(self.advert(), ADVERT))
        article = self.article()
        r = self.rng.random()
        if r < 0.75:
            article = self.block(article, ARTICLE, "article", 0.9)
            if self.chance(0.25):
                article = self.block(article, COLUMN, "main", 0.8)
        elif r < 0.85:
            article = self.block(article, ARTICLE, "main", 0.8)
        after = []
        if self.chance(0.25):
            after.append(self.block(self.links(2, 5, 2), SHARE))
        if self.chance(0.3):
            after.append(self.block(self.related(), RELATED, "section", 0.5))
        if self.chance(0.4):
            after.append(self.block(self.comments(), COMMENTS, "section", 0.6))
        if self.chance(0.15):
            after.append(self.block(self.form(), FORM))
        inside = self.chance(0.5)
        column = article + ("".join(after) if inside else "")
        side = self.block("".join(self.widget() for _ in range(int(self.rng.integers(1, 5)))), SIDE, "aside", 0.7) if self.chance(0.45) else ""
        if self.chance(0.12):
            body = f"<table><tr><td>{side}</td><td>{column}</td></tr></table>" if side else f"<table><tr><td>{column}</td></tr></table>"
        else:
            if side or self.chance(0.3):
                column = self.block(column, COLUMN, "main", 0.4)
            body = side + column if self.chance(0.4) else column + side
        for _ in range(int(self.rng.integers(0, 3))):
            body = self.block(body, WRAPPER)
        foot = self.words(2, 14)
        foot = f"<p>&copy; {foot}</p>" if self.chance(0.4) else f"&copy; {foot}" if self.chance(0.6) else foot
        if self.chance(0.4):
            foot = self.links(3, 9) + foot
        bottom = [*([] if inside else after), self.block(foot, FOOTER, "footer", 0.9)]
        if self.chance(0.1):
            bottom.append(self.block(f"<p>{self.words(5, 25)}</p>", NOTICE))
        whole = "".join(top) + body + "".join(bottom)
        if self.chance(0.3):
            whole = self.block(whole, WRAPPER)
        end = "" if self.chance(0.15) else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{whole}<script>track(1)</script>{end}"


def laid_out(texts: list[str], count: int, seed: int) -> list[str]:
    """``count`` pages; texts of eight words and more become paragraphs, others headings and the like."""
    texts = [t.replace(MARK, "") for t in texts]
    spare = [" ".join(f"word{(7 * i + k) % 90}" for k in range(10 + i)) + "." for i in range(30)]  # where the pages have no words of their own
    long = [t for t in texts if t.count(" ") >= 7] or spare
    short = [t for t in texts if t.count(" ") < 7] or ["word"]
    return [_Layout(np.random.default_rng([seed, k]), long, short).page() for k in range(count)]
