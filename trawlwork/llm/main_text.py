"""Main text of HTML pages: boosted trees over DOM-node features, decoded from the root down.

Every block and every run of text gets the chances of three classes: all of its text belongs to the article, none of it,
or some. Decoding chooses the most likely consistent labelling: below a block that is all article, or none, everything
is; only a mixed block leaves the choice to its children. So no ancestor ever contradicts a descendant.

There are no labelled pages. The trees learn from pages laid out here, in many ways, with the words of a bounded sample of
the given pages, where every run's class is known.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import text_chunks
from trawlwork.llm.dom import HEADINGS, Page, attribute_tokens
from trawlwork.llm.layouts import MARK, laid_out

#: Pages whose words the layouts are made of, the longest among them in bytes, and layouts to learn from.
SAMPLE_PAGES, SAMPLE_BYTES = 150, 30_000
LAYOUTS = 450
#: Rows that a tree looks at, about.
TREE_ROWS = 12_000
ROUNDS, LEVELS, BINS, RATE, RIDGE = 40, 5, 24, 0.3, 3.0
OUT, IN, MIXED = 0, 1, 2


class Odds:
    """How often the text below a tag or an attribute word is no article: log odds, drawn towards zero where rare."""

    def __init__(self, pages: list[Page], inside: list[np.ndarray]):
        counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for page, own in zip(pages, inside, strict=True):
            runs = np.array([bool(t) for t in page.text])
            total = np.r_[0, np.cumsum(runs)]
            good = np.r_[0, np.cumsum(runs & own)]
            for i, (tag, attributes, last) in enumerate(zip(page.tag, page.attributes, page.last, strict=True)):
                if total[last] > total[i]:
                    share = (good[last] - good[i]) / (total[last] - total[i])
                    for name in ("<" + tag, *attribute_tokens(attributes)[0]):
                        counts[name][0] += 1 - share
                        counts[name][1] += share
        self.known = {k: float(np.log((out + 2) / (own + 2))) for k, (out, own) in counts.items()}
        self.parts = sorted(k for k, v in self.known.items() if k[0] != "<" and len(k) >= 4 and abs(v) > 1)
        self.unknown: dict[str, float] = {}

    def __getitem__(self, name: str) -> float:
        if name in self.known:
            return self.known[name]
        if name not in self.unknown:
            if len(self.unknown) > 1 << 14:
                self.unknown.clear()
            held = [self.known[p] for p in self.parts if p in name] if name[0] != "<" and len(name) < 64 else []
            self.unknown[name] = max(held, key=abs, default=0.0)
        return self.unknown[name]


class Batch:
    """The nodes of several pages after each other, each after its parent, as arrays and features."""

    def __init__(self, pages: list[Page], odds: Odds):
        sizes = [len(p.tag) for p in pages]
        first = np.cumsum([0, *sizes])[:-1]
        self.pages = pages
        n = int(sum(sizes))

        def joined(values, kind=np.float64):
            return np.fromiter((x for v in values for x in v), dtype=kind, count=n)

        shift = np.repeat(first, sizes)
        self.parent = joined((p.parent for p in pages), np.int64) + shift
        self.parent[first] = first  # a root is its own parent
        self.last = joined((p.last for p in pages), np.int64) + shift
        self.depth = joined((p.depth for p in pages), np.int64)
        self.root = shift
        tags = [t for p in pages for t in p.tag]
        texts = [t for p in pages for t in p.text]
        self.is_text = np.array([bool(t) for t in texts])
        chars = np.array([len(t) for t in texts], dtype=np.float64)
        words = np.array([t.count(" ") + 1 if t else 0 for t in texts], dtype=np.float64)
        stops = np.array([t.count(".") + t.count("!") + t.count("?") for t in texts], dtype=np.float64)
        commas = np.array([t.count(",") for t in texts], dtype=np.float64)
        linked, inner, controls, images = (joined(getattr(p, c) for p in pages) for c in ("linked", "inner", "controls", "images"))
        tag = np.array([odds["<" + t] for t in tags])
        own = [[odds[w] for w in attribute_tokens(a)[0]] if a else () for p in pages for a in p.attributes]
        most, least = (np.array([f(x, default=0.0) for x in own]) for f in (max, min))
        hidden = np.array([bool(a) and attribute_tokens(a)[1] for p in pages for a in p.attributes])
        named = {kind: np.array([t in group for t in tags], dtype=np.float64) for kind, group in (("p", ("p",)), ("li", ("li", "dd", "td")), ("h", HEADINGS))}
        numbers, inverse = np.unique(np.array(tags), return_inverse=True)

        def below(values: np.ndarray) -> np.ndarray:
            running = np.r_[0.0, np.cumsum(values)]
            return running[self.last] - running[:-1]

        # What ancestors say, level by level.
        levels = [np.flatnonzero(self.depth == d) for d in range(1, int(self.depth.max()) + 1)] if n else []
        self.levels = levels
        tag_most, tag_least, word_most, word_least, in_hidden = tag.copy(), tag.copy(), most.copy(), least.copy(), hidden.astype(np.float64)
        for at in levels:
            up = self.parent[at]
            for values, choose in ((tag_most, np.maximum), (tag_least, np.minimum), (word_most, np.maximum), (word_least, np.minimum), (in_hidden, np.maximum)):
                values[at] = choose(values[at], values[up])
        # Siblings.
        whole, whole_words, runs = below(chars), below(words), below(self.is_text.astype(np.float64))
        children = np.bincount(self.parent, minlength=n).astype(np.float64)
        children[first] -= 1
        siblings = np.maximum(children[self.parent], 1)
        order = np.lexsort((np.arange(n), self.parent))
        start = np.searchsorted(self.parent[order], np.arange(n))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - start[self.parent[order]]
        key = self.parent * len(numbers) + inverse
        _, back, same = np.unique(key, return_inverse=True, return_counts=True)
        alike, alike_chars = same[back] / siblings, np.bincount(back, whole)[back] / same[back]
        sibling_chars = (whole[self.parent] - chars[self.parent]) / siblings
        before = np.r_[0.0, np.cumsum(chars)][:-1]
        page_chars = np.maximum(whole[self.root], 1)
        blocks = np.maximum(self.last - np.arange(n), 1)
        safe = np.maximum(whole, 1)
        paragraph = below(chars * named["p"][self.parent])
        listed = below(chars * named["li"][self.parent])
        depths = [self.parent, self.parent[self.parent]]
        self.features = np.stack(
            [
                tag, tag[depths[0]], tag[depths[1]], tag_most, tag_least, most, least, word_most, word_least, most[depths[0]], least[depths[0]],
                below((word_most > 1) * chars) / safe, below((word_least < -1) * chars) / safe, below((tag_most > 1) * chars) / safe,
                np.log1p(whole), np.log1p(whole_words), below(linked) / safe, whole / (blocks + below(inner)), below(stops) / np.maximum(whole_words, 1),
                below(commas) / np.maximum(whole_words, 1), whole_words / np.maximum(runs, 1), below(words * words) / np.maximum(whole_words, 1),
                whole / page_chars, (before - before[self.root]) / page_chars, (before - before[self.root] + whole) / page_chars,
                self.depth.astype(np.float64), place / siblings, place.astype(np.float64), siblings, alike, np.log1p(whole) - np.log1p(sibling_chars), np.log1p(whole) - np.log1p(alike_chars),
                np.log1p(blocks), paragraph / safe, listed / safe, below(named["h"]), below(controls), below(images), whole / np.maximum(whole[self.parent], 1),
                self.is_text.astype(np.float64), in_hidden, (below(linked) / safe)[self.parent], whole_words[self.parent] / np.maximum(runs[self.parent], 1),
            ],
            axis=1,
        ) if n else np.zeros((0, 43))
        self.has_text = whole > 0

    def decode(self, chances: np.ndarray) -> np.ndarray:
        """The label of every node in the likeliest labelling without contradictions, from logs of chances by class."""
        n = len(chances)
        chances = np.where(self.has_text[:, None], chances, 0.0)
        running = np.r_[np.zeros((1, 2)), np.cumsum(chances[:, :2], axis=0)]
        alone = running[self.last] - running[:n]  # if all below is the same
        mixed = np.where(self.is_text | ~self.has_text, -np.inf, chances[:, MIXED])
        for at in self.levels[::-1]:
            best = np.maximum(alone[at].max(axis=1), mixed[at])
            mixed += np.bincount(self.parent[at], best, n)
        label = np.where(mixed > alone.max(axis=1), MIXED, alone.argmax(axis=1))
        for at in self.levels:
            up = label[self.parent[at]]
            label[at] = np.where(up == MIXED, label[at], up)
        return label

    def texts(self, label: np.ndarray) -> list[str]:
        out, at = [], 0
        for page in self.pages:
            own = label[at : at + len(page.tag)]
            out.append("\n\n".join(t for t, k in zip(page.text, own, strict=True) if t and k == IN))
            at += len(page.tag)
        return out


class BoostedTrees:
    """Softmax boosting with trees that ask one question a level, over binned features."""

    def __init__(self, features: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, classes: int = 3):
        n, width = features.shape
        self.edges = [np.unique(np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, features[:, f]) for f, e in enumerate(self.edges)]).astype(np.int32)
        asked_of = [f for f in range(width) if len(self.edges[f])]
        rng = np.random.default_rng(20261203)
        columns, scores = np.ascontiguousarray(features.T), np.zeros((n, classes))
        wanted = np.eye(classes)[label]
        self.trees: list[tuple[int, list[tuple[int, float]], np.ndarray]] = []
        for _ in range(rounds):
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            drawn = np.sort(rng.permutation(n)[:TREE_ROWS])
            seen = np.ascontiguousarray(binned[:, drawn])
            for c in range(classes):
                slope, curve = (wanted[:, c] - odds[:, c])[drawn], (odds[:, c] * (1 - odds[:, c]))[drawn]
                leaf, asked = np.zeros(len(drawn), dtype=np.int32), []
                for level in range(LEVELS):
                    leaves, best = 1 << level, (-np.inf, 0, 0)
                    for f in asked_of:
                        cell = leaf * BINS + seen[f]
                        g, h = (np.bincount(cell, w, leaves * BINS).reshape(leaves, BINS).cumsum(axis=1) for w in (slope, curve))
                        # Above an edge against up to it, over all leaves at once.
                        up_g, up_h = g[:, -1:] - g, h[:, -1:] - h
                        gain = (g * g / (h + RIDGE) + up_g * up_g / (up_h + RIDGE)).sum(axis=0)[: len(self.edges[f])]
                        k = int(gain.argmax())
                        if gain[k] > best[0] + 1e-9:
                            best = (gain[k], f, k)
                    _, f, k = best
                    leaf = leaf * 2 + (seen[f] > k)
                    asked.append((f, float(self.edges[f][k]) if len(self.edges[f]) else np.inf))
                values = RATE * np.bincount(leaf, slope, 1 << LEVELS) / (np.bincount(leaf, curve, 1 << LEVELS) + RIDGE)
                everywhere = np.zeros(n, dtype=np.uint8)
                for f, edge in asked:
                    everywhere = everywhere * 2 + (columns[f] > edge)
                scores[:, c] += values[everywhere]
                self.trees.append((c, asked, values))

    def log_chances(self, features: np.ndarray, classes: int = 3) -> np.ndarray:
        scores = np.zeros((len(features), classes))
        columns = np.ascontiguousarray(features.T)
        for c, asked, values in self.trees:
            leaf = np.zeros(len(features), dtype=np.uint8)
            for f, edge in asked:
                leaf = leaf * 2 + (columns[f] > edge)
            scores[:, c] += values[leaf]
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


class MainTextModel:
    """Trained on pages whose article text is marked; ``texts`` extracts."""

    def __init__(self, marked: list[str], rounds: int = ROUNDS):
        pages = [Page(source) for source in marked]
        inside = []
        for page in pages:
            inside.append(np.array([MARK in t for t in page.text]))
            page.text = [t.replace(MARK, "") for t in page.text]
        self.odds = Odds(pages, inside)
        batch = Batch(pages, self.odds)
        own, runs = (np.r_[0, np.cumsum(x)] for x in (np.concatenate(inside), batch.is_text))
        held = runs[batch.last] - runs[:-1]
        good = own[batch.last] - own[:-1]
        label = np.where(good == 0, OUT, np.where(good == held, IN, MIXED))
        used = held > 0
        self.trees = BoostedTrees(batch.features[used], label[used], rounds)

    @classmethod
    def trained(cls, samples: list[str], layouts: int = LAYOUTS, seed: int = 20261202) -> MainTextModel:
        """From the words of sample pages."""
        return cls(laid_out([t for s in samples for t in Page(s).text if t], layouts, seed))

    def texts(self, sources: list[str | None]) -> list[str]:
        batch = Batch([Page(s) for s in sources], self.odds)
        return batch.texts(batch.decode(self.trees.log_chances(batch.features)))


def train_main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES, layouts: int = LAYOUTS) -> MainTextModel:
    """From ``sample_pages`` of ``pages(html)`` at most, of at most ``sample_bytes`` each, the first by a hash: what the driver holds."""
    rows = pages.select("html", F.xxhash64("html").alias("mark")).filter(F.octet_length("html") <= sample_bytes)
    # Only hashes are sorted; the chosen pages, one for each hash, are read after that.
    chosen = [r["mark"] for r in rows.select("mark").distinct().orderBy("mark").limit(sample_pages).collect()]
    found = rows.filter(F.col("mark").isin(chosen)).groupBy("mark").agg(F.min("html").alias("html")).collect() if chosen else []
    return MainTextModel.trained([r["html"] for r in sorted(found, key=lambda r: r["mark"])], layouts)


def main_texts(pages: DataFrame, model: MainTextModel | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    ``text`` is the article: its blocks in page order, each with its references decoded and its white space made one space,
    an empty line between two. Null and empty pages, and pages without an article, have an empty text. Broken markup is
    read as browsers read it; cut-off pages as far as they go, pages of any length whole. Null and repeated ids and addresses
    are rows like all others; other columns are ignored. Without ``model`` one is trained on the words of the pages themselves.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train_main_text(pages))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            html = batch.column(2)
            for first, last, _, _ in text_chunks(html):
                texts = own.texts(html.slice(first, last - first).to_pylist())
                ids, urls = (batch.column(k).slice(first, last - first) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
