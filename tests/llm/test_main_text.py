"""Main text of pages: the reader of markup, the decoding against all labellings, pages laid out anew, and the cases."""

import itertools
from collections import Counter

import numpy as np
import pytest

from trawlwork.llm.dom import Page, attribute_tokens
from trawlwork.llm.layouts import MARK, laid_out
from trawlwork.llm.main_text import IN, MIXED, OUT, Batch, BoostedTrees, MainTextModel, main_texts

WORDS = "the of sea stone river walks under light and grows between tall old houses while rain falls over roofs".split()


def some_texts(seed, n=80):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, int(rng.integers(2, 70)))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return MainTextModel(laid_out(some_texts(1), 250, 5), rounds=25)


def runs(source):
    return [t for t in Page(source).text if t]


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        (None, []),
        ("", []),
        ("plain &lt;text&gt; &eacute;&#233;&amp", ["plain <text> éé&"]),
        ("<p>one<p>two <b>bold<i>x</b></i> end</p>three", ["one", "two boldx end", "three"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>4", ["1", "2", "3", "4"]),
        ("a<script>var x = '<p>no</p>';</script>b<style>p{}</style><!-- no <p> -->c", ["a b c"]),
        ("<head><title>no</title><body>yes", ["yes"]),
        ("x<textarea>no</textarea>y<svg><g><text>no</text></g></svg>z", ["x y z"]),
        ('<p title="a > b">in<br>line\n\t two</p><a href="cut of', ["in line two"]),
        ("1 < 2 <3 </ x> <? y ?> 4", ["1 < 2 <3 4"]),
        ("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after", ["deep", "after"]),
        ("<!-- never closed <p>no", []),
        ("<script>never closed", []),
    ],
)
def test_reader(source, texts):
    assert runs(source) == texts


def test_attributes():
    assert attribute_tokens(' class="mainNav side_bar-2" id=Foo data-class="x"') == (("main", "nav", "side", "bar", "foo"), False)
    assert attribute_tokens(" STYLE='display: none' hidden")[1] and not attribute_tokens(' class="a"')[1]


def test_decoding_against_all_labellings(model):
    rng = np.random.default_rng(2)
    for source in ("<div><p>a</p><p>b</p></div>c", "<ul><li>a<li>b</ul>", "<p>a</p>", "<div><div>x<p>y</p></div></div>"):
        batch = Batch([Page(source)], model.odds)
        n = len(batch.parent)
        for _ in range(15):
            chances = np.log(rng.dirichlet([0.5, 0.5, 0.5], n))

            def right(labels, batch=batch):
                return all(
                    not (batch.is_text[i] and k == MIXED) and (not i or labels[batch.parent[i]] in (MIXED, k)) for i, k in enumerate(labels)
                )

            best = max(sum(chances[i, k] for i, k in enumerate(x)) for x in itertools.product((OUT, IN, MIXED), repeat=n) if right(x))
            got = batch.decode(chances)
            assert right(got) and sum(chances[i, k] for i, k in enumerate(got)) == pytest.approx(best)


def test_boosting_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = np.where(x[:, 0] > 0.5, 2, (x[:, 1] > 0).astype(int))
    trees = BoostedTrees(x[:2000], y[:2000], rounds=15)
    assert (trees.log_chances(x[2000:]).argmax(axis=1) == y[2000:]).mean() > 0.95
    assert len(BoostedTrees(np.zeros((5, 2)), np.zeros(5, dtype=int), rounds=2).log_chances(np.zeros((1, 2)))) == 1


def test_layouts_held_out(model):
    pages = laid_out(some_texts(9), 150, 77)
    want = ["\n\n".join(t.replace(MARK, "") for t in Page(p).text if MARK in t) for p in pages]
    got = model.texts([p.replace(MARK, "") for p in pages])
    scores = []
    for a, b in zip(got, want, strict=True):
        a, b = Counter(a.split()), Counter(b.split())
        scores.append(2 * (a & b).total() / (a.total() + b.total()))
    assert np.mean(scores) > 0.95 and sum(a == b for a, b in zip(got, want, strict=True)) > 120


def test_main_texts(spark, model):
    body = " ".join(some_texts(4, 3))
    page = (
        f'<nav><a href="/">Home</a> <a href="/x">News</a></nav><div class="post-content"><h1>Title of it</h1><p>{body}</p><div class="ad">Buy now</div>'
        f'<p>{body}&nbsp;&amp; more</p></div><div id="comments"><p>nice one</p></div><footer>&copy; us</footer>'
    )
    want = f"Title of it\n\n{body}\n\n{body} & more"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", " <p> </p> "), (4, "x", page[:200]), (5, "y", f"<article><p>{'long text. ' * 60_000}</article>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = main_texts(df, model).collect()
    assert [(r.page_id, r.url) for r in out] == [r[:2] for r in rows] and all(r.n_chars == len(r.text) for r in out)
    assert out[0].text == out[1].text == want and out[2].text == out[3].text == out[4].text == "" and out[6].n_chars == 659_999
    assert main_texts(df.limit(0), model).count() == 0


def test_training_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_texts(none).count() == 0
    blank = spark.createDataFrame([(1, "u", None), (2, "u", "<p>")], "page_id long, url string, html string")
    assert {r.text for r in main_texts(blank).collect()} == {""}
