"""Page blocks, the conditional random field against exhaustive sums, and the text of pages."""

import random
import time
from itertools import product

import numpy as np
import pytest

from tallyforge.llm import main_text, queries
from tallyforge.llm.page_blocks import blocks

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def field(pages):
    return main_text.fit(main_text.labelled_pages(pages[:40]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("<p>", []),
        ("just text", ["just text"]),
        ("<p>a<b>c<br><p>d &amp;lt; &eacute;\n\t e</p> x < y", ["ac", "d &lt; é e", "x < y"]),
        ('a<script>var t="</p>";</script >b<style>p{}</style><!-- <p>no</p> -->c', ["abc"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
        ("<table><tr><td>5<td>6<tr><th>7</table>", ["5", "6", "7"]),
        ("<div title='a>b' class=\"x>y\">t</div></div></p>u", ["t", "u"]),
        ("<title>no</title><noscript>no</noscript><textarea>no</textarea>yes<!-- open", ["yes"]),
        ("yes<script>no", ["yes"]),
        ("yes<p class='no", ["yes"]),
    ],
)
def test_blocks(page, want):
    assert [b[0] for b in blocks(page)] == want


def test_blocks_of_odd_pages_take_time_in_proportion():
    for odd in ("<div>", "</div>", '<a "', "<p a='", "<", "<!--", "<x ", "<b><p>", "&"):
        took = []
        for n in (50_000, 200_000):
            start = time.time()
            blocks(odd * n)
            took.append(time.time() - start)
        assert took[1] < 12 * took[0] + 0.5, odd


def small_page(r):
    tags = ["p", "div", "li", "nav", "h1"]
    return "<article>" + "".join(f"<{t}>{' '.join('w' * r.randint(1, 5) for _ in range(r.randint(1, 9)))}</{t}>" for t in (r.choice(tags) for _ in range(r.randint(1, 7)))) + "</article>"


def score(field, page, labels):
    total = 0.0
    for i, ((text, linked, e), y) in enumerate(zip(page, labels, strict=True)):
        if y:
            total += sum(field.weights.get(f, 0.0) for f in main_text.text_features(text, linked, e) + main_text.element_features(e))
        if i:
            total += field.pairs[main_text.kind_of_pair(page[i - 1][2], e)][labels[i - 1]][y]
    return total


def test_viterbi_finds_the_best_labels(field):
    r = random.Random(3)
    for _ in range(60):
        page = blocks(small_page(r))
        best = max(score(field, page, y) for y in product((0, 1), repeat=len(page)))
        assert score(field, page, field.labels(page)) == pytest.approx(best)


def test_fit_meets_the_likelihoods_condition():
    """At the end, expected counts by exhaustive sums are the true ones less the penalty."""
    r = random.Random(5)
    train = [(page, [int(r.random() < 0.7) if len(t) > 12 else 0 for t, _, _ in page]) for page in (blocks(small_page(r)) for _ in range(40))]
    steps, main_text.STEPS = main_text.STEPS, 3_000
    try:
        field = main_text.fit(train)
    finally:
        main_text.STEPS = steps
    slope = dict.fromkeys(field.weights, 0.0)
    for page, labels in train:
        ways = list(product((0, 1), repeat=len(page)))
        p = np.exp([score(field, page, y) for y in ways])
        one = (p / p.sum()) @ np.array(ways)
        for (text, linked, e), at, y in zip(page, one, labels, strict=True):
            for f in main_text.text_features(text, linked, e) + main_text.element_features(e):
                slope[f] += at - y
    assert max(abs(g + main_text.L2 * field.weights[f]) for f, g in slope.items()) < 0.05


def test_articles_of_the_table(field, pages):
    """Pages whose article is marked, also those that training has not seen."""
    for page in pages:
        found = blocks(page)
        want = " ".join(b[0] for b, main in zip(found, main_text.own_labels(found), strict=True) if main)
        assert field.text(page) == want


def test_layouts_that_training_has_not_seen(field, pages):
    wrong = total = 0
    for k, page in enumerate(pages[40:]):
        found = blocks(page)
        labels = main_text.own_labels(found)
        story = [b[0] for b, main in zip(found, labels, strict=True) if main]
        for n in range(20):
            made, want = main_text.Layout(f"unseen {k} {n}", [b[0] for b in found]).labelled(story[:40])
            wrong += sum(a != b for a, b in zip(field.labels(made), want, strict=True))
            total += len(want)
    assert wrong < 0.01 * total


def test_parts_that_are_not_the_article(field):
    page = """<header class="site-header"><a href="/">Site</a></header><nav><a href="/a">Home</a></nav><div class="cookie-banner">We use cookies to give you more, and better.</div>
      <main><article><h1>The title</h1><p>First part of it, with some words.</p><div class="ad">Buy now! The best shoes.</div><p>Second.</p></article>
      <section class="comments"><h2>Comments</h2><div class="comment"><p>I think that this is a long and thoughtful comment, by a reader.</p></div></section></main>
      <aside>Popular now</aside><form><label>Mail</label><button>Go</button></form><footer>&copy; Site</footer>"""
    assert field.text(page) == "The title First part of it, with some words. Second."


def test_query_on_edges(spark, tmp_path, pages):
    rows = [(1, None, None, "a"), (None, "u", pages[0], "b"), (None, "u", pages[0], "b"), (2, "u", "", "c"), (3, "u", "<p>" + "word " * 300_000 + "end.</p>", None), (4, None, "<nav></nav>", "d")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[1] == texts[2] == texts[4] == "" and all(r.n_chars == len(r.text) for r in got.collect())
    assert texts[3] in ("", ("word " * 300_000 + "end."))
    clash = main_text.extract(spark.read.parquet(f"{tmp_path}/pages.parquet"), main_text.fit(main_text.labelled_pages([])))
    assert clash.columns == ["page_id", "url", "text", "text_", "n_chars"] and [r.text for r in clash.orderBy("page_id").collect()].count("b") == 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text.extract(empty, main_text.train(empty)).count() == 0
