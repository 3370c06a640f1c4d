import html
import os
import random
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from catalograin.llm.extraction import Weights, best_stretch, extract, fit, label, main_text

DATA = "/root/testdata/sf0.01/pages.parquet"
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All our offers</a></li></ul></nav>'


@pytest.fixture(scope="module")
def weights(spark):
    page = "<html><head><title>T</title><script>x='</p>'</script></head><body>{nav}<div>Site slogan stands here</div><article><h1>Title {i}</h1><p>Some words of a text that is long enough.<p>And <b>more</b></article><div>Site imprint</div></body></html>"
    return fit(spark.createDataFrame([(i, page.format(nav=NAV, i=i)) for i in range(30)], "page_id long, html string"))


def test_region_and_what_goes(weights):
    page = f"""<!DOCTYPE html><title>No</title><body>{NAV}<div>A slogan</div><div class="cookie-notice">We use cookies on this site to be nice</div><article><header><h1>Title&nbsp;here</h1></header>
      <p>One <a href="q">two</a> three &amp; f<b>ou</b>r<br>five &lt;six&gt;<ul><li>item a<li>item b</ul><div class="ad">Buy now</div><form>Mail <input></form><script>bad("</p>")</script><!-- no <p>no</p> -->
      <p>Last a < b words</p></article><section id="comments"><p>A first comment</p><p>A second comment that is rather long</p></section><footer>Foot</footer>"""
    assert main_text(page, weights) == "Title here One two three & four five <six> item a item b Last a < b words"


def test_best_region_is_the_maximum_sum():
    tied = Weights({("w", "p"): (90, 10), ("t", "section"): (0, 5), ("t", "/section"): (0, 5)})
    assert main_text("<p>a b c</p><section></section><p>d e f</p>", tied) == "a b c"  # equally good: the first
    strong = Weights({("w", "p"): (90, 10), ("t", "section"): (0, 50), ("t", "/section"): (0, 50)})
    assert main_text("<p>a b</p><section></section><p>d e f g h</p><section></section><p>i</p>", strong) == "d e f g h"


@given(st.lists(st.integers(-3, 3), max_size=12))
def test_best_stretch_against_all_stretches(scores):
    every = [(sum(scores[i:j]), -j, j - i, (i, j)) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = max(every, default=(0, 0, 0, (0, 0)))
    assert best_stretch(scores) == (best[3] if best[0] > 0 else (0, 0))


@pytest.mark.parametrize("open_, close", [
    ('<body class="has-sidebar">', "</body>"), ('<html class="js cookies"><body>', "</body></html>"), ('<body><form id="aspnetForm">', "</form></body>"), ('<body><div class="page-header-fixed">', "</div></body>"),
    ('<body><div class="banner wrapper">', "</div></body>"), ('<body class="ad"><div role="navigation">', "</div></body>"),
])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_frames_of_the_page_stay(weights, open_, close, inner):
    page = f'{open_}{NAV}<{inner}><h1>A title</h1><p>Text of the page that is long enough to be found.</p><p class="social-history">More of it.</p><p class="related-work">And the rest.</p></{inner}><div class="cookie-notice">We use cookies</div>{close}'
    assert main_text(page, weights) == "A title Text of the page that is long enough to be found. More of it. And the rest."


def test_articles_stay_whole(weights):
    """Markup that no labelled page has costs no words of an article; two articles stay apart from what is between them."""
    deep = '<div class="x-unknown"><div><div><div>The last six words lie here</div></div></div></div>'
    page = f"<body>{NAV}<article><h1>Title</h1><p>Some words of a text that is long enough.</p>{deep}</article><div>A slogan</div><footer>Foot</footer>"
    assert main_text(page, weights) == "Title Some words of a text that is long enough. The last six words lie here"
    assert main_text(page.replace("article", "main"), weights) == "Title Some words of a text that is long enough. The last six words lie here"
    assert main_text(page.replace("</article>", '<section id="responses"><p>A reader says so.</p></section></article>'), weights) == "Title Some words of a text that is long enough. The last six words lie here"


@pytest.mark.parametrize("page", [
    "<div>" * 180_000 + "</span>" * 150_000, '<div class="menu">' * 110_000, "<article>" * 200_000 + "x", "<p>" * 200_000 + "</b></i>" * 100_000, ('<div class="menu">a' * 50 + "</div>" * 50) * 2_000,
])
def test_two_megabytes_of_odd_markup_take_seconds(weights, page):
    began = time.process_time()
    main_text(page, weights)
    label(page)
    assert time.process_time() - began < 10


def _frame(rng):
    """A page whose article is made of pieces, with what it says, between frames of all kinds."""
    words = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(3, 25)))
    junk = ["<nav><a href='/'>{}</a></nav>", "<div class='sidebar'>{}</div>", "<form>{}<input></form>", "<div class='cookie-notice'>{}</div>", "<script>{}</script>", "<!-- {} -->", "<footer>{}</footer>", "<section id='comments'><p>{}</p></section>"]
    kinds = ["<p>{}</p>", "<p>{}", "<ul><li>{}</li></ul>", "<div class='k9 z'><div><div>{}</div></div></div>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<p><b>{}</b></p>"]
    said, body = [], []
    for _ in range(rng.randint(2, 9)):
        if rng.random() < 0.3:
            body.append(rng.choice(junk[1:6]).format(words()))
        said.append(words())
        body.append(rng.choice(kinds).format(said[-1]))
    around = lambda: "".join(rng.choice(junk).format(words()) for _ in range(rng.randint(0, 4)))
    return f"<html><body><div class='wrap'>{around()}<article>{''.join(body)}</article>{around()}</div></body></html>", " ".join(said)


def test_generated_frames(weights):
    """All of the article's own text and nothing else, whatever lies around and within."""
    rng = random.Random(6)
    pages = [_frame(rng) for _ in range(300)]
    assert [main_text(p, weights) for p, _ in pages] == [text for _, text in pages]


def test_long_comments_go(weights):
    page = "<body><div><p>A short text of its own.</p></div><div id='comments'>" + "<p>A reader says something.</p>" * 5 + "</div></body>"
    assert main_text(page, weights) == "A short text of its own."


def test_names_are_learned(spark):
    body = '<article><p class="related">Words of the text {i} go on and on here</p></article><div class="zone-b">Other words that stand on each page {i}</div>'
    weights = fit(spark.createDataFrame([(i, body.format(i=i)) for i in range(40)], "page_id long, html string"))
    assert not weights.gone("related") and weights.gone("zone-b") and weights.gone("sidebar") and not weights.gone("prose")


def test_only_labelled_pages_are_sampled(spark):
    """Two labelled pages among many others are both learned from."""
    rows = [(i, "<div>no mark here</div>") for i in range(500)] + [(1000 + i, "<article><p>words of a text</p></article><div>else</div>") for i in range(2)]
    weights = fit(spark.createDataFrame(rows, "page_id long, html string"), max_rows=10)
    assert weights.words["p"] > 1 and "div" in weights.words


def test_edges(spark, weights):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "just words"), (3, "u", "just words"), (None, "v", "<p>broken <b <i>x"), (4, "w", "<p>" + "word " * 100_000), (5, "x", "<script>only"), (6, "y", '<p title="a > b">x</p><p \'unclosed>y')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "1 AS n_chars")
    got = extract(pages, weights).collect()
    by_id = {r["page_id"]: (r["text"], r["n_chars"]) for r in got}
    assert len(got) == len(rows) and by_id[1] == by_id[2] == by_id[5] == ("", 0)
    assert by_id[3] == ("just words", 10) and by_id[4][1] == 499_999
    assert extract(pages.limit(0), weights).count() == 0
    assert main_text("<p>a</p>", fit(pages.limit(0))) == "a"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_marked_pages(spark):
    """On pages that mark their text, learned from half of them, what is found is what they mark."""
    pages = spark.read.parquet(DATA)
    for r in extract(pages, fit(pages.where("page_id % 2 = 0"))).join(pages.select("page_id", "html"), "page_id").collect():
        marked = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", marked))).split())
