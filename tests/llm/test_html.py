"""Main texts of made, written and given pages; the decoding against all labellings; damaged pages."""

import html
import itertools
import re
import time

import numpy as np
import pytest

from opinara.llm import htmllayouts, htmltext
from tests.llm.conftest import SF

WRITTEN = [
    (
        '<html><body class="home blog"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a><header id="masthead" class="site-header">'
        '<h1 class="site-title"><a href="/">My Blog</a></h1><nav><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header><main id="main">'
        '<article id="post-12" class="post hentry"><header class="entry-header"><h1 class="entry-title">How to bake bread</h1></header><div class="entry-content"><p>Bread is'
        " simple: flour, water, salt &amp; yeast.</p><p>Mix the <em>dough</em>, let it rise, and bake.<!-- more --></p><h2>Tips</h2><ul><li>Use warm water</li><li>Be patient</li>"
        '</ul><form class="newsletter"><label>Email</label><input type="email"><button>Sign up</button></form><p>Enjoy&nbsp;it!</p></div></article><section id="comments"><h2>2'
        ' comments</h2><ol class="comment-list"><li class="comment"><p>I tried this recipe and it was wonderful, thank you so much for sharing it with us.</p></li></ol></section>'
        '</main><aside class="widget-area"><h2>Recent posts</h2><ul><li><a href="/a">Hello world</a></li></ul></aside><footer class="site-footer"><p>Proudly powered by bread</p></footer>',
        "How to bake bread Bread is simple: flour, water, salt & yeast. Mix the dough, let it rise, and bake. Tips Use warm water Be patient Enjoy it!",
    ),
    ("<html><body><p>First paragraph of a plain page, with some text in it.</p><p>Second one<p>Third one, unclosed", "First paragraph of a plain page, with some text in it. Second one Third one, unclosed"),
    ("just a text without any markup, but with &lt;entities&gt; and a < b", "just a text without any markup, but with <entities> and a < b"),
    (
        '<body><div class="navbar"><a href=/>Home</a> | <a href=/x>News</a></div><div class="cookie-notice"><p>We use cookies to improve your experience on our site.</p><button>Accept'
        '</button></div><div class="row"><div class="col-8"><div class="story-text"><h1>Rain expected</h1><p>Heavy rain is expected on <a href=/mon>Mon</a>day.</p><div class="advert">'
        '<p>Buy our umbrellas now, they are the best.</p></div><p>Take an umbrella.</p></div></div><div class="col-4 sidebar"><h3>Most read</h3><ol><li><a href=/1>One</a></li></ol>'
        '<p>Our weather team has been reporting since 1980 about all kinds of weather.</p></div></div><div class="footer"><p>Copyright 2024</p></div></body>',
        "Rain expected Heavy rain is expected on Monday. Take an umbrella.",
    ),
    (
        '<article><h1>T</h1><p>One.</p><aside class="sidebar"><p>side note of the sidebar</p></aside><script>x="<p>no</p>"</script><p>Two<style>p{}</style>words</p>'
        '<div class="share">Share on X</div></article>',
        "T One. Twowords",
    ),
    ("<nav><ul><li><a href=/>x</a></li></ul></nav><footer>&copy; f</footer>", ""),
]


@pytest.mark.parametrize("page, text", WRITTEN)
def test_written_pages(page, text):
    assert htmltext.main_texts([page], htmltext.model()) == [text]


def test_made_pages_that_no_tree_has_seen():
    fitted, right, shared, wanted_words, found_words = htmltext.model(), 0, 0, 0, 0
    for page in htmllayouts.pages(250, 77):
        pages, _ = htmltext.labelled([page])
        kept, last, main = [], None, False
        for _, block, text in pages.pieces[0]:
            main = htmllayouts.MAIN in text or (main and htmllayouts.NONE not in text)
            if main:
                kept += [text] if block == last else [" ", text]
                last = block
        bare = re.compile(f"[{htmllayouts.MAIN}{htmllayouts.NONE}]")
        wanted, found = " ".join(bare.sub("", "".join(kept)).split()), htmltext.main_texts([bare.sub("", page)], fitted)[0]
        right += wanted == found
        shared += len(set(wanted.split()) & set(found.split()))
        wanted_words, found_words = wanted_words + len(set(wanted.split())), found_words + len(set(found.split()))
    assert right >= 0.9 * 250 and shared >= 0.95 * wanted_words and shared >= 0.95 * found_words


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    wide = pages.selectExpr("html AS text_", "*", "1 AS text", "2 AS n_chars").union(pages.limit(0).selectExpr("html", "*", "1", "2"))
    found = {r.page_id: r for r in htmltext.extract(wide.repartition(3)).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        text = " ".join(html.unescape(re.sub("<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))).split())
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>Hello there, you."), (2, "u", "<p>Hello there, you."), (3, None, "   \n"), (4, "v", "<p>" + "many words, " * 40000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(map(tuple, htmltext.extract(df).collect()), key=str)
    assert [(r[0], r[1], len(r[2]), r[3]) for r in found if r[0] != 4] == [(1, None, 0, 0), (2, "u", 17, 17), (2, "u", 17, 17), (3, None, 0, 0), (None, "u", 0, 0)]
    assert [r[3] for r in found if r[0] == 4] == [len("many words, " * 40000) - 1]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_decoding_is_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(60):
        pages = htmltext.Pages()
        pages.pieces.append([])
        for i in range(n := rng.integers(1, 8)):
            pages._node(int(rng.integers(-1, i)) if i else -1, "div", ())
        scores = rng.normal(size=(n, 3))
        legal = [y for y in itertools.product(range(3), repeat=int(n)) if all(p < 0 or y[p] == htmltext.MIXED or y[p] == y[i] for i, p in enumerate(pages.parent))]
        best = max(legal, key=lambda y: sum(scores[i, k] for i, k in enumerate(y)))
        assert tuple(htmltext.decode(scores, pages)) == best


def test_damaged_pages_are_read_in_linear_time():
    damaged = [
        "<p>", "<div>", '<a b="', "<", "<!--", "<a ", '<b x=">"', "</p>", "<span>", "<ul><li>", "<table><td>", "&#9", "<script>", "&", "<li></li><div>", "<a x='", "</", "<p><table>",
    ]
    fitted = htmltext.model()
    for piece in damaged:
        times = []
        for n in (2000, 16000):
            began = time.process_time()
            htmltext.main_texts([piece * n], fitted)
            times.append(time.process_time() - began)
        assert times[1] < 30 * times[0] + 1, piece
    assert htmltext.unescape("&#" + "9" * 6000 + ";&#00000000000065;&#x41;&amp;&eacute") == "�AA&é"
