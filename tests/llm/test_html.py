import html as escapes
import os
import random
import re

import pytest

from tokentide.llm import html

STORY = "<article><h1>Big &amp; bold</h1><p>First  words\n of it &eacute;<br>second line<p>third <b>bold</b>word</p></article>"
TEXT = "Big & bold\nFirst words of it é\nsecond line\nthird boldword"
FRAME = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/x">one</a></li></ul></nav>{}<footer>end of it</footer></body></html>'


@pytest.fixture(scope="module")
def weight(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choices(["thou", "shalt", "not", "steal"], k=n))
    pages = [FRAME.format(f'<div class="ad">{words(12)}</div><article><h1>{words(5)}</h1>' + f"<p>{words(40)}</p>" * 4 + "</article>") for _ in range(30)]
    return html.weights(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string"))


def brute_region(scores):
    best = (0.0, 0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            best = max(best, (sum(scores[a:b]), -a, -b))
    return best[0]


def test_region_is_a_best_one():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 14))]
        a, b = html.region(scores)
        assert sum(scores[a:b]) == brute_region(scores)


@pytest.mark.parametrize(
    "page",
    [
        STORY,
        FRAME.format(STORY),
        FRAME.format('<div class="ad">buy this now and here</div>' + STORY + '<section class="comments"><p>I liked this very much</p></section>'),
        FRAME.format('<div id="cookie-notice"><p>we use cookies</p></div><header><h2>Site</h2></header>' + STORY + "<aside><p>more to read here</p></aside>"),
        FRAME.format(STORY.replace("<br>", '<form><p>mail here<input name="q"></p></form><br>')),
        FRAME.format(STORY.replace("article>", "main>")),
        FRAME.format(STORY.replace("<p>third", "<!-- a <p> --><style>p{}</style><p>third")),
    ],
)
def test_only_the_story_is_left(page, weight):
    assert html.main_text(page, weight) == TEXT


def test_odd_pages(weight):
    assert [html.main_text(p, weight) for p in (None, "", "<p>", "<nav><a>x</a></nav>", "<!-- open")] == [""] * 5
    assert html.main_text("<p>a < b &am &#x41;</p>", weight) == "a < b &am A"
    long = "<article>" + "<p>" + "word " * 300_000 + "</p></article>"
    assert html.main_text(long, weight) == ("word " * 300_000).strip()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extracted(pages, html.weights(pages)).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html or "", re.DOTALL)
        blocks = re.split(r"</?(?:h1|p|br)\b[^>]*>", body[1]) if body else []
        lines = [" ".join(escapes.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split()) for b in blocks]
        text = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (text, len(text))


def test_edge_tables(spark, weight):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text double")
    assert html.extracted(empty, html.weights(empty)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, 1.0), (2, "u", "<p>five words in a row</p>", 1.0)] * 2, empty.schema)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extracted(nulls, weight).collect()) == [
        (0, "", 0), (0, "", 0), (2, "five words in a row", 19), (2, "five words in a row", 19)
    ]
