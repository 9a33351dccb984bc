import html
import os
import random
import re

import pytest

from trackplace.llm.pages import extract_text, main_text

SMALL = "/root/testdata/sf0.001"
P1 = "The ridge was reached at noon, and the wind, cold and steady, came from the north."
P2 = "After the pass, the path goes down to the lake; the hut lies on the far shore, under the rocks."
ARTICLE = f"<h1>A day out</h1><p>{P1}</p><p>{P2}</p>"
TEXT = f"A day out\n{P1}\n{P2}"
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">Tours</a></li><li><a href="/c">About us</a></li></ul>'
LONG = "Great read, thanks, really, truly, and so on, I was there too, last year, with friends. " * 4

AROUND = {
    "plain": f"<nav>{MENU}</nav><article>{ARTICLE}</article><footer>(c) us</footer>",
    "site header": f'<header><div>Wanderer</div>{MENU}</header><main>{ARTICLE}</main>',
    "own header": f"<article><header><h1>A day out</h1></header><p>{P1}</p><p>{P2}</p><footer>Filed under walks</footer></article>",
    "sidebar": f'<div id="content">{ARTICLE}</div><div class="sidebar"><h3>News</h3><p>{P1}</p></div>',
    "aside": f"<article>{ARTICLE}<aside><p>{LONG}</p></aside></article>",
    "comments": f'<div class="post">{ARTICLE}</div><div id="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>',
    "comment articles": f'<article>{ARTICLE}</article><section class="comments-area"><article class="comment"><p>{LONG}</p></article></section>',
    "cookie notice": f'<div class="cookie-notice"><p>{LONG}</p></div><article>{ARTICLE}</article>',
    "advert inside": f'<article><h1>A day out</h1><p>{P1}</p><div class="ad">Buy boots, now, cheap.</div><p>{P2}</p></article>',
    "form inside": f'<article><h1>A day out</h1><p>{P1}</p><form><label>Mail</label><input><button>Send</button></form><p>{P2}</p></article>',
    "wrapper": f'<div class="page has-sidebar header-fixed"><div class="wrap">{MENU}<div class="entry">{ARTICLE}</div></div></div>',
    "roles": f'<div role="navigation">{MENU}</div><div role="main">{ARTICLE}</div><div role="contentinfo">(c) us</div>',
    "menu without a name": f"<div>{MENU}</div><div>{ARTICLE}</div>",
    "nested": f'<main><div><section>{ARTICLE}</section></div><div class="related"><article><p>{P1}</p></article></div></main>',
    "soup": f"<article><h1>A day out</h1><p><b>{P1}<br><p>{P2}</article><div class='share'>Share it</div>",
    "title beside": f"<div><h1>A day out</h1><div class=body><p>{P1}</p><p>{P2}</p></div><div class=tags>walks</div></div>",
    "table": f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table>",
}


@pytest.mark.parametrize("name", sorted(AROUND))
def test_only_the_article_is_kept(name):
    head = "<!DOCTYPE html><html><head><title>x</title><style>p{a:b}</style><script>var t='<p>no</p>';</script></head>"
    assert main_text(f"{head}<body>{AROUND[name]}</body></html>") == TEXT
    assert main_text(f"<!-- {LONG} -->{AROUND[name]}") == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("just words", "just words"), ("<p>one<p>two", "one\ntwo"), ("a < b && c", "a < b && c"),
    ("<article>&lt;b&gt; &amp;amp; caf&eacute; &#x1F6B2;&nbsp;&#13;x</article>", "<b> &amp; café 🚲 x"),
    ("<p>a\n \t b<br>c<span>d</span> e</p>", "a b cd e"), ("<p>cut <b", "cut"), ("<p title='a>b' x=it's>y</p>", "y"),
    ("<article><ul><li>one, <a href=x>two</a></li><li>three</li></ul><pre>a\n b</pre></article>", "one, two\nthree\na b"),
    ("<script>x</script>", ""), ("<nav>only a menu</nav>", ""), ("<div>a</div></div></p><div>b</div>", "a\nb"),
    ("<head><p>body without a tag", "body without a tag"), ("<textarea><p>no</p></textarea><p>yes</p>", "yes"),
    ("<article>Be.</article><div class='promo'>Long, long, long, and longer still, buy it all.</div>", "Be."),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages_take_linear_time():
    assert main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert main_text("<b>" * 50_000 + "<p>x" * 2_000) == "\n".join(["x"] * 2_000)
    assert main_text("<p " * 100_000) == "" and main_text('<p a="' * 50_001) == ""
    assert main_text("<p>" + "word, " * 200_000 + "</p>") == ("word, " * 200_000).strip()
    assert main_text("<span><!-" * 20_000 + "</span></b>" * 20_000 + "<p>end</p>").endswith("end")


def test_any_text_survives_its_markup():
    rng = random.Random(6)
    for _ in range(200):
        blocks = [" ".join(rng.choices(["ridge", "<pass>", "a&b", "é", "漢", "x,", '"q"', "'"], k=rng.randrange(1, 20))) for _ in range(rng.randrange(1, 6))]
        page = "".join(f"<{t}>\n {html.escape(b)}\t</{t}>" for b in blocks for t in [rng.choice(["p", "div", "h2", "blockquote"])])
        assert main_text(f"<nav>no</nav><article>{page}</article>") == "\n".join(blocks)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver data not here")
def test_given_pages(spark):
    def truth(page):
        inner = re.sub(r"</?(?:p|h1)>", "\0", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        parts = html.unescape(re.sub(r"<[^>]*>", "", inner.replace("<br>", " "))).split("\0")
        return "\n".join(t for t in (" ".join(p.split()) for p in parts) if t)

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r.page_id: (r.url, truth(r.html), len(truth(r.html))) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in extract_text(pages).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "", ""), (2, "", "<p>y</p>")]
    pages = spark.createDataFrame([(*r, 7, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1), (2, "", "", 0), (2, "", "y", 1)], key=str)
    assert extract_text(pages.limit(0)).count() == 0
