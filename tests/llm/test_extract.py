import html
import itertools
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from poslake.llm import dom, extract


def cost(odds, links, side):
    return sum(max(z, 0) * (not s) + max(-z, 0) * s for z, s in zip(odds, side, strict=True)) + sum(w for a, b, w in links if side[a] != side[b])


def test_cuts_are_minimal():
    pick = random.Random(4)
    for _ in range(400):
        n = pick.randint(1, 9)
        odds = [pick.randint(-6, 6) for _ in range(n)]
        links = [(i, i + 1, pick.randint(0, 6)) for i in range(n - 1)] + [(*pick.sample(range(n), 2), pick.randint(1, 5)) for _ in range(pick.randint(0, 4)) if n > 1]
        best = min(cost(odds, links, side) for side in itertools.product((False, True), repeat=n))
        assert cost(odds, links, extract.min_cut(odds, links)) == best


def test_long_chains_end():
    n = 60_000
    odds = [(1 if i % 2 else -1) * (i % 5 + 1) for i in range(n)]
    assert len(extract.min_cut(odds, [(i, i + 1, 4) for i in range(n - 1)])) == n
    assert extract.min_cut([0] * 5 + [9], [(i, i + 1, 3) for i in range(5)]) == [True] * 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><div>Slogan of this site.</div></header><nav><ul><li><a href=/a>One</a><li><a href="/b>">Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, as all the others do, to make you happy.</div>
<main><article><header class="entry-header"><h1>Head &amp; line</h1></header><p>First para<b>graph</b> with&nbsp;a   few
words.<p>Second <a href="#">one</a>.<div class="ad">Buy our things today, they are good.</div><p>Short<br>end.</p><!-- <p>no</p> -->
<form><label>Your mail</label><input><button>Send</button></form>
<section id="comments"><article class="comment"><p>A reader says that all of this was a lovely thing to read.</p></article></section>
</article></main><aside><p>Other stories that you may like to read on this very site.</p></aside><footer>&copy; Us. All the words of a footer.</footer></body></html>"""


def test_a_page_with_everything():
    assert extract.main_text(PAGE) == "Head & line\nFirst paragraph with a few words.\nSecond one.\nShort end."


def test_pages_without_telling_elements():
    words = "Some words of a longer sentence that goes on for a while, and then it ends. " * 3
    page = f"<div><a href=1>Home</a> <a href=2>About</a></div><div><div>{words}</div><div>Yes.</div><div>{words}</div></div><div><a href=3>Imprint</a></div>"
    assert extract.main_text(page) == "\n".join((words.strip(), "Yes.", words.strip()))


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("   ", ""), ("<article>a < b &lt;c &#233; &unknown; &amp", "a < b <c é &unknown; &"), ("<article>x<p>y<!-- z", "x\ny"),
    ("<article><p>x<script>y", "x"), ("<article>one<a href='>two", "one\ntwo".replace("\n", "")), ("<article>a</b></div>b</article>", "a\nb"), ("<article><table><tr><td>a<td>b</table>", "a\nb"),
    ("<ARTICLE><P>UP</P></ARTICLE>", "UP"), ("<article hidden>x</article>", ""), ("<article><p>a<svg>b</svg>c", "ac"), ("<article>1 <2 <3</article>", "1 <2 <3")])
def test_odd_markup(page, text):
    assert extract.main_text(page) == text


def test_hostile_pages_stay_linear():
    for page in ("<div>" * 50_000 + "x", "<a <a " * 50_000, "<b>x" * 50_000, "<li>x" * 50_000, "<" * 200_000, "<p class='" * 20_000, "<!--" * 50_000, "<p>x</i>" * 50_000, "<div>ab</div>" * 30_000):
        extract.main_text(page)


def article(page):
    """The article of a test page, whose blocks are its heading and paragraphs."""
    inside = re.search(r"(?s)<article>(.*?)(</article>|<footer>|$)", re.sub(r"(?s)<(script|style)>.*?</\1>|<!--.*?-->", "", page))[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_all_pages(spark, sf_dir):
    got = {r["page_id"]: r for r in extract.extract_table(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    pages = brute.rows("pages", "page_id", "url", "html")
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        r = got[page_id]
        assert (r["url"], r["text"], r["n_chars"]) == (url, article(page), len(r["text"]))


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "", ""), (3, "v", "<article>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1)).withColumn("__text", F.lit(2))
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in extract.extract_table(df).collect()))
    n = len("Head & line\nFirst paragraph with a few words.\nSecond one.\nShort end.")
    assert got == [(0, 0), (1, n), (1, n), (2, 0), (3, 999_999)]
    assert extract.extract_table(df.limit(0)).collect() == []


def test_weights_follow_the_labels_and_stay_near_the_stated_ones():
    x = np.array([extract.features(dom.Block("word " * n, n, link, "div", 0, 0)) for n in range(1, 40) for link in (0.0, 1.0)])
    y = (x[:, 2] < 0.5).astype(float)
    w = extract.fit_weights(x, y)
    assert w[2] < extract.PRIOR[2] and np.abs(w - extract.PRIOR).max() < 4
    assert (extract.fit_weights(x, np.ones(len(x))) == extract.PRIOR).all()
