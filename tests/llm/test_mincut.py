from __future__ import annotations

import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np

from corvane.llm import mincut as M


def test_cut_is_minimal():
    draw = random.Random(1)
    for _ in range(150):
        n = draw.randint(1, 9)
        a, b = [draw.random() * 3 for _ in range(n)], [draw.random() * 3 for _ in range(n)]
        e = [(i, j, draw.random()) for i in range(n) for j in range(i + 1, n) if draw.random() < 0.4]
        cost = lambda y: sum(a[i] if y[i] else b[i] for i in range(n)) + sum(w for i, j, w in e if y[i] != y[j])  # noqa: B023, E731
        assert abs(cost(M.minimum_cut(a, b, e)) - min(map(cost, itertools.product([0, 1], repeat=n)))) < 1e-9


def test_held_out_pages():
    w = np.array(M.classifier())
    right = total = 0
    for page, labels in M.training_pages(150, seed=77):
        b = M.blocks(page)
        s = M.features(b) @ w
        got = M.minimum_cut(np.logaddexp(0, -s).tolist(), np.logaddexp(0, s).tolist(), M.smoothness(b))
        right += sum(x == y for x, y in zip(got, labels, strict=True))
        total += len(labels)
    assert right >= 0.99 * total


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header class="site-header"><a href="/">Site</a></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><!-- <p>no</p> -->
<article><h1>The  title</h1><p><b>First &amp; second.<br><p>A &lt; B&nbsp;and
 more <a href="x">link</a> text.</p><div class="advert">Buy now!</div><p>Be.</p></article>
<aside class="sidebar"><h3>Related</h3><p>Other story here.</p></aside><section class="comments"><div class="comment"><p>Nice article, thanks a lot for it.</p></div></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer>"""


def test_parts_of_a_page():
    assert M.main_text(PAGE, M.classifier()) == "The title\n\nFirst & second.\n\nA < B and more link text.\n\nBe."


def test_unclosed_and_custom_elements_hide_no_article():
    body = "<article><h1>The title</h1><p>Some words of the article, long enough to be read.</p><p>And some more of them follow here.</p></article>"
    want = "The title\n\nSome words of the article, long enough to be read.\n\nAnd some more of them follow here."
    for before in ["<head><title>T</title><meta charset=utf-8><body>", "<head><script>document.write('<div>x')</script><body>", "<video-player></video-player>", "<title-bar src=x></title-bar>", "<template-x>", "<svg>", "<noscript>", "<title>T</title ><script>var a;</script x>"]:
        assert M.main_text(f"<!DOCTYPE html><html>{before}{body}</html>", M.classifier()) == want, before
    assert M.main_text(f"<html>{body}<script>var a = 1;", M.classifier()) == want
    formula = body.replace("more of them", "<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></math>")
    assert M.main_text(formula, M.classifier()).endswith("And some x=2 follow here.")
    assert len(M.blocks("<template>" * 50000 + "<p>x")) == 1


def test_page_table(spark, small):
    """Against a plain reading of this table's template: the article's blocks."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in M.op2(spark, small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", article))
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "no markup at all, only words"), (None, "u", "<p>x"), (5, "u", "<article>" + "<p>long words here.</p>" * 3000), (6, "u", "<<<>>< <p <a"), (1, "u", None), (7, "u", "<script>" * 50), (8, "u", "<div><b>x" * 20000 + "</b>" * 20000), (9, "u", "<p>y" * 20000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = M.extract(df).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert next(r for r in out if r.page_id == 5).text.count("\n\n") == 2999
    assert [r.text for r in out if r.page_id in (1, 2, 3)] == [""] * 4
    assert M.extract(spark.createDataFrame([], df.schema)).count() == 0


class _Plain(HTMLParser):
    """Texts of blocks as the library's own HTML parser reads the page, without a tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.hidden = [], [], []

    def end(self):
        t = " ".join("".join(self.text).split())
        self.found += [t] if t else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in M.SKIPPED:
            self.hidden.append(tag)
        elif tag == "br":
            self.text.append(" ")
        elif tag not in M.INLINE and (tag not in M.VOID or tag == "hr"):
            self.end()

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag not in M.INLINE and tag not in M.VOID:
            self.end()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def test_block_texts_against_another_parser(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect() + [(0, "", PAGE)]:
        p = _Plain()
        p.feed(r[2])
        p.close()
        p.end()
        assert [b[0] for b in M.blocks(r[2])] == p.found


def test_self_closed_scripts_and_quotes_hide_nothing():
    w = M.classifier()
    assert M.main_text("<p>First words of it.</p><script src=x/>var leak = 1;</script><p>Second words of it.</p>", w) == "First words of it.\n\nSecond words of it."
    assert M.main_text('<p>First words of it.</p><script src="x"/><p>Second words of it.</p>', w) == "First words of it.\n\nSecond words of it."
    assert M.main_text('<p title="a>b">First words of it.</p><p class=" >Second words of it.</p><p>Third.</p>', w) == "First words of it.\n\nSecond words of it.\n\nThird."
    assert M.main_text("<p>3 < 4 and 5 > 4, it <3 that.</p><p>Then <", w) == "3 < 4 and 5 > 4, it <3 that.\n\nThen <"


def test_hostile_pages_are_read_in_linear_time():
    hostile = ["<a " * 340000, "<div>" * 20000 + "<b>x</i>" * 100000, "<i><div>" + "<b>" * 60000 + "</i>x" * 60000, '<a href="' * 100000 + ">", "<p>x</p>" * 100000, "<div>x" * 100000, "<script>" + "</script " * 100000, "<ul><li>x" * 60000]
    for page in hostile:
        start = time.process_time()
        M.main_text(page, M.classifier())
        assert time.process_time() - start < 5, page[:20]
    assert M.main_text("<div>" * 20000 + "<b>x</i>" * 20000, M.classifier()) == "x" * 20000
    assert M.main_text("<p>word.</p>" * 60000, M.classifier()).count("\n\n") == 59999


PARAGRAPHS = [f"{w} the old harbour was rebuilt after the great storm, and the council paid the masons in grain and cloth for it." for w in ("First", "Then", "Later", "At last")]
ARTICLE = "<h1>The harbour of the town</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>Shop</a></li></ul></nav>"
FOOT = "<footer><p>Copyright of the paper, all rights reserved.</p></footer>"


def framed(html="", body="", main="", article="", wrapper="", outer="div"):
    attr = lambda v: f" {v}" if v else ""
    return f"<html{attr(html)}><body{attr(body)}>{MENU}<{outer}{attr(wrapper)}><main{attr(main)}><article{attr(article)}>{ARTICLE}</article></main></{outer}>{FOOT}</body></html>"


def plain(html="", body="", wrapper="", outer="div"):
    """Without main and article."""
    attr = lambda v: f" {v}" if v else ""
    return f"<html{attr(html)}><body{attr(body)}><{outer}{attr(wrapper)}>{MENU}<div>{ARTICLE}</div>{FOOT}</{outer}></body></html>"


def test_names_on_outer_elements_lose_no_page():
    w = M.classifier()
    want = "\n\n".join(["The harbour of the town", *PARAGRAPHS])
    for page in [
        framed(body='class="single comments-enabled has-sidebar"'), framed(body='class="nav-open ad-free"'), framed(body='class="home search-enabled"'), framed(body='id="privacy-page"'), framed(html='class="js no-ads"'),
        framed(article='class="post type-post category-ads tag-newsletter"'), framed(article='class="post comments-open"'), framed(wrapper='class="container with-sidebar"'), framed(wrapper='id="aspnetForm"', outer="form"), framed(wrapper='class="side-by-side"'),
        plain(body='class="single comments-enabled has-sidebar"'), plain(wrapper='class="container with-sidebar"'), plain(wrapper='id="aspnetForm"', outer="form"), plain(wrapper='class="side-by-side"'),
    ]:
        assert M.main_text(page, w) == want, page[:120]


def test_every_hint_word_on_every_frame():
    w = M.classifier()
    for word in sorted(M._HINT):
        for name in (word, f"has-{word}", f"{word}-open", f"x-{word}", f"{word}-x"):
            c = f'class="{name}"'
            for page in (framed(html=c), framed(body=c), framed(main=c), framed(wrapper=c), plain(html=c), plain(body=c), plain(wrapper=c), *([framed(article=c)] if M._HINT[word] not in ("comment", "ad") or name != word else [])):
                text = M.main_text(page, w)
                assert all(p in text for p in PARAGRAPHS) and "Home" not in text, (name, page[:150])


def test_zones_inside_a_page_still_go():
    w = M.classifier()
    for zone in ("<div class='comments'><article class='comment'><p>{0}</p></article></div>", "<ol class='comment-list'><li><article><p>{0}</p></article></li></ol>", "<aside class='widget-area'><p>{0}</p></aside>", "<div class='sidebar-left'><p>{0}</p></div>", "<form class='subscribe'><p>{0}</p></form>", "<div class='google-ad'><p>{0}</p></div>"):
        other = "Somebody else says something that is not of the article at all, and at some length too."
        text = M.main_text(framed().replace(FOOT, zone.format(other) + FOOT), w)
        assert other not in text and all(p in text for p in PARAGRAPHS), zone
