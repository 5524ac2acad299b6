"""Main text against an independent parser on all test pages, and on pages without marked content."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from queuelens.llm import html

PAGES = [p or "" for p in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()]


class Article(HTMLParser):
    """The text of the page's article, block by block; the standard library finds the tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in html.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.skip -= tag in ("script", "style")
        if tag not in html.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_equals_an_independent_parser():
    assert len(PAGES) >= 25
    for page in PAGES:
        parser = Article()
        parser.feed(page)
        parser.close()
        assert html.content(page) == " ".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


PLAIN = """<html><body><div><a href=/>Home</a> <a href=/a>About us</a></div><ul><li><a href=1>One story</a><li><a href=2>Another story</a></ul>
<div><h2>Title</h2><p>A first paragraph, with commas, and with a lot of text. It goes on, and on, for a while.</p><ul><li>a short item<li>b</ul>
<ul><li><a href=3>Read this</a><li><a href=4>Read that</a></ul><p>Another paragraph, as long as the first one, or so. It ends here.</p></div><div>Copyright by us</div></body></html>"""
TEXT = "Title A first paragraph, with commas, and with a lot of text. It goes on, and on, for a while. a short item b Another paragraph, as long as the first one, or so. It ends here."


def test_ratios_decide(monkeypatch):
    assert html.content(PLAIN) == TEXT
    assert html.content(f"<article>{PLAIN}</article>") != TEXT and "Read this" not in html.content(f"<article>{PLAIN}</article>")
    monkeypatch.setattr(html, "ratios", lambda found, *_: (np.ones(len(found)), np.zeros(len(found), bool)))
    assert html.content(PLAIN) != TEXT and "Home" in html.content(PLAIN)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p title=it's>Some text, here.</p><p>More text, it's fine.</p></article>", "Some text, here. More text, it's fine."),
        ("<article><p>Hello <span class='ad'>BUY NOW</span> there <span hidden>HID</span>you.</p></article>", "Hello there you."),
        ("<article><p>a<span class=ad><b>x</span>b <i hidden>y<p>c</article>", "ab c"),
        ("<div><p>The post, which is long. It has words, many of them.</p></div><article class=comment>I agree with it all, really!</article>", "The post, which is long. It has words, many of them."),
        ("<article><p>a &lt b &#65;&#x42; &amp;amp; &copy &#00000000065; &#99999999999;</p></article>", "a < b AB &amp; © A �"),
        ("<p>5 < 6 and 7 > 3<!-- no --> yes<!--> too", "5 < 6 and 7 > 3 yes too"),
        ("<p>kept<p>cut <b class='", "kept cut"),
        ("<div class=ad>A very long advert, with a lot of text. And more of it, and more.</div><article><h1>Hi.</h1></article>", "Hi."),
        ("<p>one <a href=x>two</a> three", "one two three"),
        ("<nav>a</nav><footer>b</footer>", ""),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<script>var a = '<p>no</p>';</script><STYLE>p{}</STYLE >yes", "yes"),
        ("\x00<p>�  x", "\x00 � x"),
    ],
)
def test_odd_pages(page, text):
    assert html.content(page) == text


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "</p>x", "<p '", "&", "<!--", '<a x="', "<li><span class=ad>x", "<script>", "<p>&#" + "0" * 500, "< ", "<x/>"])
def test_long_pages_take_linear_time(unit):
    page = unit * (400_000 // len(unit))
    began = time.process_time()
    html.content(page)
    assert time.process_time() - began < 8


def test_marks_are_whole_names():
    """A word inside a name is no mark; a name of marks, or of marks and places, is."""
    prose = "<p>" + "Some long sentence, with commas, about the matter. " * 6 + "</p>"
    for attribute in ("class='search-algorithms'", "class='comment-period'", "class=related-work", "id='menu-engineering'", "class='socialHistory'"):
        assert "kept words" in html.content(f"<article>{prose}<section {attribute}><p>kept words, here.</p></section>{prose}</article>"), attribute
    for attribute in ("class='left-sidebar'", "class=relatedPosts", "id=comments2", "class='x cookie-notice'", "class='main-nav-links'"):
        assert "lost words" not in html.content(f"<article>{prose}<section {attribute}><p>lost words, here.</p></section>{prose}</article>"), attribute
