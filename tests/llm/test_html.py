import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from plumbline.llm import queries
from plumbline.llm.htmltext import UNSEEN, VOID, extract, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"), ("x<script>var a='</p>';</script>y<style>p{}</style>", "xy"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"), ("<!-- no --><title>no</title><body>yes", "yes"), ("&lt;b&gt; &amp; &eacute;&#8364;", "<b> & é€"), ("<b>bo</b>ld <i>it</i>", "bold it"), ("<pre>a\n  b</pre>", "a\n  b"),
    ],
)
def test_render(page, text):
    assert render(page).strip() == text


#: Pages with the text that a reader of the layout rules expects, written by hand.
GOLDEN = {
    "<ul><li>one<li>two<ol><li>x<li>y</ol><li>three</ul>": "- one\n- two\n  1. x\n  2. y\n- three",
    "<ol start=3><li><p>a<p>b<li>c</ol>after": "3. a\n\n   b\n\n4. c\n\nafter",
    "<ul><li>a<ul><li>b</ul></ul><p>end": "- a\n  - b\n\nend",
    "<dl><dt>term<dd>definition<dt>two<dd>more</dl>": "term\n  definition\ntwo\n  more",
    "<table><tr><th>name<th>n<tr><td>a long one<td>1<tr><td>b<td>22</table>": "name       | n\na long one | 1\nb          | 22",
    "<table><caption>Cap</caption><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>x<br>y</td><td>1</td></tr><tr><td colspan=2>wide cell</td></tr></tbody></table>": "Cap\nk | v\nx | 1\ny |\nwide cell",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in | out",
    "<h1>Title</h1><p>First para\n with <b>bold</b> and <a href=x>link</a>.</p><p>Second<br>next line</p><hr><blockquote><p>quoted<p>more</blockquote><div>tail</div>": "Title\n\nFirst para with bold and link.\n\nSecond\nnext line\n\n  quoted\n\n  more\n\ntail",
    "<div><span style='visibility:hidden'>no</span>yes<span hidden>no</span></div><pre>  keep\n   this</pre>x": "yes\n\n  keep\n   this\n\nx",
    "<p>one<div>two</p>three</div><select><option>a<option>b</select>": "one\n\ntwo\n\nthree\na\nb",
}


@pytest.mark.parametrize("page", GOLDEN)
def test_golden_pages(page):
    assert render(page) == GOLDEN[page]


class Visible(HTMLParser):
    """The words that a page shows, by the standard library's parser and a stack of its own."""

    def __init__(self):
        super().__init__()
        self.words, self.open = [], []

    def hidden(self, attrs):
        a = {k: (v or "") for k, v in attrs}
        style = a.get("style", "").replace(" ", "").lower()
        return "hidden" in a or "display:none" in style or "visibility:hidden" in style

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append((tag, tag in UNSEEN or self.hidden(attrs)))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(dark for _, dark in self.open):
            self.words += re.findall(r"\w+", data)


def test_words_of_pages_are_those_of_another_parser(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op7_html_text(spark, small).collect()}
    assert got.keys() == pages.keys() and len(pages) > 20
    for i, page in pages.items():
        other = Visible()
        other.feed(page or "")
        other.close()
        want, found = Counter(other.words), Counter(re.findall(r"\w+", got[i]))
        assert not want - found, i
        assert all(w.isdecimal() for w in found - want), i  # the numbers of ordered lists


def test_a_very_long_page_as_a_row(spark):
    page = "<p>" + "word " * 400_000 + "<table>" + "<tr><td>a<td>b" * 20_000
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert out[2] == "" and out[1].count("word") == 400_000 and out[1].count("a | b") == 20_000


@pytest.mark.parametrize("page", ["<div>" * 20000 + "deep", "<a href='" * 5000, "<" * 50000, "<table>" * 3000 + "<td>x", "</p>" * 10000 + "y", "<!--" * 10000, "&" * 50000, "<p " + "a=b " * 20000 + ">z"])
def test_hostile_pages_end(page):
    render(page)


def test_frames(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (1, "<p>a")], "page_id long, html string")
    assert sorted((r["page_id"], r["text"].strip()) for r in extract(df).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert extract(df.limit(0)).count() == 0
    clashing = df.withColumnRenamed("page_id", "Text")
    assert sorted((r["Text"], r["text_"].strip()) for r in extract(clashing).collect()) == [(1, "a"), (1, "a"), (2, "")]
