import html as entities
import random
import re
import time
from html.parser import HTMLParser

import pytest

from cuemill.llm import html_text as H

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<head><title>t</title><style>p{}</style></head><body>a<script>var t='</p>';</script>b", "ab"),
    ("<ul><li>x<li>y<ol><li>1</li><li>2</ol><li>z</ul>end", "- x\n- y\n  1. 1\n  2. 2\n- z\n\nend"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
    ("<div hidden>no</div><div style='display: none'>no</div><p aria-hidden=\"true\">seen</p><div>yes</div>", "seen\n\nyes"),
    ("<!-- c --><!DOCTYPE html><p>  a \n  b  <b> c</b></p><pre>x\n  y</pre>", "a b c\n\nx\n  y"),
    ("<h1>T</h1><div>a<div>b</div>c</div>", "T\n\na\nb\nc"),
    ("a</p></table>b <unclosed attr=\"x> c", "ab"),
    ("<div style='display:\tnone'>no</div><div style=' DISPLAY /* x */ : none !important;color:red'>no</div>a", "a"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<select><option>one<option selected>two</select><textarea>\n a\n  b</textarea><math><mi>x</mi><mo>=</mo></math><svg><title>no</title><text>drawn</text></svg>", "one\ntwo\n a\n  b\nx=drawn"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog><dialog open>d</dialog>", "s\nt\nyes\nd"),
    ("<table><tr><td colspan=2>wide head of two<td>z<tr><td>a<td>b<td>c<tr><td>aa<td>bb<td>cc</table>", "wide head of two  z\na   b             c\naa  bb            cc"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>long<td>3</table>", "r     1\n      2\nlong  3"),
    ("<ol start=5><li>a<li>b</ol>", "5. a\n6. b"),
    ("&#" + "9" * 6000 + "; &#x" + "f" * 5000 + " &#" + "0" * 5000 + "65; &amp;lt;", "\ufffd \ufffd A &lt;"),
    ("a<?pi x>b<!x>c</ >d<3 e<", "abcd<3 e<"),
    ("<p>a</br>b</p>c</p>d<pre>\n x\n</pre>", "a\nb\n\ncd\n\n x"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
    ("<img alt='pic'> &lt;b&gt; 5 < 6", "pic <b> 5 < 6"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_rendering(source, want):
    assert H.extract(source) == want


def test_deep_and_long():
    assert H.extract("<div>" * 50_000 + "x") == "x"
    assert len(H.extract("<p>" + "word " * 200_000)) == 999_999


@pytest.mark.parametrize("bad", ["<a", "<a ", "<a b=", "<a b='", '<a b="<a \'', "<!--", "<!", "</", "</a", "&#", "&", "<ul><li>", "<table><tr><td>", "<b></i>", "<table><b></p>", "<p><td>", "<script>", "<table><td rowspan=99 colspan=999>x", "<tr><td>", "<pre>\n"])
def test_hostile_markup_takes_linear_time(bad):
    source = (bad * (1_000_000 // len(bad)))[:1_000_000]
    began = time.process_time()
    assert len(H.extract(source)) <= 6_000_000
    assert time.process_time() - began < 12  # a megabyte; quadratic steps would take minutes


def test_wide_cell_does_not_multiply():
    out = H.extract("<table><tr><td>" + "w" * 300_000 + "<td>x" + "<tr><td>a<td>b" * 20_000 + "</table>")
    assert len(out) < 2_000_000 and "a  b" in out


class Plain(HTMLParser):
    """An independent renderer of well-formed trees: visible words in order, and a mark where a block begins or ends."""

    BLOCKS = {"p", "div", "ul", "ol", "li", "h2", "table", "tr", "td", "section", "blockquote"}

    def __init__(self):
        super().__init__()
        self.parts, self.unseen = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
            return
        a = dict(attrs)
        self.unseen.append((self.unseen[-1] if self.unseen else False) or tag in ("script", "style") or "hidden" in a or "none" in a.get("style", ""))
        if tag in self.BLOCKS and not self.unseen[-1]:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if not self.unseen.pop() and tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not any(self.unseen[-1:]):
            self.parts.append(data)


def made(rng, depth):
    word = lambda: "".join(rng.choice("abcdé&<") for _ in range(rng.randrange(1, 6)))
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["text", "text", "inline", "block", "list", "hidden", "raw", "br"]) if depth else "text"
        inner = lambda: made(rng, depth - 1)
        if kind == "text":
            out.append(entities.escape(" ".join(word() for _ in range(rng.randrange(1, 4)))) + " ")
        elif kind == "inline":
            tag = rng.choice(["b", "span", "a", "em"])
            out.append(f"<{tag} class='x>y'>{inner()}</{tag}>")
        elif kind == "block":
            tag = rng.choice(["div", "section", "blockquote"])
            out.append(f"<{tag}>{inner()}</{tag}>")
        elif kind == "list":
            out.append("<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(rng.randrange(1, 3))) + "</ul>")
        elif kind == "hidden":
            out.append(rng.choice(["<div hidden>", "<div style='display:none'>"]) + inner() + "</div>")
        elif kind == "raw":
            out.append("<script>if (a < b) { '<p>' }</script>")
        else:
            out.append("<br>")
    return "".join(out)


def test_against_an_independent_renderer():
    rng = random.Random(7)
    for _ in range(400):
        source = made(rng, 4)
        plain = Plain()
        plain.feed(source)
        plain.close()
        want = [" ".join(line.split()) for line in "".join(plain.parts).split("\n")]
        got = [re.sub(r"^\s*(- )*", "", line) for line in H.extract(source).split("\n")]
        assert [x for x in got if x] == [x for x in want if x], source


def test_query(spark):
    df = H.op7_html_text(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert not any("var t=" in r.text or "{margin" in r.text or "<p>" in r.text for r in rows)
    odd = spark.createDataFrame([(1, None, "k"), (None, "<p>a", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in H.extract_text(odd).collect()) == ["", "a"]
    assert H.extract_text(odd.limit(0)).count() == 0
