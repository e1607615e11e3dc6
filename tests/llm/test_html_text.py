"""Layout on hand-written pages; visible words of the table against the standard library's parser."""

import random
from html.parser import HTMLParser

import pytest

from specband.llm.html_text import html_text, visible_text

CASES = {
    "<p>a<p>b <b>c</b>\n d": "a\n\nb c d",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "<ul><li>x<li>y<ol start=3><li>z<li value=9>w</ol><li>v</ul>": "* x\n* y\n  3. z\n  9. w\n* v",
    "<table><tr><td>aa<td>b<tr><td>c<td>dddd<br>e</table>end": "aa  b\nc   dddd\n    e\n\nend",
    "<table><caption>T</caption><thead><tr><th>k<th>v<tbody><tr><td colspan=2>wide one<tr><td>1<td>2</table>": "T\nk  v\nwide one\n1  2",
    "<table><tr><td>o<td><table><tr><td>in<td>ner</table><tr><td>pp<td>q</table>": "o   in  ner\npp  q",
    "a<script>if (a<b) '</p>'</script><style>p{}</style><!-- c > --><div hidden>h</div><p style='display : none'>n</p><i style=\"visibility:hidden\">v</i>b": "ab",
    "<head><title>t</title><body>seen": "seen",
    "<pre>  k\n\n   l</pre>m": "  k\n\n   l\n\nm",
    "&amp;&nbsp;&lt;p&gt; &#233;&#x1F642; &unknown;": "& <p> é🙂 &unknown;",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<blockquote>q<p>r</blockquote>s": "    q\n\n    r\n\ns",
    "one<!-- open": "one", "<p>un<b>closed": "unclosed", "</p>x</div>": "x", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<select><option>a<option>b</select><textarea>t</textarea>v": "atv", "<a href='x>y'>z</a>": "z", "": "", "   ": "", "<td>lone": "lone",
}


@pytest.mark.parametrize("page", list(CASES))
def test_layout(page):
    assert visible_text(page) == CASES[page]


def test_stray_quotes():
    assert visible_text('<a href="x"">one</a> <p class="b">two</p> <i id="c">three</i> end') == "one\n\ntwo\n\nthree end"
    assert visible_text("<p class=it's>Don't stop</p>") == "Don't stop"
    assert visible_text("<a title=x\"hidden>a</a><b '>b</b><i x=\"1\"y='>'>c</i>") == "abc"
    assert visible_text("<a href='>'>z</a><a href = \">\">y</a><img alt=a=\"b>c") == "zyc"


TABLES = {
    "<table><thead><th>Name<th>Age<tr><td>a<td>b</table>": "Name  Age\na     b", "<table><tbody><td>x</table>y": "x\n\ny", "<table><td>a<td>b<tr><td>c</table>": "a  b\nc",
    "<table><tbody>loose<tr><td>a</table>": "loose\na", "<table><form><p>f</p><tr><td>a</form></table>": "f\na", "<table><colgroup>k<tr><td>a</table>": "k\na",
    "<table><tr><td><div>a<td>b</table>": "a  b", "<table><tr><td>a<template><tr><td>no</template>b<td>c</table>": "ab  c",
}


@pytest.mark.parametrize("page", list(TABLES))
def test_all_text_of_tables(page):
    assert visible_text(page) == TABLES[page]


def test_shown_elements():
    assert visible_text("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "x=1"
    assert visible_text("<svg><title>no</title><defs><text>no</text></defs><text>one</text><text>two</text></svg>") == "one\ntwo"
    assert visible_text("<p aria-hidden=true>a<svg><style>b{}</style></svg>") == "a"
    assert visible_text("<head><title>t</title><p>seen") == "seen" and visible_text("<head>seen") == "seen"


SPANS = {
    "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A  b\n   c",
    "<table><tr><td>a<td rowspan=2 colspan=2>B<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h<td>i</table>": "a  B     c\nd        e\nf  g  h  i",
    "<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>": "x  1\n   2\n   3",
    "<table><tr><td rowspan=3>x<tr><tr><td>y</table>": "x\n   y",
    "<table><tr><td>漢字<td>b<tr><td>abc<td>d<tr><td>e\u0301<td>f</table>": "漢字  b\nabc   d\ne\u0301     f",
    "<table><tr><td rowspan=x colspan=-1>a<td>b</table>": "a  b",
}


@pytest.mark.parametrize("page", list(SPANS))
def test_spans_and_widths(page):
    assert visible_text(page) == SPANS[page]


def grid(cells):
    """Plain layout: place every cell on a dense grid, then print each row of one-line cells."""
    used, at = {}, []
    for r, row in enumerate(cells):
        c = 0
        for text, wide, high in row:
            while (r, c) in used:
                c += 1
            for i in range(high):
                for j in range(wide):
                    used[r + i, c + j] = ""
            at.append((r, c, wide, text))
            c += wide
    widths = [0] * (max(c + w for _, c, w, _ in at))
    for _, c, w, text in at:
        if w == 1:
            widths[c] = max(widths[c], len(text))
    lines = []
    for r in range(len(cells)):
        line = ""
        for k, (_, c, _, text) in enumerate([x for x in at if x[0] == r]):
            line = (line + "  " if k else "").ljust(sum(widths[:c]) + 2 * c) + text
        lines.append(line.rstrip())
    return "\n".join(x for x in lines if x)


def test_random_grids():
    r = random.Random(4)
    for _ in range(200):
        cells = [[("".join(r.choice("abc") for _ in range(r.randrange(1, 6))), r.choice([1, 1, 1, 2]), r.choice([1, 1, 2])) for _ in range(r.randrange(1, 5))] for _ in range(4)]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}</td>" for t, w, h in row) + "</tr>" for row in cells) + "</table>"
        assert visible_text(page) == grid(cells)


def test_sections_outside_drawings_are_comments():
    assert visible_text("x<![CDATA[secret]]>y") == "xy" and visible_text("x<![CDATA[a>b]]>y") == "xb]]>y" and visible_text("x<![CDATA[open") == "x"
    assert visible_text("<svg><text><![CDATA[a<b]]></text></svg>") == "a<b" and visible_text("<math><mi><![CDATA[k]]></mi></math>") == "k"


def test_visible_parts_of_hidden_elements():
    assert visible_text("<div style='visibility:hidden'>a<b style='visibility: visible'>b<i>c</i></b>d</div>e") == "bc\ne"
    assert visible_text("<ul style='visibility:collapse'><li>a<li style='visibility:visible'>b</ul>") == "* b"
    assert visible_text("<p style='visibility:hidden; visibility:visible'>a<textarea style='visibility:hidden'>no</textarea>") == "a"
    assert visible_text("<div style='display:none'>a<b style='visibility:visible'>b</b></div>c") == "c"
    assert visible_text("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>") == "  b"


def test_controls():
    assert visible_text("<select><option>a<option selected>b<option>c</select>") == "b"
    assert visible_text("<select multiple><optgroup label=g><option>a<option> b  c</optgroup><option hidden>d</select>") == "a b c"
    assert visible_text("<select size=3><option>a<option>b</select>") == "a b" and visible_text("<select></select>x") == "x"
    assert visible_text("<textarea>\n k &amp; l\n m</textarea>") == " k & l\n m"
    assert visible_text("<input value=v> <input type=submit> <input type=button value='Go on'> <input type=hidden value=no><input type=password value=no><input>") == "v Submit Go on"
    assert visible_text("<button>Send <b>now</b></button>") == "Send now"


def test_any_depth():
    deep = "<b>" * 300
    assert visible_text(deep + "<i hidden>no</i><u style='display:none'>no</u>a</i></b>b") == "ab"
    assert visible_text("<ul><li>out" + deep + "<li>x</li></ul>" + "y") == "* out\n* x\n\ny"
    assert visible_text("<div>" * 300 + "<p>a</p><p>b</p>" + "</div>" * 300 + "<p>c") == "a\n\nb\n\nc"
    assert visible_text("<font>" * 100000 + "x" + "</i>" * 10000) == "x"
    assert visible_text("<table><tr><td>x<td>" * 3000).split() == ["x"] * 3000
    assert visible_text("<blockquote>x" * 20000).split() == ["x"] * 20000


def test_deep_and_long():
    assert visible_text("<div>" * 5000 + "x") == "x"
    assert visible_text("<ul><li>" * 2000 + "x").endswith("x")
    assert visible_text("<table><tr><td>" * 1000 + "x").endswith("x")
    assert visible_text("<b>w</b> " * 50000) == " ".join(["w"] * 50000)
    assert visible_text("<" * 20000 + "a='" * 5000).startswith("<<")


def test_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "v", ""), (3, "w", "<p>b")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS `in`")
    got = sorted((tuple(r) for r in html_text(df, keep=["url"]).collect()), key=str)
    assert got == sorted([(1, "a", "u"), (1, "a", "u"), (2, None, None), (None, "", "v"), (3, "b", "w")], key=str)
    assert html_text(df.limit(0)).count() == 0


class Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style", "title")
        self.out.append(" " if tag in ("p", "li", "br", "div", "h1", "footer", "nav", "ul", "article") else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style", "title")
        self.out.append(" " if tag in ("p", "li", "div", "h1", "footer", "nav", "ul", "article") else "")

    def handle_data(self, data):
        self.out.append("" if self.off else data)


def test_words_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text(pages).collect():
        w = Words()
        w.feed(html[r.page_id])
        assert [x for x in r.text.split() if x != "*"] == [x for x in "".join(w.out).split() if x != "*"]
