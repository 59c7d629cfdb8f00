import pytest
from pyspark.sql import functions as F

from quirework.functions import css, html, links, text
from quirework.operators.library import scanned

SHEET = """/* head */ @namespace svg url(http://x); @import url("b.css");
@font-face { font-family: "A;B"; src: url(x) }
body { margin: 0; color : red; color: blue; bad; : x; y: }
@media screen and (min-width: 480px) { p { a: b } h1 { c: d } }
@page { margin: 1cm } h1, h2 { content: "a;b" } @keyframes k { from { x: y } }"""


def test_css_rules():
    got = css.rules(SHEET)
    assert [r["kind"] for r in got] == ["namespace", "import", "font-face", "style", "media", "style", "style", "page", "style", "other"]
    assert got[3]["declarations"] == {"margin": "0", "color": "blue"} and got[2]["declarations"]["font-family"] == '"A;B"'
    assert got[4]["query"] == "screen and (min-width: 480px)" and got[5]["parent"] == 4 and got[8]["selectors"] == "h1, h2" and got[8]["declarations"] == {"content": '"a;b"'}
    assert got[9]["name"] == "keyframes k"
    assert css.rules("a { b: c /* d } e { f: g }") == css.rules("a { b: c ") and css.rules("") == []


def test_selectors():
    assert css.simple_selectors("p.a.b#c, *, h1 > p, a:hover, x[y], ") == [("p", ["a", "b"], ["c"]), (None, [], []), (None, [], [])]
    nodes = html.parse('<div id="main"><p>a</p><p class="hl big">b</p></div>')
    styles = css.cascade(nodes, css.rules("#main { background: blue } p { color: red; font-size: 12px } .hl { color: yellow; font-weight: bold } div p { color: no }"))
    assert [s for s in styles.values() if s] == [{"background": "blue"}, {"color": "red", "font-size": "12px"}, {"color": "yellow", "font-size": "12px", "font-weight": "bold"}]


@pytest.mark.parametrize(("markup", "expected"), [
    ("<html><body><h1>A</h1><p>b c</p><p>d</p></body></html>", "A\nb c\nd"), ("<p>a<br>b<br/>c</p>", "a\nb\nc"), ("<p>x<!-- <p>no</p> -->y</p>", "xy"),
    ("<script>var t=\"</p>\";</script><p>z", 'var t="</p>";z'), ("<p>a &amp; b &copyb &#65; &#x42;</p>", "a & b &copyb A B"), ("<li>1<li>2", "12"), ("", ""), ("plain", "plain"),
    ("<p>a\r\n b </p>", "a\nb"),
])
def test_text(markup, expected):
    nodes = html.parse(markup)
    assert html.text_of(nodes) == expected and html.from_tree(html.to_tree(nodes)) == nodes


def test_titles():
    assert html.title_of(html.parse("<title>t</title><h2>x</h2>")) == "x" and html.title_of(html.parse("<title>t</title><h1> </h1>")) == "t"
    assert html.title_of(html.parse("<h1><b>a</b>b</h1>")) == "a" and html.title_of(html.parse("<p> z</p>")) == "z" and html.title_of(html.parse("")) is None
    assert html.rendered(html.parse('<html><head><title>x</title></head><body><p onclick="x" class="c">a<script>b</script></p><x_y>c</x_y></body></html>')) == '<p class="c">a</p><div>c</div>'


def test_jvm_expressions(spark):
    cases = ["<html><p>a  b</p>x<hr/>y<br>z</html>", "a<b", "<p>　x </p><LI>q &amp;", "", "<pre>1</pre>2", "\n<h1>T</h1>\n\nx\n"]
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in frame.select(text.markup_text(F.col("t"))).collect()] == [scanned(c) for c in cases]
    one = lambda column: spark.createDataFrame([(1,)], "x int").select(column).first()[0]
    assert one(text.word_count(F.lit("a b　c \n d"))) == 4 and one(text.char_count(F.lit("a😀é"))) == 3 and one(text.clean_lines(F.lit(" a \r\n\n b"))) == "a\nb"
    assert one(text.first_line(F.lit("\n  \n x y \n z"))) == "x y" and one(text.first_line(F.lit(" "))) is None and one(text.paragraphs(F.lit("a\n\n b \n \nc"))) == ["a", "b", "c"]
    assert one(text.file_stem(F.lit("a/b.c.xhtml"))) == "b.c" and one(text.file_stem(F.lit("a/.hid"))) == ".hid" and one(text.toc_title(F.lit(" "), F.lit("x/y.html"))) == "y"
    assert one(text.lossy_text(F.lit(bytearray(b"a\xffb")))) == "a�b" and one(text.strict_text(F.lit(bytearray(b"a\xffb")))) is None and one(text.image_type(F.lit("a.PNG"))) == "image/png"
    for path, expected in (("a\\b/../c//./d", "a/c/d"), ("../../x", "x"), ("", ""), ("..", "")):
        assert one(links.normal_path(F.lit(path))) == expected
    for base, href, expected in (("a/b.x", "c.x#f", "a/c.x#f"), ("a/b.x", "/c", "c"), ("a/b.x", "  ", "a/b.x"), ("b.x", "../q", "q"), ("a/b.x", "tel:1", "a/tel:1"), ("a/b.x", "https://q", "https://q")):
        assert one(links.resolved(F.lit(base), F.lit(href))) == expected
    assert one(links.joined(F.lit("O/c.opf"), F.lit("../a"))) == "O/../a" and one(links.joined(F.lit("c.opf"), F.lit("a"))) == "a" and one(links.chapter_key(F.lit("/a\\b#c"))) == "a/b"
    assert one(links.is_external(F.lit("mailto:x"))) and not one(links.is_external(F.lit("HTTP://x")))
