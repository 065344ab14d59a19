"""HTML conversion: expectations written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.html import convert, html_metadata, html_to_markdown

PAGES = [
    ("<body><nav>a<nav>b</nav>c</nav><p>kept</p></body>", "kept"),
    ("<div class='x ad'><div>inner</div>tail</div><p>kept</p>", "kept"),
    ("<div id=a><div class=sidebar><div><div>deep</div></div></div>after</div>", "after"),
    ("<p>caf&eacute; &frac12; &#8364; &amp;lt; &unknownx;</p>", "café ½ € &lt; &unknownx;"),
    ("<pre>  def f():\n      return 1\n\n\n\n  x</pre>", "```\n  def f():\n      return 1\n\n\n\n  x\n```"),
    ("<ol><li>one<li>two</ol><ol start=5><li>five</ol>", "1. one\n2. two\n\n5. five"),
    ("<ul><li>a<ul><li>b<ol><li>c</li></ol></li></ul></li><li>d</li></ul>", "- a\n  - b\n    1. c\n- d"),
    ("<table><tr><th>h1</th><th>h2</th></tr><tr><td>x|y</td><td>a\nb</td></tr></table>", "| h1 | h2 |\n| --- | --- |\n| x\\|y | a b |"),
    ("<table><tbody><tr><td>1<td>2<tr><td>3<td>4</table>", "| 1 | 2 |\n| --- | --- |\n| 3 | 4 |"),
    ("<h2>T <a href='/u'>l</a></h2><p>x <b>b</b> <em>e</em> <code>c</code><br>y<img alt=a src=i.png></p>", "## T [l](/u)\n\nx **b** *e* `c`\ny![](i.png)"),
    ("<p>open <b>bold</p><p>next</p>", "open bold\n\nnext"),
    ("a < b and c <!-- gone --> <script>if (a<b) x()</script>end", "a < b and c end"),
    ("<head><title>t</title><body>text", "text"),
    ("<p>one<p>two<hr>three", "one\n\ntwo\n\n---\n\nthree"),
    ("", ""), ("plain\ntext", "plain\ntext"),
]


@pytest.mark.parametrize("html,markdown", PAGES)
def test_pages_by_hand(html, markdown):
    assert convert(html, True) == markdown


def test_fragments_keep_all_blocks():
    assert convert("<nav>menu</nav><div class=ad>x</div><p>y</p>", False) == "menu\n\nx\n\ny"


def test_deep_nesting_and_private_characters():
    assert convert("<div>" * 5000 + "x" + "</div>" * 5000, True) == "x"
    assert convert("<pre> a\n  b</pre>", True) == "\n\n```\n a\n  b\n```"


def test_column_form_and_nulls(spark):
    df = spark.createDataFrame([("<nav>a</nav><p>b</p>", True), ("<nav>a</nav><p>b</p>", False), (None, True)], "h string, d boolean")
    assert [r.m for r in df.select(html_to_markdown(F.col("h"), F.col("d")).alias("m")).collect()] == ["b", "a\n\nb", None]


def test_metadata_lists(spark):
    html = """<html lang=en><head><title>T &amp; U</title><meta name="keywords" content="a, b ,,a"><meta content='c' property='article:tag'>
    <meta property="article:section" content="News"><meta property="article:section" content=" "><meta name=author content="X"></head></html>"""
    m = spark.createDataFrame([(html,), ("<p>none</p>",)], "h string").select(html_metadata(F.col("h")).alias("m")).collect()
    assert m[0].m["title"] == "T & U" and json.loads(m[0].m["tags"]) == ["a", "b", "c"] and json.loads(m[0].m["categories"]) == ["News"]
    assert "tags" not in m[1].m and "categories" not in m[1].m
