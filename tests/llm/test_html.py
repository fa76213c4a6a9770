import pytest

from gridloom.llm import html_text

CASES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<p>a <b>bold</b>\n word</p>tail", "a bold word\n\ntail"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<head><title>T</title><style>p{}</style></head><body>x<script>var t='</p>'</script>y", "xy"),
    ("<!-- no --><p hidden>no</p><p style='color:red; display : none'>no</p><p aria-hidden=true>no</p><p style='visibility:hidden'>no</p>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=9><li>a</li><li>b</li><li value=20>c</ol>", "9. a\n10. b\n20. c"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><caption>C</caption><thead><tr><th>x</th></thead><tbody><tr><td>日本</td><td>z</td></tr></table>", "C\nx\n日本  z"),
    ("<pre>\n  a\n   b\n</pre>after", "  a\n   b\n\nafter"),
    ("a<br>b<br/><br>c", "a\nb\n\nc"),
    ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"),
    ("<p>x</div></b>y", "xy"),
    ("<img alt='pic'> <hr>z", "pic\n\n---\n\nz"),
    ("<select><option>o</select>v<template>t</template>", "o v"),  # a browser shows the option
    ("<select><option>o<option selected>p</select><select multiple><option>q<option>r</select>", "p q r"),
    ("a <textarea>typed text</textarea><datalist><option>d</datalist>", "a typed text"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>x<td rowspan=2 colspan=2>y<td>z<tr><td>p<td>q</table>", "x  y    z\np       q"),
    ("<html><head><title>t</title><body>only text", "only text"),
    ("<head><title>t</title>text that ends the head<p>more", "text that ends the head\n\nmore"),
    ("<div style='visibility:hidden'>no<p>no<b style='visibility: visible'>yes</b></div>", "yes"),
    ("<style>.ad, p#x {color:red; display:none} @media print {div{display:none}} /* b{display:none} */ i{visibility:hidden}</style><p class='big ad'>no<p id=x>no<div id=x>a</div><b>b</b><i>no</i><span class=ad style='display:inline'>c</span>", "a\nbc"),
    ("<ul><li style='visibility:hidden'>no<li>yes</ul>", "- yes"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_rules(page, text):
    assert html_text.extract(page) == text


def test_deep_and_long_pages_keep_their_text():
    deep = "".join(f"<div>{k} " for k in range(3000))
    assert html_text.extract(deep).split() == [str(k) for k in range(3000)]
    assert len(html_text.extract("<p>" + "word " * 200000).split()) == 200000


def test_hidden_elements_beyond_the_depth():
    deep = "<div>" * 300
    page = deep + "<script>var a='x'</script>one<p hidden>no<b>no</b></p>two<i style='display:none'>no<br>no</i>three<p aria-hidden=true>no<p>no</p></p>four"
    assert html_text.extract(page) == "onetwothreefour"


def test_operator(spark):
    rows = [(k, "u", p) for k, (p, _) in enumerate(CASES)] + [(None, None, "<p>n"), (0, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", df_lit()).repartition(3)
    got = html_text.page_texts(df).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted([(str(k), t) for k, (_, t) in enumerate(CASES)] + [("None", "n"), ("0", "")])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.page_texts(df.where("false")).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
