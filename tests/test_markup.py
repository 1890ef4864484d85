import pytest
from pyspark.sql import functions as F

from sparkevidence.operators import chunk_quality, markup

RAW = [
    "<div class='content'>leftover of a page</div>", "<secret>", "Something odd: <unknown>.", "Please use <div> today.", "Please use <script> today.", "Plain prose names a <widget> in passing.",
    '<div data-controller="menu" aria-label="Navigation">Menu</div>', "<div><span>cut off", '<main><section><div>A whole page</div></section></main>', 'class="hero" stays behind',
    '<input type="checkbox" checked>', "HTML example: <input checked>", 'HTML example: <input type="text" checked>', 'HTML example: <input type="checkbox" checked="checked">', 'HTML example: <input type="checkbox" checked style="x">',
    'HTML example: <a href="javascript:go()">x</a>', 'HTML example: <b onclick="go()">x</b>', 'HTML example: <span class="menu-item">x</span>', 'HTML example: <span class="a-b c-d e-f">x</span>', 'HTML example: <p align="left">x</p>',
    "HTML example: <b>never closed", "HTML example: <b><i>crossed</b></i>", "HTML example: " + "<b>x</b>" * 41, "HTML example: <script>run()</script>", 'Call /api/<token>/send and see <div class="navigation"><a href="/d">Docs</a></div>.',
    "HTML example: <footer>" + "long " * 60 + "</footer>", "<b broken=>x</b>", "</div>",
]
FINE = [
    None, "", "No markup, 2 < 3 and 4 > 1.", "Escaped &lt;b&gt; text.", "Inline `<div class=\"x\">` is code, ``<a `b>`` too.", "```\n<div>shown</div>\n```", "~~~html\n<script>x</script>\n~~~\nprose",
    "Supported tags: <b>bold</b>, <i>italic</i> and <u>underlined</u>.", "<p>One <mark>marked</mark> word</p>", "The element <div> groups others.", "Use the tags <b>, <i> or <u>.", "A line<br>broken<br/>twice",
    'A link <a href="https://example.org" title="t">x</a>', '<pre><code class="language-python">x = 1</code></pre>', '<table><tr><td align="center">1</td></tr></table>', "Own elements: <x-emoji item-id=\"5\"></x-emoji>.", '<details open><summary>More</summary>text</details>',
    "GET https://api.example.org/bot<token>/METHOD", "The command takes <provider>/<service>.", "Set referer=<your-url> in the request.", "Replace the name with <app name> before you go on.", "Use your <own key> in this example.",
    'HTML example: <input type="checkbox" checked> is a control.', "HTML example: <footer>short text</footer>", '<span class="note-box">x</span>', "less than < and > more", "text < as &lt; here>",
]


@pytest.mark.parametrize("text", RAW)
def test_residue_is_raw(text):
    assert markup.is_raw(text)


@pytest.mark.parametrize("text", FINE)
def test_documentation_is_not(text):
    assert not markup.is_raw(text)


def test_flag_and_report(spark):
    rows = [(1, i, "Some heading", t) for i, t in enumerate(RAW)] + [(2, i, "Some heading", t or "") for i, t in enumerate(FINE)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, heading string, content string").withColumn("source_name", F.concat(F.lit("s"), "document_id"))
    flags = {(r["document_id"], r["chunk_index"]): r["raw_html"] for r in chunk_quality.with_quality(chunks).collect()}
    assert all(flags[1, i] for i in range(len(RAW))) and not any(flags[2, i] for i in range(len(FINE)))
    report = {r["source_name"]: r["raw_html"] for r in chunk_quality.report(chunks).collect()}
    assert report == {"s1": len(RAW), "s2": 0}


def test_long_texts_take_linear_time():
    text = "word <b>x</b> " * 20_000
    assert markup.is_raw(text)  # more tags than an example has
    assert not markup.is_raw("`<x>` " * 20_000) and not markup.is_raw("<" * 50_000)
