from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkevidence.functions import urls
from sparkevidence.sources import pages

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, sections 5.4.1 and 5.4.2 (strict). Fixed values.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def resolve(spark, pairs):
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b string, r string")
    return [x[0] for x in d.select("i", urls.resolved(F.col("b"), F.col("r")).alias("t")).orderBy("i").select("t").collect()]


def test_examples_of_the_standard(spark):
    assert resolve(spark, [(BASE, r) for r in EXAMPLES]) == list(EXAMPLES.values())
    assert resolve(spark, [("https://x.org", "y"), ("https://x.org", ""), (None, "y"), ("http://a/", None), ("http://a/b", " /c\n")]) == ["https://x.org/y", "https://x.org", None, None, "http://a/c"]


PIECE = st.sampled_from(["a", "b.c", ".", "..", "x y", "ü", "%20"])
PATH = st.lists(PIECE, max_size=6).map("/".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(PATH, PATH, st.sampled_from(["", "?q=1", "?a/../b"]), st.sampled_from(["", "/"])), min_size=30, max_size=60))
def test_against_the_library(spark, cases):
    pairs = [(f"https://h.org/{b}", f"{lead}{r}{q}") for b, r, q, lead in cases]
    pairs = [p for p in pairs if "//" not in p[1] and "//" not in p[0][8:]]  # empty segments and hosts are told apart differently there
    assert resolve(spark, pairs) == [urljoin(*p) for p in pairs]


def test_links_of_pages(spark):
    html = '<a href="/x?a=1&amp;b=2#top">1</a><a href="mailto:a@b.org">m</a><A HREF="JavaScript:go()">j</A><a href="../up">u</a><a>none</a><a href="">self</a><a href="ftp://f.org/z">f</a><a href="//other.org/p">o</a>'
    d = spark.createDataFrame([(1, "https://h.org/a/b/c?d#e", html), (2, "https://h.org/", None)], "page_id long, url string, html string")
    got = [(x["page_id"], x["target"]) for x in pages.page_links(pages.extract_pages(d)).orderBy("page_id", "link_no").collect()]
    assert got == [(1, "https://h.org/x?a=1&b=2"), (1, "https://h.org/a/up"), (1, "https://other.org/p")]
