import pytest
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import activation

STORED = "source string, document_key string, version int, status string, content_hash string, signature string"
GOOD = "<html><head><title>T</title></head><body><h1>Heading of page {0}</h1><p>" + "This page tells in plain words how one thing works, and what to do when it does not. " * 3 + "</p><h2>More of {0}</h2><p>" + "Here stands a second section with some more useful sentences in it, as a reader may want. " * 3 + "</p></body></html>"
BAD = "<html><body><p>" + "Some words of text that say what has to be said here. " * 3 + "&lt;div class='x'&gt;left over&lt;/div&gt;</p></body></html>"


def setup(spark, pages, stored=(), allowed=("a.org", "b.org", "c.org")):
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    source = F.regexp_replace(T.url_domain(F.col("url")), "^www[.]", "")
    allowed = spark.createDataFrame([(a,) for a in allowed], "source string")
    fetched = p.withColumn("source", source).groupBy("source").agg(F.count_distinct(T.normalize_url(F.col("url"))).alias("pages"))
    return activation.incoming(p, source, allowed), spark.createDataFrame(list(stored), STORED), allowed, fetched


PAGES = [
    (1, "https://a.org/one?x=1", GOOD.format(1)), (2, "https://a.org/two", GOOD.format(2)), (3, "https://www.a.org/three/", GOOD.format(3)), (4, "https://a.org/one#again", GOOD.format("one, anew")), (5, "https://a.org/login", GOOD.format(5)),
    (6, "https://b.org/good", GOOD.format(6)), (7, "https://b.org/bad", BAD), (8, "https://d.net/x", GOOD.format(8)), (9, "https://a.org/pic.png", "x"), (10, "https://b.org/null", None),
]
STORED_ROWS = [("a.org", "a.org/two", 1, "archived", "h0", activation.SIGNATURE), ("a.org", "a.org/two", 2, "active", "h1", activation.SIGNATURE), ("a.org", "a.org/gone", 1, "active", "h2", activation.SIGNATURE), ("b.org", "b.org/good", 1, "active", "h3", activation.SIGNATURE)]


@pytest.fixture
def run(spark):
    return activation.activate(*setup(spark, PAGES, STORED_ROWS))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_report_by_source(run):
    got = {r["source"]: r.asDict() for r in run.report.collect()}
    assert set(got) == {"a.org", "b.org", "c.org"}
    a, b, c = (got[s] for s in ("a.org", "b.org", "c.org"))
    assert (a["status"], a["new"], a["changed"], a["unchanged"], a["reasons"]) == ("active", 2, 1, 0, "") and a["chunks"] >= 6 and a["fetched"] == 5 and a["failed"] == 2
    assert (b["status"], b["reasons"], b["new"], b["changed"]) == ("blocked", "raw_html", 1, 1)
    assert (c["status"], c["fetched"], c["reasons"]) == ("failed", 0, "no_pages")


def test_only_sources_that_pass_change(run):
    documents = rows(run.documents, "document_key", "version", "status")
    assert documents == [("a.org/gone", 1, "active"), ("a.org/one", 1, "active"), ("a.org/three", 1, "active"), ("a.org/two", 1, "archived"), ("a.org/two", 2, "archived"), ("a.org/two", 3, "active"), ("b.org/good", 1, "active")]
    assert {r[0] for r in rows(run.documents, "source")} == {"a.org", "b.org"}
    assert {r[0] for r in rows(run.sections, "source")} == {"a.org"} == {r[0] for r in rows(run.chunks, "source")}
    of_two = [r for r in rows(run.chunks, "document_key", "version", "section_index", "part_index", "chunk_index", "content") if r[0] == "a.org/two"]
    assert [r[4] for r in of_two] == list(range(len(of_two))) and {r[1] for r in of_two} == {3} and {r[3] for r in of_two} == {0}
    one = [r for r in rows(run.chunks, "document_key", "content") if r[0] == "a.org/one"]
    assert "anew" in one[0][1] + one[1][1]  # the last page of an address counts


def test_again_changes_nothing(spark, run, tmp_path):
    stored = run.documents.select("source", "document_key", "version", "status", "content_hash", "signature")
    arrived, _, allowed, fetched = setup(spark, [p for p in PAGES if "b.org/bad" not in p[1]], [])
    again = activation.activate(arrived, stored, allowed, fetched)
    got = {r["source"]: r["status"] for r in again.report.collect()}
    assert got["a.org"] == "unchanged" and got["b.org"] == "active"  # without its bad page it passes
    third = activation.activate(arrived, again.documents.select(*stored.columns), allowed, fetched)
    assert {r["status"] for r in third.report.collect()} == {"unchanged", "failed"} and third.chunks.count() == 0
    assert rows(third.documents, "document_key", "version", "status") == rows(again.documents, "document_key", "version", "status")


def test_written_tables_are_overwritten_by_the_same_run(spark, run, tmp_path):
    for _ in range(2):
        activation.written(run, str(tmp_path / "t"))
    for name in ("documents", "sections", "chunks"):
        assert spark.read.parquet(str(tmp_path / "t" / name)).count() == getattr(run, name).count()


def test_nothing_arrives(spark):
    got = activation.activate(*setup(spark, [], STORED_ROWS))
    assert {r["status"] for r in got.report.collect()} == {"failed"} and got.documents.count() == 4
