import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkevidence.operators import chunk_quality, evaluation, health, lifecycle, retrieval, terms
from sparkevidence.sources import files, pages


def test_low_value_chunks(spark):
    rows = [(1, 0, "Title", "Title"), (1, 1, "Setup", "Run `$ pip` with\n$ pip install x"), (1, 2, "Body", "This chunk explains how the cache is filled, and when it is emptied again."), (2, 0, "A", "A"), (3, 0, "W", "Was this page helpful? yes no")]
    d = spark.createDataFrame(rows, "document_id long, chunk_index int, heading string, content string")
    got = sorted(tuple(r) for r in chunk_quality.drop_low_value(d).select("document_id", "chunk_index", "heading").collect())
    assert got == [(1, 0, "Setup"), (1, 1, "Body"), (2, 0, "A"), (3, 0, "W")]


def test_term_weights(spark):
    d = spark.createDataFrame([("everywhere", 9, 9, 3, "term"), ("RARE", 1, 1, 1, "acronym"), ("some", 2, 2, 2, "term")], "term string, document_frequency long, chunk_frequency long, course_frequency long, term_type string")
    got = {r["term"]: (r["frequency_class"], r["weight"]) for r in terms.with_weights(d, 20, 20).collect()}
    assert got == {"everywhere": ("common", 0.24), "RARE": ("rare_anchor", 1.44), "some": ("specific", 1.05)}


def test_ingest_is_idempotent(spark):
    kind = "document_key string, version int, status string, content_hash string, signature string"
    stored = spark.createDataFrame([("a", 1, "archived", "h0", "p"), ("a", 2, "active", "h1", "p"), ("b", 1, "active", "h2", "p")], kind)
    incoming = spark.createDataFrame([("a", "h9", "p"), ("b", "h2", "p"), ("c", "h3", "p")], "document_key string, content_hash string, signature string")
    plan = {r["document_key"]: (r["action"], r["version"]) for r in lifecycle.plan_ingest(incoming, stored).collect()}
    assert plan == {"a": ("new_version", 3), "b": ("skip", 1), "c": ("new", 1)}
    once = lifecycle.apply_ingest(stored, incoming)
    twice = lifecycle.apply_ingest(once, incoming)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(once) == key(twice) and len(key(once)) == 5
    assert [r["version"] for r in once.where("document_key = 'a' and status = 'active'").collect()] == [3]


def test_archive_needs_every_guard(spark):
    d = spark.createDataFrame([(1, "a", 2, "active"), (2, "b", 1, "archived")], "document_id long, document_key string, version int, status string")
    q = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 1), (1, "b", 2)], "document_id long, document_key string, version int")
    assert [r["done"] for r in lifecycle.archive_exact(d, q).orderBy("document_id", "document_key", F.desc("version")).collect()] == [True, False, False, False]


def test_fingerprint_ignores_order_and_partitions(spark):
    d = spark.range(500).selectExpr("id", "id % 7 as g", "string(id * 3) as t")
    a, b = (sorted(tuple(r) for r in lifecycle.table_fingerprint(x, ["g"]).collect()) for x in (d, d.orderBy(F.desc("id")).repartition(5)))
    c = sorted(tuple(r) for r in lifecycle.table_fingerprint(d.withColumn("t", F.when(F.col("id") == 3, "x").otherwise(F.col("t"))), ["g"]).collect())
    assert a == b and sum(x != y for x, y in zip(a, c)) == 1


def test_link_frontier(spark):
    links = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("t", "a", "z")], "source string, url string, target string")
    starts = spark.createDataFrame([("s", "a")], "source string, url string")
    assert sorted(tuple(r) for r in lifecycle.link_frontier(links, starts, 2, 10).collect()) == [("s", "a", 0), ("s", "b", 1), ("s", "c", 2)]
    assert lifecycle.link_frontier(links, starts, 3, 2).count() == 2


def test_exact_and_approximate_search(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 400)] + 0.25 * r.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, v array<double>")
    q = d.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    want = {}
    for i in range(0, 400, 20):
        s = np.round(v @ v[i], 6)
        want[i] = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:5]
    top = lambda df: {k: [r["vec_id"] for r in sorted(g, key=lambda r: r["rank"])] for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: r["query_id"]), lambda r: r["query_id"])}
    for block in (4096, 64):
        retrieval.VECTOR_BLOCK = block
        assert top(retrieval.cosine_topk(d, q, 5, 400, 20)) == want
    near = top(retrieval.ann_topk(d, q, 5))
    assert np.mean([len(set(near.get(i, [])) & set(want[i])) / 5 for i in want]) >= 0.95


def test_approximate_search_shuffles_no_pairs(spark):
    d = spark.createDataFrame([(i, [float(i % 7 == j) for j in range(7)]) for i in range(70)], "vec_id long, v array<double>")
    found = retrieval.ann_topk(d, d.select(F.col("vec_id").alias("query_id"), "v"), 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["vec_id"], r["score"]) for r in found.where("query_id = 8").collect()) == [(1, 1.0), (15, 1.0), (22, 1.0)]


def test_redundant_evidence_goes(spark):
    rows = [(1, 1, "a", ["x", "y", "z", "w"]), (1, 2, "b", ["x", "y", "z", "w"]), (1, 3, "c", ["q", "r"]), (2, 1, "d", ["x"])]
    d = spark.createDataFrame(rows, "question_id long, rank int, id string, roots array<string>")
    assert sorted(r["id"] for r in retrieval.without_redundant(d, "question_id").collect()) == ["a", "c", "d"]


def test_mentions_shuffle_no_words(spark):
    d = spark.createDataFrame([(1, "the end of the big tool"), (2, None), (3, ""), (4, "of the")], "k long, t string")
    s = spark.createDataFrame([("bt", "big tool box"), ("bt", "big tool"), ("of", "of the"), ("none", "")], "service_id string, alias string")
    found = retrieval.mentions(d, "k", "t", s)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["alias"], r["word_at"]) for r in found.collect()) == [(1, "big tool", 4), (1, "of the", 2), (4, "of the", 0)]
    # Words are found once, and meet aliases where they are.
    assert "SortMergeJoin" not in plan
    assert plan.count("regexp_extract_all") <= 2, plan


def test_mentions_meet_whole_words(spark):
    d = spark.createDataFrame([(1, "Use the Big Tool now"), (2, "big toolbox"), (3, "tool and big  tool")], "k long, t string")
    s = spark.createDataFrame([("bt", "big tool"), ("bt", "tool")], "service_id string, alias string")
    assert sorted((r["k"], r["alias"], r["word_at"]) for r in retrieval.mentions(d, "k", "t", s).collect()) == [(1, "big tool", 2), (3, "big tool", 2)]


def test_claims(spark):
    c = spark.createDataFrame([(1, 0, "The cache stores pages"), (1, 1, "Dragons breathe fire daily"), (2, 0, "The")], "k long, claim_no long, claim string")
    e = spark.createDataFrame([(1, "pages are what the cache stores")], "k long, span string")
    assert [r["supported"] for r in retrieval.verify_claims(c, e, "k").orderBy("k", "claim_no").collect()] == [True, False, False]


def test_score_cases(spark):
    fields = "case_id string, expected_documents array<string>, forbidden_documents array<string>, expected_answer_terms array<string>, forbidden_answer_terms array<string>, expected_supported_points array<string>, expected_answer_mode string, expected_source_count_max int"
    cases = spark.createDataFrame([("a", ["d1"], ["d9"], ["cache"], ["secret"], ["stores"], "answer", 1), ("b", ["d1"], [], [], [], [], "answer", 1)], fields)
    p = spark.createDataFrame([("a", ["d1", "d9"], ["d1"], ["d1"], "the cache stores", "answer")], "case_id string, documents array<string>, sources array<string>, evidence array<string>, answer string, answer_mode string")
    got = {r["case_id"]: r for r in evaluation.score_cases(cases, p).collect()}
    assert got["a"]["score"] == 0.49 and got["a"]["issues"] == ["forbidden_document_used"] and not got["a"]["passed"]
    assert got["b"]["issues"] == ["case_not_run", "answer_mode_mismatch", "expected_document_missing"]
    s = evaluation.summary(evaluation.score_cases(cases, p)).first()
    assert (s["total"], s["passed"], s["failed"], s["not_run"]) == (2, 0, 1, 1)


def test_every_penalty_of_a_case(spark):
    """Faults one at a time against a right answer, whose parts are all full."""
    fields = "case_id string, expected_documents array<string>, forbidden_documents array<string>, expected_answer_terms array<string>, forbidden_answer_terms array<string>, expected_supported_points array<string>, expected_answer_mode string, expected_source_count_max int, requires_sources boolean, must_not_use_discarded_candidates boolean"
    kind = "case_id string, documents array<string>, sources array<string>, evidence array<string>, answer string, answer_mode string, discarded array<string>"
    right = (["guide"], ["guide"], ["guide cache flush"], "cache flush", "answer_from_materials", ["draft"])
    rows = {
        "right": right, "leak": (["guide", "bad"], *right[1:]), "term": (*right[:3], "cache flush secret", *right[4:]), "many": (right[0], ["guide", "guide two", "guide three"], *right[2:]), "none": (right[0], [], *right[2:]),
        "needless": (*right[:4], "out_of_base", right[5]), "discarded": (*right[:3], "cache flush draft", *right[4:]),
    }
    cases = spark.createDataFrame([(k, ["guide"], ["bad"], ["cache"], ["secret"], ["flush"], "answer_from_materials", 2, True, True) for k in rows], fields)
    got = {r["case_id"]: (r["score"], r["issues"]) for r in evaluation.score_cases(cases, spark.createDataFrame([(k, *v) for k, v in rows.items()], kind)).collect()}
    assert got == {
        "right": (1.0, []), "leak": (0.61, ["forbidden_document_used"]), "term": (0.54, ["forbidden_answer_term_used"]), "many": (0.7433, ["source_count_above_limit"]), "none": (0.69, ["missing_required_sources"]),
        "needless": (0.68, ["answer_mode_mismatch", "sources_present_for_missing_data"]), "discarded": (0.75, ["discarded_candidate_used"]),
    }


def test_terms_match_by_words_and_roots(spark):
    rows = [("Cache", "the cache", True), ("configuring", "it configures", True), ("alpha beta gamma", "alpha and gammas", True), ("alpha beta gamma", "alpha only", False), ("", "x", False), ("zip", "zap", False)]
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    assert [r[0] for r in d.select(evaluation.term_matches(F.col("a"), F.col("b"))).collect()] == [w for *_, w in rows]


def test_runs_are_compared_from_the_later_one(spark):
    kind = "case_id string, score double, expected_found boolean, forbidden_document boolean, count_ok boolean, mode_ok boolean, needless_sources boolean, discarded_used boolean"
    ok = (True, False, True, True, False, False)
    before = spark.createDataFrame([("a", 1.0, *ok), ("gone", 1.0, *ok)], kind)
    after = spark.createDataFrame([("a", 0.4, False, False, True, True, False, False), ("new", 0.9, True, True, False, False, True, True)], kind)
    got = sorted((r["case_id"], r["regression"]) for r in evaluation.compare_runs(before, after).collect())
    assert got == [("a", "expected_document_missing"), ("a", "score_drop"), *(("new", x) for x in ("answer_mode_mismatch", "discarded_candidate_used", "forbidden_document_present", "source_count_above_limit", "sources_for_missing_data"))]


def test_term_types_are_those_of_the_written_form(spark):
    d = spark.createDataFrame([(1, 0, "en", "The API reads MAX_SIZE and maximum"), (2, 0, "en", "an api is small")], "document_id long, chunk_index int, course string, content string")
    got = {r["term"]: r["term_type"] for r in terms.term_statistics(d).collect()}
    assert (got["api"], got["max_size"], got["maximum"], got["small"]) == ("acronym", "config", "term", "term")
    some = terms.term_statistics(d, spark.createDataFrame([("api",)], "root string")).collect()
    assert [(r["term"], r["document_frequency"]) for r in some] == [("api", 2)]


def test_states_of_sources_in_order(spark):
    day = 86400
    rows = [("a", 0, 0, None, "FAIL"), ("b", 3, 0, 0, "FAIL"), ("c", 3, 1, 0, "FAIL"), ("d", 3, 1, 0, "WARN"), ("e", 3, 1, 0, "PASS"), ("f", 3, 1, 95 * day, "PASS"), ("g", 3, 1, None, "PASS"), ("h", 3, 1, 95 * day, "PASS")]
    d = spark.createDataFrame(rows, "source_name string, total long, active long, latest_s long, quality string")
    got = {r["source_name"]: r["health"] for r in health.source_health(d, spark.createDataFrame([("h", 2)], "source_name string, days int"), 100 * day).collect()}
    assert got == dict(zip("abcdefgh", ["unknown", "inactive", "failed", "warning", "stale", "healthy", "unknown", "stale"]))


def test_questions_meet_documents_that_hold_all_their_tokens(spark):
    q = spark.createDataFrame([(1, ["the", "cache"]), (2, ["the"]), (3, [])], "question_id long, tokens array<string>")
    d = spark.createDataFrame([(1, ["the", "big", "cache"]), (2, ["cache"]), (3, ["the"])], "document_id long, tokens array<string>")
    assert sorted((r["question_id"], r["document_id"]) for r in retrieval.holds_all(q, d).collect()) == [(1, 1), (2, 1), (2, 3)]


PAGE = """<html><head><title> A &amp; B </title><link rel="canonical" href="https://x.org/a"></head><body><nav><a href="/n">menu</a></nav><h1>Top</h1><p>Some <b>bold</b>
text</p><ul><li>one</li><li>two</li></ul><pre>x = 1
y</pre><h2>Next</h2><p>End <a href="mailto:q@x.org">m</a><a href="/b">b</a></p><script>var z</script><footer>foot</footer></body></html>"""


def test_page_extraction(spark):
    r = pages.extract_pages(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["canonical"], r[0]["headings"], r[0]["links"]) == ("A & B", "https://x.org/a", ["Top", "Next"], ["/n", "/b"])
    assert r[0]["structured_text"] == "# Top\n\nSome bold text\n\n- one\n\n- two\n\n```\nx = 1\ny\n```\n\n## Next\n\nEnd mb"
    assert r[1]["structured_text"] == ""


def test_titles_that_were_cut_within_a_reference(spark):
    titles = ["a &amp;&amp; b&amp", "x &lt;y&gt; &quot", "n\u00a0b &#x27;q&#x2", "&copy &am"]
    d = spark.createDataFrame([(i, f"<html><head><title> {t}\n</title></head><body><p>A &amp B</p></body></html>") for i, t in enumerate(titles)], "page_id long, html string")
    r = pages.extract_pages(d).orderBy("page_id").collect()
    assert [x["title"] for x in r] == ["a && b&amp", "x <y> &quot", "n\u00a0b 'q&#x2", "&copy &am"] and r[0]["structured_text"] == "A & B"


def test_workers_get_few_pages_at_once(spark):
    d = spark.range(0, 400, 1, 1).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>word</p>"), 10_000).alias("html"))
    assert pages.extract_pages(d).where("length(structured_text) > 50000").count() == 400

    @F.pandas_udf("long")
    def at_once(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    assert d.select(at_once("html").alias("n")).agg(F.max("n")).first()[0] <= 80


def test_url_screen(spark):
    rows = ["https://docs.x.org/guide", "https://x.org.evil.com/a", "ftp://x.org/a", "https://x.org/admin/a", "https://x.org/a.PNG", "http://x.org"]
    d = spark.createDataFrame([(u,) for u in rows], "url string")
    assert [r[0] for r in d.select(pages.url_allowed(F.col("url"), F.array(F.lit("x.org")))).collect()] == [True, False, False, False, False, True]


def test_file_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "b.md").write_text("## Second file\n\nbody")
    (root / "a.txt").write_text("--\n")
    (root / "c.json").write_text(json.dumps({"title": "T", "x": [1, {"y": 2}]}))
    (root / "d.json").write_text("{broken")
    got = {r["document_key"]: r for r in files.scan_text_corpus(spark, str(root)).collect()}
    assert got["sub/b.md"]["title"] == "Second file" and got["sub/b.md"]["text"].startswith("# Second file\n\n## Second") and got["a.txt"]["title"] == "a"
    got = {r["document_key"]: r for r in files.scan_json_corpus(spark, str(root)).collect()}
    assert got["c.json"]["text"] == "- title: T\n- x[0]: 1\n- x[1].y: 2" and got["c.json"]["title"] == "T" and not got["d.json"]["valid"] and got["d.json"]["text"] == "{broken"
    inner = root / "x" / "corpus" / "a b+c"
    inner.mkdir(parents=True)
    (inner / "n.md").write_text("text")
    (root / "n.md").write_text("other text")
    keys = {r["document_key"] for r in files.scan_text_corpus(spark, f"{root}/").collect()}
    assert {"x/corpus/a b+c/n.md", "n.md", "a.txt", "sub/b.md"} == keys
    (root / "deep.json").write_text('{"a": ' * 5000 + "1" + "}" * 5000)
    (root / "mid.json").write_text('{"a": ' * 400 + "1" + "}" * 400)
    got = {r["document_key"]: r for r in files.scan_json_corpus(spark, str(root)).collect()}
    assert got["mid.json"]["text"] == "- " + ".".join(["a"] * 400) + ": 1" and len(got) == 4
    rows = spark.createDataFrame([("w", "s", 1), ("w", "t", 2)], "workspace_id string, source_name string, v int")
    files.write_versioned(rows, str(tmp_path / "v"))
    files.write_versioned(rows.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "v"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 9]
    files.export_baseline(rows.withColumn("api_token", F.lit("x")), str(tmp_path / "e"))
    assert "api_token" not in spark.read.parquet(str(tmp_path / "e")).columns


def test_eval_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "question": "q", "expected_documents": ["d"]}]))
    assert files.scan_eval_cases(spark, str(tmp_path / "c.json")).first()["expected_documents"] == ["d"]
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "a", "requires_sources": "perhaps"}]))
    with pytest.raises(Exception):
        files.scan_eval_cases(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "p.json").write_text(json.dumps([{"id": "a", "final_answer": "x", "selected_documents": ["d", "d"], "documents": ["e"]}]))
    r = files.scan_predictions(spark, str(tmp_path / "p.json")).first()
    assert (r["case_id"], r["answer"], r["documents"]) == ("a", "x", ["e", "d"])


def test_long_texts_do_not_overflow_the_matcher(spark):
    from sparkevidence.functions import text as T

    d = spark.createDataFrame([("word " * 60_000, "a.b" * 30_000)], "content string, dotted string").withColumn("heading", F.lit("h"))
    row = chunk_quality.with_quality(d).select("descriptive", F.size(T.exact_terms(F.col("dotted"))).alias("n")).first()
    assert not row["descriptive"] and row["n"] == 1
