import random

import pytest
from pyspark.sql import functions as F

from sparkevidence.operators import answers, catalog, evidence, questions, reviews

EMPTY = []


def test_questions_are_analysed(spark):
    rows = [
        (1, "How do I install n8n locally with docker only?"), (2, 'It fails with "disk full" error'), (3, "hi, thanks!"), (4, None), (5, "It is broken: error"), (6, "compare the official docs of caches"), (7, "this"),
    ]
    got = {r["question_id"]: r for r in questions.analyze(spark.createDataFrame(rows, "question_id long, question string")).collect()}
    a = got[1]
    assert (a["task_type"], a["action"], a["platform"], a["constraints"]) == ("setup", "установка", ["n8n"], ["only"]) and {"local", "docker"} <= set(a["environment"]) and not a["needs_external"]
    assert got[2]["task_type"] == "debug" and got[2]["symptoms"] == ["disk full"] and got[2]["missing"] == EMPTY and got[5]["missing"] == ["error text"]
    assert got[3]["social"] and not got[1]["social"] and not got[4]["social"] and got[4]["objects"] == EMPTY and got[4]["task_type"] == "general"
    assert got[6]["task_type"] == "compare" and got[6]["needs_external"] and got[6]["content_types"][:1] == ["official_docs"]
    assert got[7]["ambiguity"] == ["refers_to_context"]
    known, outside = (spark.createDataFrame([(r,)], "root string") for r in ("caches"[:5], "broke"))
    gate = {r["question_id"]: (r["incomplete"], r["out_of_base"]) for r in questions.gates(questions.analyze(spark.createDataFrame(rows, "question_id long, question string")), known, outside).collect()}
    assert gate[6] == (False, False) and gate[7] == (True, False) and gate[5][1]


FIELDS = "question_id long, base double, text_roots array<string>, heading_roots array<string>, q_roots array<string>, o_roots array<string>, a_roots array<string>, c_roots array<string>, y_roots array<string>, anchors array<struct<root:string,weight:double>>, commons array<struct<root:string,weight:double>>, expected array<string>, types array<string>, has_fact boolean, not_about boolean, strong array<string>, task_type string, constraints array<string>"


def scored_row(**change):
    row = dict(question_id=1, base=0.5, text_roots=["cache", "flush"], heading_roots=["cache"], q_roots=["cache", "flush"], o_roots=["cache"], a_roots=["flush"], c_roots=[], y_roots=[], anchors=[("cache", 1.2), ("zoo", 0.4)], commons=[], expected=["docs"], types=["docs"], has_fact=True, not_about=False, strong=["cache"], task_type="general", constraints=[])
    return tuple((row | change).values())


def test_evidence_scores_and_reasons(spark):
    rows = [scored_row(), scored_row(text_roots=["x"], heading_roots=[]), scored_row(not_about=True), scored_row(strong=["other"], anchors=[]), scored_row(c_roots=["only"], constraints=["only"]), scored_row(task_type="debug", y_roots=["disk"]), scored_row(base=0.0, q_roots=["a"], o_roots=[], a_roots=[], anchors=[], strong=[], expected=[], has_fact=False)]
    got = evidence.discard_reason(evidence.score_evidence(spark.createDataFrame(rows, FIELDS))).collect()
    assert got[0]["score"] == round(0.15 + 0.32 + 0.26 + 0.08 + 0.20 * 0.75 + 0.06 + 0.16 + 0.08, 4) and got[0]["reason"] is None
    assert [r["reason"] for r in got[1:]] == ["missing primary object terms", "not-about section", "missing strong evidence term", "missing requested constraint", "missing requested symptom", "below evidence threshold"]


def plain_pack(rows, most=5, alike=0.72):
    kept = []
    for r in sorted(rows, key=lambda r: r["rank"]):
        if r["decision"] != "discarded" and not any(k["decision"] == "accepted" and len(k["roots"] & r["roots"]) / max(len(k["roots"] | r["roots"]), 1) >= alike for k in kept):
            kept.append(r)
    accepted = [k["id"] for k in kept if k["decision"] == "accepted"][:most]
    if accepted:
        return accepted
    best = sorted(kept, key=lambda k: (-k["order"], -k["reranked"], k["rank"]))
    return [k["id"] for i, k in enumerate(best[:2]) if i == 0 or k["order"] >= 0]


def test_packs_against_a_loop(spark):
    r = random.Random(1)
    rows, want = [], {}
    for q in range(60):
        own = []
        for k in range(r.randint(0, 9)):
            reasons = r.sample(list(evidence.PARTIAL_ORDER), r.randint(0, 3))
            own.append({"rank": k + 1, "id": f"{q}-{k}", "roots": set(r.sample("abcdef", r.randint(1, 5))), "decision": r.choice(["accepted", "partial", "discarded"] if q % 2 else ["partial", "discarded"]), "reranked": round(r.random(), 2), "reasons": reasons, "order": sum(evidence.PARTIAL_ORDER[x] for x in reasons)})
        want[q] = sorted(plain_pack(own))
        rows += [(q, x["rank"], x["id"], sorted(x["roots"]), x["decision"], x["reranked"], x["reasons"]) for x in own]
    d = spark.createDataFrame(rows, "question_id long, rank int, id string, text_roots array<string>, decision string, reranked double, reasons array<string>")
    got = {q: [] for q in range(60)}
    for x in evidence.pack(d).collect():
        got[x["question_id"]].append(x["id"])
    assert {q: sorted(v) for q, v in got.items()} == want


def test_answer_modes(spark):
    q = spark.createDataFrame([(1, False, [], []), (2, True, ["error text"], []), (3, True, [], []), (4, True, [], [["a"], ["z"]]), (5, True, [], [["y"], ["z"]])], "question_id long, source_required boolean, missing array<string>, point_roots array<array<string>>")
    p = spark.createDataFrame([(4, "accepted", ["a"]), (4, "accepted", ["b"]), (5, "accepted", ["a"])], "question_id long, decision string, roots array<string>")
    assert [r["answer_mode"] for r in evidence.answer_modes(q, p).orderBy("question_id").collect()] == ["general_answer_without_sources", "ask_for_missing_data", "out_of_base", "answer_from_materials", "partial_answer"]


def test_glossary_enrichment(spark):
    q = spark.createDataFrame([(1, "Set up Redis—Cache for the web hook"), (2, "web hook only"), (3, None)], "question_id long, question string")
    aliases = spark.createDataFrame([("redis", "redis cache"), ("hooks", "zapier")], "service_id string, phrase string")
    rules = spark.createDataFrame([("redis", "r1", 2, "web hook", "exact", "WEBHOOK"), ("redis", "r1", 1, "set up", "exact", "WEBHOOK"), ("hooks", "h", 1, "web hook", "config", "HOOK_URL")], "service_id string, rule_id string, ordinal int, phrase string, kind string, term string")
    got = catalog.enrich_questions(q, aliases, rules).collect()
    assert [(r["question_id"], r["services"], r["exact_terms"], r["config_terms"]) for r in got] == [(1, ["redis"], ["WEBHOOK"], [])]


def test_metadata_and_catalogs(spark):
    a = spark.createDataFrame([(1, {"x": "1", "y": "1"}), (2, None)], "id long, m map<string,string>")
    b = spark.createDataFrame([(1, {"y": "2", "z": "2"})], "id long, n map<string,string>")
    assert {r["id"]: r["metadata"] for r in catalog.merged_metadata(a, b, "id", "m", "n").collect()} == {1: {"x": "1", "y": "2", "z": "2"}, 2: {}}
    parts = [spark.createDataFrame([("s", None, "d1")], "service_id string, name string, domain string"), spark.createDataFrame([("s", "N", "d2"), ("t", "T", None)], "service_id string, name string, domain string")]
    assert sorted((r["service_id"], r["name"], r["domain"], r["catalogs"]) for r in catalog.merge_catalogs(parts).collect()) == [("s", "N", "d1", 2), ("t", "T", None, 1)]
    d = spark.createDataFrame([("cc-by", "under CC‑BY 4"), ("cc-by", "acc-by"), ("by", "cc-by"), ("a.b", "axb"), ("", "x")], "t string, x string")
    assert [r[0] for r in d.select(catalog.expectation_matches(F.col("t"), F.col("x"))).collect()] == [True, False, False, False, False]


def test_reviewed_plans(spark):
    kind = "document_key string, content_hash string"
    active = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")], kind)
    found = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "4"), ("z", "4")], kind)
    got = {r["document_key"]: (r["class"], r["successor"]) for r in reviews.reconcile(active, found).collect()}
    assert got == {"a": ("unchanged", None), "b": ("changed", None), "c": ("moved", "x"), "d": ("missing", "y"), "e": ("missing", None), "x": ("added", None), "y": ("added", None), "z": ("added", None)}
    assert {r["document_key"]: r["question"] for r in reviews.review_queue(reviews.reconcile(active, found)).collect()} == {"c": "relocate", "d": "choose_successor", "e": "archive_or_keep"}
    asked = spark.createDataFrame([("c", "x"), ("d", "y"), ("e", "y"), ("q", "a")], "document_key string, new_key string")
    plan = {r["document_key"]: r["reasons"] for r in reviews.relocation_plan(asked, active, found).collect()}
    assert plan == {"c": [], "d": ["requested_twice"], "e": ["content_differs", "requested_twice"], "q": ["old_key_not_active", "key_collision"]}


def test_states_follow_allowed_transitions(spark):
    s = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "done")], "id long, status string")
    e = spark.createDataFrame([(1, 2, "go"), (1, 1, "look"), (2, 1, "go")], "id long, seq long, action string")
    got = {r["id"]: tuple(r)[1:] for r in answers.transitions(s, e, [("pending", "look", "seen"), ("seen", "go", "done")], "id").collect()}
    assert got == {1: ("done", 2, 0), 2: ("pending", 0, 1), 3: ("done", 0, 0)}


def test_answers_and_their_checks(spark):
    e = spark.createDataFrame([(1, 1, "# Head\nUse `flush` to empty the cache. Short.\nSee https://x.org for more of it."), (1, 2, "Use `flush` to empty the cache.\nThe cache holds pages of the site.")], "question_id long, place int, content string")
    said = answers.sentences(e)
    assert [r["sentence"] for r in said.orderBy("rank").collect()] == ["Use `flush` to empty the cache.", "The cache holds pages of the site."]
    modes = spark.createDataFrame([(1, "partial_answer", ["price"], []), (2, "ask_for_missing_data", [], ["error text"]), (3, "out_of_base", [], [])], "question_id long, answer_mode string, uncovered array<string>, missing array<string>")
    got = {r["question_id"]: r for r in answers.extractive_answers(modes, said).collect()}
    assert got[1]["answer"].endswith("- The cache holds pages of the site.\nNothing was found on: price.") and got[2]["answer"] == "Needed: error text." and got[3]["status"] == "not_found"
    w = spark.createDataFrame([("Sources: https://x.org", []), ("The cache is emptied by flush.\nSources: docs", ["cache", "empti", "flush"]), ("", [])], "answer string, roots array<string>")
    assert [r["source_only"] for r in answers.weak_answers(w).collect()] == [True, False, False]
    c = spark.createDataFrame([("It holds pages. Perhaps it does not. Here they are: Yes.",)], "a string")
    assert c.select(answers.claims(F.col("a"))).first()[0] == ["It holds pages.", "Here they are: Yes."]


def test_marks_are_an_input(spark):
    """Another table of marks reads questions in another language; its order decides."""
    from sparkevidence.operators.marks import DEFAULT, Marks

    table = spark.createDataFrame([(3, "task", "debug", "kaputt"), (1, "task", "setup", "einrichten"), (2, "action", "einrichtung", "einrichten"), (4, "constraint", "", "ohne"), (5, "content", "manual", "handbuch"), (6, "point", "debug", "ursache"), (7, "stopword", "", "wie")], "place int, role string, label string, marker string")
    rows = spark.createDataFrame([(1, "wie einrichten, ohne handbuch? kaputt"), (2, "kaputt"), (3, None)], "question_id long, question string")
    got = {r["question_id"]: r for r in questions.analyze(rows, marks=Marks.read(table)).collect()}
    assert (got[1]["task_type"], got[1]["action"], got[1]["constraints"], got[1]["content_types"]) == ("setup", "einrichtung", ["ohne"], ["manual"])
    assert got[2]["task_type"] == "debug" and got[2]["points"] == ["ursache"] and got[3]["task_type"] == "general" and got[2]["content_types"] == ["unknown"]
    assert list(DEFAULT.task)[:2] == ["source_check", "debug"] and DEFAULT.action[0] == ("install", "установка")


def test_terms_are_weighted_once_for_routing_and_scores(spark, monkeypatch):
    import __spark_entry__
    from sparkevidence.plans import retrieval_queries

    calls, weigh = [], retrieval_queries.weighted_terms
    monkeypatch.setattr(retrieval_queries, "weighted_terms", lambda *a: calls.append(1) or weigh(*a))
    __spark_entry__.queries()["score_evidence"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["merge_scoped_results", "retrieval_metrics"])
def test_the_corpus_is_weighed_and_searched_once(spark, monkeypatch, name):
    """What several parts of a query need of the corpus is made once: weights of terms, and matches of documents."""
    import __spark_entry__
    from sparkevidence.plans import retrieval_queries

    weighed, searched = [], []
    weigh, search = retrieval_queries.weighted_terms, retrieval_queries._matches
    monkeypatch.setattr(retrieval_queries, "weighted_terms", lambda *a: weighed.append(1) or weigh(*a))
    monkeypatch.setattr(retrieval_queries, "_matches", lambda *a: searched.append(1) or search(*a))
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert (len(weighed), len(searched)) == (1, 1)


def test_packs_go_to_the_texts(spark):
    """The chunks of evidence packs are looked up where texts are read; neither texts nor chunks are sorted by their ids."""
    from sparkevidence.plans import answer_queries
    from sparkevidence.sources.cuts import cut

    ids = [r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(5).collect()]
    packed = cut(spark.createDataFrame([(1, k + 1, (i, 0)) for k, i in enumerate(ids)], "question_id long, place int, id struct<document_id:long,chunk_index:int>"), "packed")
    said = answer_queries._said(spark, "/root/testdata/sf0.001", packed)
    assert "SortMergeJoin" not in said._jdf.queryExecution().executedPlan().toString() and said.count() > 0
