"""Evaluation queries: cases are benchmark passages, right answers the documents that hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.operators import evaluation as E
from sparkevidence.operators import evidence as V
from sparkevidence.plans import corpus, evidence_queries, retrieval_queries
from sparkevidence.plans.base import query
from sparkevidence.plans.evidence_queries import _MODE_CTE
from sparkevidence.plans.retrieval_queries import _match_sql
from sparkevidence.sources.cuts import cut

_EXPECTED = "expected AS (SELECT DISTINCT question_id, doc_id AS document_id FROM questions JOIN documents ON contains(text, question))"


def _expected(spark, sf_dir):
    """Documents that hold a passage: candidates share every token (an equi join), then the text is looked at."""
    full = retrieval_queries.fulltext_score(spark, sf_dir).select("question_id", "document_id")
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return full.join(d, "document_id").join(corpus.questions(spark, sf_dir), "question_id").where(F.contains("text", "question")).select("question_id", "document_id").distinct()


@query(_match_sql(f", {_EXPECTED} SELECT question_id, document_id, rank IS NOT NULL AS found, rank FROM expected LEFT JOIN top_docs USING (question_id, document_id)"))
def synthetic_case_results(spark, sf_dir):
    top = retrieval_queries.top_documents(spark, sf_dir).select("question_id", "document_id", "rank")
    return _expected(spark, sf_dir).join(top, ["question_id", "document_id"], "left").select("question_id", "document_id", F.col("rank").isNotNull().alias("found"), "rank")


def _name(i):
    """A document's name in cases: digits in reverse, so that neighbours share no beginning."""
    return F.concat(F.lit("d"), F.reverse(i.cast("string")))


def _cases(spark, sf_dir):
    """A case for each labelled document: it is to be found, its neighbour by id is not, and its language is to be named."""
    d = corpus.table(spark, sf_dir, "labels").join(corpus.table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        F.col("doc_id").alias("case_id"), F.array(_name(F.col("doc_id"))).alias("expected_documents"), F.array(_name(F.col("doc_id") + 1)).alias("forbidden_documents"), F.array("lang").alias("expected_answer_terms"),
        F.array(F.lit("toxic")).alias("forbidden_answer_terms"), F.array("source").alias("expected_supported_points"), F.lit("answer_from_materials").alias("expected_answer_mode"), F.lit(2).alias("expected_source_count_max"),
        F.lit(True).alias("requires_sources"), F.lit(True).alias("must_not_use_discarded_candidates"),
    )


def _predictions(spark, sf_dir, shift: int):
    """Answers that err by rule: missing every 13th, a neighbour cited every 5th, too many sources every 7th, wrong mode every 11th, and
    one discarded candidate that some sources name."""
    d = corpus.table(spark, sf_dir, "labels").join(corpus.table(spark, sf_dir, "documents"), "doc_id").where((F.col("doc_id") + shift) % 13 != 0)
    i, own = F.col("doc_id") + shift, _name(F.col("doc_id"))
    docs = F.when(i % 5 == 0, F.array(own, _name(F.col("doc_id") + 1))).otherwise(F.array(own))
    sources = F.when(i % 7 == 0, F.array(own, F.lit("q"), F.lit("y"))).otherwise(F.array(own))
    answer = F.concat("lang", F.lit(" "), "source", F.when(F.col("toxic") == 1, " toxic").otherwise(""))
    mode = F.when(i % 11 == 0, "out_of_base").otherwise("answer_from_materials")
    return d.select(F.col("doc_id").alias("case_id"), docs.alias("documents"), sources.alias("sources"), F.array(F.concat(own, F.lit(" "), "source")).alias("evidence"), answer.alias("answer"), mode.alias("answer_mode"), F.array(F.lit("q")).alias("discarded"))


def _scores_cte(name: str, shift: int) -> str:
    i = f"(doc_id + {shift})"
    w, p = E.SHARES, E.PENALTIES
    issue = ("NOT run", "case_not_run"), ("NOT mode", "answer_mode_mismatch"), ("fd", "forbidden_document_used"), ("ft", "forbidden_answer_term_used"), ("many", "source_count_above_limit"), ("NOT run", "missing_required_sources"), ("run AND NOT mode", "sources_present_for_missing_data"), ("many", "discarded_candidate_used"), ("NOT run", "expected_document_missing")
    return f"""{name}0 AS (SELECT doc_id AS case_id, {i} % 13 <> 0 AS run, {i} % 13 <> 0 AND {i} % 5 = 0 AS fd, {i} % 13 <> 0 AND toxic = 1 AS ft, {i} % 13 <> 0 AND {i} % 7 = 0 AS many, {i} % 13 <> 0 AND {i} % 11 <> 0 AS mode FROM labels JOIN documents USING (doc_id)),
    {name}1 AS (SELECT *, {w["documents"]}::DOUBLE * CASE WHEN fd THEN 0.5 ELSE 1 END + {w["sources"]}::DOUBLE * CASE WHEN many THEN 1 / 3.0::DOUBLE ELSE 1 END + {w["evidence"]}::DOUBLE * (2 / 3.0::DOUBLE) + {w["terms"]}::DOUBLE * CASE WHEN ft THEN 0 ELSE 1 END + {w["grounding"]}::DOUBLE
        + {w["mode"]}::DOUBLE * CASE WHEN mode THEN 1 ELSE 0 END - CASE WHEN fd OR ft THEN {p["leak"]}::DOUBLE ELSE 0 END - CASE WHEN many THEN {p["many_sources"]}::DOUBLE + {p["discarded_used"]}::DOUBLE ELSE 0 END - CASE WHEN NOT mode THEN {p["sources_without_need"]}::DOUBLE ELSE 0 END AS total FROM {name}0),
    {name} AS (SELECT case_id, run, fd, many, mode, CASE WHEN run THEN round(greatest(least(total, 1), 0), 4) ELSE 0 END AS score, list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in issue)}], lambda x: x IS NOT NULL) AS issues FROM {name}1)"""


@query(f"WITH {_scores_cte('s', 0)} SELECT case_id, score, array_to_string(issues, ',') AS issues, score >= 0.75 AND len(issues) = 0 AS passed FROM s")
def score_cases(spark, sf_dir):
    out = E.score_cases(_cases(spark, sf_dir), _predictions(spark, sf_dir, 0))
    return out.select("case_id", "score", F.array_join("issues", ",").alias("issues"), "passed")


@query(f"WITH {_scores_cte('s', 0)} SELECT count(*) AS total, count_if(score >= 0.75 AND len(issues) = 0) AS passed, count_if(run AND NOT (score >= 0.75 AND len(issues) = 0)) AS failed, count_if(NOT run) AS not_run, round(avg(score), 4) AS mean_score FROM s")
def eval_summary(spark, sf_dir):
    return E.summary(E.score_cases(_cases(spark, sf_dir), _predictions(spark, sf_dir, 0)))


@query(f"""WITH {_scores_cte('a', 0)}, {_scores_cte('b', 3)}, j AS (SELECT b.*, a.run AS run0, a.score AS s0 FROM b LEFT JOIN (SELECT * FROM a WHERE case_id % 4 <> 0) a USING (case_id))
    SELECT case_id, 'expected_document_missing' AS regression FROM j WHERE run0 AND NOT run UNION ALL SELECT case_id, 'forbidden_document_present' FROM j WHERE fd UNION ALL SELECT case_id, 'source_count_above_limit' FROM j WHERE many UNION ALL SELECT case_id, 'answer_mode_mismatch' FROM j WHERE NOT mode
    UNION ALL SELECT case_id, 'sources_for_missing_data' FROM j WHERE run AND NOT mode UNION ALL SELECT case_id, 'discarded_candidate_used' FROM j WHERE many UNION ALL SELECT case_id, 'score_drop' FROM j WHERE coalesce(s0, 0) - score >= 0.5""")
def compare_runs(spark, sf_dir):
    """A later run against an earlier one that lacks every fourth case."""
    c = _cases(spark, sf_dir)
    before = E.score_cases(c.where("case_id % 4 <> 0"), _predictions(spark, sf_dir, 0))
    return E.compare_runs(before, E.score_cases(c, _predictions(spark, sf_dir, 3)))


@query(f"WITH {_scores_cte('s', 0)} SELECT unnest(issues) AS issue, count(*) AS n FROM s GROUP BY 1")
def blocker_classification(spark, sf_dir):
    out = E.score_cases(_cases(spark, sf_dir), _predictions(spark, sf_dir, 0))
    return out.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, md5(text) AS text_md5, len(text) > 0 AS non_empty, NOT regexp_matches(text, '\\{[^{}]*:[^{}]*\\}|<[a-z]+>') AS no_raw_dump, NOT regexp_matches(lower(text), 'embedding|chunk_id|debug_') AS no_internal_terms,
    len(regexp_extract_all(text, '(?m)^[-*] ')) <= 5 AS few_items FROM conversations WHERE role = 'assistant'""")
def answer_smoke_checks(spark, sf_dir):
    t, x = corpus.table(spark, sf_dir, "conversations").where("role = 'assistant'"), F.col("text")
    return t.select(
        "conv_id", "turn", F.md5("text").alias("text_md5"), (F.length(x) > 0).alias("non_empty"), (~x.rlike(r"\{[^{}]*:[^{}]*\}|<[a-z]+>")).alias("no_raw_dump"), (~F.lower(x).rlike("embedding|chunk_id|debug_")).alias("no_internal_terms"), (F.regexp_count(x, F.lit("(?m)^[-*] ")) <= 5).alias("few_items"),
    )


@query("""SELECT doc_id, len(groups) AS n_groups, len(list_filter(groups, lambda g: len(list_filter(g, lambda w: contains(lower(text), w))) > 0)) = len(groups) AS satisfied
    FROM (SELECT doc_id, text, [['the', 'und', 'de'], ['license', 'en', 'er']] AS groups FROM documents)""")
def evidence_term_groups(spark, sf_dir):
    """Whether each group of terms has one that the text holds."""
    d = corpus.table(spark, sf_dir, "documents")
    groups = F.array(F.array(F.lit("the"), F.lit("und"), F.lit("de")), F.array(F.lit("license"), F.lit("en"), F.lit("er")))
    return d.select("doc_id", F.size(groups).alias("n_groups"), F.forall(groups, lambda g: F.exists(g, lambda w: F.contains(F.lower("text"), w))).alias("satisfied"))


@query(_match_sql(f""", {_MODE_CTE}, {_EXPECTED}, h AS (SELECT e.question_id, min(rank) AS rank FROM expected e LEFT JOIN top_docs t ON t.question_id = e.question_id AND t.document_id = e.document_id GROUP BY 1),
    pk AS (SELECT p.question_id, count(*) AS size, count(e.document_id) AS good, count_if(p.document_id % 100 = 99) AS bad FROM packed p LEFT JOIN expected e ON e.question_id = p.question_id AND e.document_id = p.document_id GROUP BY 1),
    r AS (SELECT q.question_id, h.question_id IS NOT NULL AS wanted, rank, size, good, bad, answer_mode = CASE WHEN h.question_id IS NULL THEN 'out_of_base' ELSE 'answer_from_materials' END AS mode_ok FROM questions q LEFT JOIN h ON h.question_id = q.question_id LEFT JOIN pk ON pk.question_id = q.question_id LEFT JOIN modes m ON m.question_id = q.question_id)
    SELECT count(*) AS questions, count_if(wanted) AS with_documents, round(avg(CASE WHEN wanted THEN coalesce((rank <= 1)::INT, 0) END), 6) AS top1, round(avg(CASE WHEN wanted THEN coalesce((rank <= 3)::INT, 0) END), 6) AS top3, round(avg(CASE WHEN wanted THEN coalesce((rank <= 5)::INT, 0) END), 6) AS recall5, round(avg(CASE WHEN wanted THEN coalesce(1.0::DOUBLE / rank, 0) END), 6) AS mrr,
    round(avg(CASE WHEN wanted AND size > 0 THEN good / size END), 6) AS evidence_precision, round(avg(coalesce((bad > 0)::INT, 0)), 6) AS forbidden_leakage, round(avg(coalesce(mode_ok::INT, 0)), 6) AS mode_accuracy, round(avg(coalesce(size, 0)), 6) AS mean_pack_size FROM r"""))
def retrieval_metrics(spark, sf_dir):
    """Passages as questions: the documents that hold one are right, every hundredth is forbidden, and passages of none are out of base."""
    expected = cut(_expected(spark, sf_dir), "expected")
    weights = retrieval_queries.asked_weights(spark, sf_dir)
    top = cut(retrieval_queries.top_documents(spark, sf_dir, weights), "routed")
    packed = evidence_queries._packed(spark, sf_dir, weights, top)
    modes = V.answer_modes(evidence_queries._asked(spark, sf_dir, weights), packed)
    packed = packed.select("question_id", "id.document_id")
    forbidden = packed.where("document_id % 100 = 99").distinct()
    wanted = expected.select("question_id", F.lit(True).alias("w")).distinct()
    questions = corpus.questions(spark, sf_dir).select("question_id").join(wanted, "question_id", "left").select("question_id", F.when(F.col("w"), "answer_from_materials").otherwise("out_of_base").alias("expected_mode"))
    return E.retrieval_metrics(expected, top.select("question_id", "document_id", "rank"), packed, modes, forbidden, questions)
