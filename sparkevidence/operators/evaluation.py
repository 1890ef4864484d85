"""Scores of cases against predictions, retrieval metrics and differences of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_found(wanted: Column, text: Column) -> Column:
    """Share of wanted strings that occur in text, either case; 1 where none is wanted."""
    found = F.size(F.filter(wanted, lambda w: F.contains(F.lower(text), F.lower(w))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(found / F.greatest(F.size(wanted), F.lit(1)))


#: Endings that are cut from a word of which four letters stay, the first that fits. Fixed values.
SUFFIXES = ("иями", "ями", "ами", "ого", "ему", "ыми", "ing", "tion", "ки", "ка", "ия", "ие", "ый", "ой", "ая", "ую", "ов", "ев", "ам", "ом", "ах", "ях", "ed", "es", "s", "а", "у", "ы", "и", "е")
#: Modes of answers that rest on no source. Fixed values.
SOURCELESS = ("ask_for_missing_data", "general_answer_without_sources", "out_of_base")
#: Share of each part of a case's score, and what each fault takes off. Fixed values.
SHARES = {"documents": 0.18, "sources": 0.16, "evidence": 0.18, "terms": 0.16, "grounding": 0.20, "mode": 0.12}
PENALTIES = {"leak": 0.30, "many_sources": 0.15, "no_sources": 0.15, "sources_without_need": 0.20, "discarded_used": 0.25}


def _plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\r]+", " "))


def _word_root(token: Column) -> Column:
    n, stem = F.length(token), F.regexp_extract(token, "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$", 1)
    return F.when(n <= 4, token).when(stem != "", stem).when(n >= 8, F.substring(token, 1, 7)).when(n >= 6, F.substring(token, 1, 5)).otherwise(token)


def term_matches(term: Column, text: Column) -> Column:
    """Whether a text has a term: as it is, either case, or by 0.6 of its words or of their roots (one word: by it or its root)."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_#+.-]{2,}"), F.lit(0)))
    t, x = _plain(term), _plain(text)
    tw, xw = words(t), words(x)
    tr, xr = (F.array_distinct(F.transform(w, _word_root)) for w in (tw, xw))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    enough = F.when(F.size(tw) == 1, 1.0).otherwise(0.6)
    return F.when(t == "", False).when(F.contains(x, t), True).when(F.size(tw) == 0, False).otherwise(F.greatest(share(tw, xw), share(tr, xr)) >= enough)


def matched(terms: Column, texts: Column) -> Column:
    """Those of some terms that any of some texts has."""
    return F.filter(terms, lambda t: F.exists(texts, lambda x: term_matches(t, x)))


def score_cases(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row for each case: case_id, score, issues, passed and what they rest on (expected_found, forbidden_document, count_ok, mode_ok,
    needless_sources, discarded_used). A case without prediction is scored as an empty one.

    The score is the SHARES of precision of documents, sources and evidence, of answer terms, of grounded points and of the mode, less
    the PENALTIES, within 0 and 1. Passed: 0.75 at least and no issue.
    """
    rows = cases.join(predictions.withColumn("_run", F.lit(True)), "case_id", "left")
    empty = F.array().cast("array<string>")
    col = lambda c: F.coalesce(F.col(c), empty) if c in rows.columns else empty
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    clamp = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    answer, mode = F.coalesce("answer", F.lit("")), F.coalesce("answer_mode", F.lit(""))
    flags = {
        "_docs": F.size(matched(col("expected_documents"), F.concat(col("documents"), col("sources")))), "_bad_docs": F.size(matched(col("forbidden_documents"), F.concat(col("documents"), col("sources")))) > 0,
        "_bad_terms": F.size(matched(col("forbidden_answer_terms"), F.array(answer))) > 0, "_leak": F.size(matched(F.concat(col("forbidden_documents"), col("forbidden_answer_terms")), F.concat(F.array(answer), col("documents"), col("sources"), col("evidence")))) > 0,
        "_source_hits": F.size(matched(col("expected_documents"), col("sources"))), "_signals": F.size(matched(F.concat(col("expected_documents"), col("expected_answer_terms"), col("expected_supported_points")), col("evidence"))),
        "_terms": F.size(matched(col("expected_answer_terms"), F.array(answer))), "_answered": matched(col("expected_supported_points"), F.array(answer)), "_n": F.size(col("sources")),
        "_discarded": has("used_discarded") | (F.size(matched(col("discarded"), F.concat(F.array(answer), col("sources"), col("evidence")))) > 0),
    }
    r = rows.withColumns(flags)
    wanted, given = F.size(col("expected_documents")), F.size(col("documents"))
    documents = F.when(wanted == 0, (given == 0).cast("double")).otherwise(clamp(F.col("_docs") / F.greatest(given, wanted, F.lit(1))))
    sources = F.when(F.col("_n") == 0, F.when(has("requires_sources"), 0.0).otherwise(1.0)).when(wanted == 0, 1.0).otherwise(clamp(F.col("_source_hits") / F.greatest("_n", F.lit(1))))
    signals, evidence = wanted + F.size(col("expected_answer_terms")) + F.size(col("expected_supported_points")), F.size(col("evidence"))
    precision = (
        F.when(F.col("expected_answer_mode").isin(*SOURCELESS), (evidence == 0).cast("double"))
        .when(signals == 0, F.when(evidence == 0, 1.0).otherwise(0.5))
        .when(evidence == 0, 0.0)
        .otherwise(clamp(F.col("_signals") / F.greatest(evidence, signals, F.lit(1))))
    )
    terms = F.when(F.col("_bad_terms"), 0.0).when(F.size(col("expected_answer_terms")) == 0, 1.0).otherwise(F.col("_terms") / F.greatest(F.size(col("expected_answer_terms")), F.lit(1)))
    grounded = F.size(F.filter("_answered", lambda t: ~mode.isin("answer_from_materials", "partial_answer") | term_matches(t, F.array_join(col("evidence"), "\n"))))
    grounding = F.when(F.size(col("expected_supported_points")) == 0, 1.0).otherwise(grounded / F.greatest(F.size(col("expected_supported_points")), F.lit(1)))
    mode_ok, count_ok = mode == F.col("expected_answer_mode"), F.col("_n") <= F.coalesce("expected_source_count_max", F.lit(999_999))
    unsourced, needless = has("requires_sources") & (F.col("_n") == 0), mode.isin(*SOURCELESS) & (F.col("_n") > 0)
    discarded = has("must_not_use_discarded_candidates") & F.col("_discarded")
    part = {"documents": documents, "sources": sources, "evidence": precision, "terms": terms, "grounding": grounding, "mode": mode_ok.cast("double")}
    fault = {"leak": F.col("_leak"), "many_sources": ~count_ok, "no_sources": unsourced, "sources_without_need": needless, "discarded_used": discarded}
    total = sum((part[k] * w for k, w in SHARES.items()), F.lit(0.0)) - sum((F.when(fault[k], w).otherwise(0.0) for k, w in PENALTIES.items()), F.lit(0.0))
    issue = (
        (F.col("_run").isNull(), "case_not_run"), (~mode_ok, "answer_mode_mismatch"), (F.col("_bad_docs"), "forbidden_document_used"), (F.col("_bad_terms"), "forbidden_answer_term_used"), (~count_ok, "source_count_above_limit"),
        (unsourced, "missing_required_sources"), (needless, "sources_present_for_missing_data"), (discarded, "discarded_candidate_used"), ((wanted > 0) & (F.col("_docs") == 0), "expected_document_missing"),
    )
    out = r.select(
        "case_id", F.round(clamp(total), 4).alias("score"), F.array_compact(F.array(*[F.when(c, n) for c, n in issue])).alias("issues"), (F.col("_docs") > 0).alias("expected_found"), F.col("_bad_docs").alias("forbidden_document"),
        count_ok.alias("count_ok"), mode_ok.alias("mode_ok"), needless.alias("needless_sources"), F.col("_discarded").alias("discarded_used"),
    )
    return out.withColumn("passed", (F.col("score") >= 0.75) & (F.size("issues") == 0))


def summary(scores: DataFrame) -> DataFrame:
    not_run = F.array_contains("issues", "case_not_run")
    return scores.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & ~not_run).alias("failed"), F.count_if(not_run).alias("not_run"), F.round(F.avg("score"), 4).alias("mean_score"))


def compare_runs(before: DataFrame, after: DataFrame, drop: float = 0.5) -> DataFrame:
    """(case_id, regression) of all cases of the later run, whether the earlier one had them or not: a right document that is gone, faults
    of the later run, and a score that dropped by `drop` or more."""
    b = before.select("case_id", F.col("score").alias("_score"), F.col("expected_found").alias("_found"))
    both = after.join(b, "case_id", "left")
    found = (
        (F.coalesce("_found", F.lit(False)) & ~F.col("expected_found"), "expected_document_missing"), (F.col("forbidden_document"), "forbidden_document_present"), (~F.col("count_ok"), "source_count_above_limit"), (~F.col("mode_ok"), "answer_mode_mismatch"),
        (F.col("needless_sources"), "sources_for_missing_data"), (F.col("discarded_used"), "discarded_candidate_used"), (F.coalesce("_score", F.lit(0.0)) - F.col("score") >= drop, "score_drop"),
    )
    return both.select("case_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in found]))).alias("regression"))


def retrieval_metrics(expected: DataFrame, ranked: DataFrame, packed: DataFrame, modes: DataFrame, forbidden: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """One row over all questions (key, expected_mode): top-1 and top-3 accuracy, recall at 5 and mean reciprocal rank of questions with
    right documents, precision of the packs, share of packs with a forbidden document, accuracy of modes and mean size of packs.

    expected and forbidden: (key, document_id), several a question; ranked: (key, document_id, rank); packed: (key, document_id), a row a
    chunk; modes: (key, answer_mode).
    """
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6)
    hits = expected.join(ranked, [key, "document_id"], "left").groupBy(key).agg(F.min("rank").alias("rank"), F.lit(True).alias("_wanted"))
    right, wrong = (x.select(key, "document_id", F.lit(1).alias(n)).distinct() for x, n in ((expected, "_right"), (forbidden, "_wrong")))
    packs = packed.join(right, [key, "document_id"], "left").join(wrong, [key, "document_id"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("_size"), F.count("_right").alias("_good"), F.count("_wrong").alias("_bad"))
    rows = questions.join(hits, key, "left").join(packs, key, "left").join(modes.select(key, "answer_mode"), key, "left")
    of_wanted = lambda c: F.when(F.col("_wanted"), F.coalesce(c.cast("double"), F.lit(0.0)))
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("questions"), F.count("_wanted").alias("with_documents"), mean(of_wanted(F.col("rank") <= 1)).alias("top1"), mean(of_wanted(F.col("rank") <= 3)).alias("top3"), mean(of_wanted(F.col("rank") <= 5)).alias("recall5"), mean(of_wanted(1 / F.col("rank"))).alias("mrr"),
        mean(F.when(F.col("_wanted") & (F.col("_size") > 0), F.col("_good") / F.col("_size"))).alias("evidence_precision"), share(F.col("_bad") > 0).alias("forbidden_leakage"), share(F.col("answer_mode") == F.col("expected_mode")).alias("mode_accuracy"), share(F.col("_size")).alias("mean_pack_size"),
    )
