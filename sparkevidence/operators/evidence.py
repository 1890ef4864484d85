"""From routed chunks to an evidence pack: scores, reasons to discard, reranking, decisions, the pack and the mode of the answer.

Rows are pairs of a question and a chunk with arrays of stems; all rules are columns over tables of weights, which also make the SQL
that checks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts of a chunk's score. Fixed values.
SCORE = {"base": 0.30, "overlap": 0.32, "object": 0.26, "action": 0.08, "constraint": 0.12, "symptom": 0.14, "anchor": 0.20, "common": 0.03, "content_type": 0.06, "fact": 0.16, "heading": 0.08}
MOST_SCORE, LEAST_SCORE = 1.5, 0.18
#: Added before rounding, so that sums which only differ in their last bit are rounded alike.
EVEN = 1e-9
#: A stem by its weight: the least of an anchor, of a strong term, and below which it is weak. Fixed values.
ANCHOR, STRONG, WEAK = 1.05, 0.85, 0.45
#: What reranking adds, by part. Fixed values.
RERANK = {"object": 0.16, "action": 0.08, "constraint": 0.10, "requirement": 0.20, "actionability": 0.22, "exact_anchor": 0.20, "heading": 0.10, "definition": 0.50, "fact": 0.12, "near_miss": -0.30, "weak": -1.0}
#: Shapes of text that can be acted on; four of them count in full. Fixed values.
ACTIONABLE = (
    r"(^|\n)[ \t]*([0-9]+[.)]|[-*•])[ \t]+[^ \t\n]",
    r"`[^`]+`|```",
    r"(?i)(^|[^a-z0-9_])(python|pip|npm|npx|node|docker|git|curl|touch|mkdir|cd|psql)([^a-z0-9_]|$)",
    r"[A-Za-z0-9_.-]+[.](json|ya?ml|toml|env|md|txt|py|js|ts|sql|html|css)([^A-Za-z0-9_]|$)",
    r"(^|[^A-Za-z0-9_])([A-Z][A-Z0-9_]{2,}([^A-Za-z0-9_]|$)|[a-zA-Z_][a-zA-Z0-9_]*=)",
    r"(?i)example|result|error|condition|пример|провер|результат|ошибка|если|условие",
    r"(?i)create|add |set |use |run |open |создай|добавь|укажи|настрой|используйте|запусти|открой",
)
NAVIGATION = ("previous lesson", "next lesson", "subscribe", "следующий урок", "предыдущий урок", "подписаться", "текст страницы")
#: Tasks whose chunks should be something to act on.
PRACTICAL = ("setup", "debug", "admin", "general")
#: Order among partial chunks by their reasons. Fixed values.
PARTIAL_ORDER = {"covers_requirement": 3, "exact_anchor_match": 2, "actionability": 2, "heading_match": 1, "common_terms_only": -4, "wrong_content_type": -3, "too_generic": -1, "insufficient_support": -1}
SOURCED = ("answer_from_materials", "partial_answer")


def share(wanted: Column, have: Column) -> Column:
    """Share of the wanted stems that are there, 0 if none is wanted."""
    return F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(1))


def weighted_share(wanted: Column, have: Column) -> Column:
    """The same by weights: wanted is an array of structs (root, weight)."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["weight"])
    return F.when(F.size(wanted) == 0, 0.0).otherwise(total(F.filter(wanted, lambda x: F.array_contains(have, x["root"]))) / F.greatest(total(wanted), F.lit(1e-9)))


def score_evidence(rows: DataFrame) -> DataFrame:
    """rows with s_<part> for each part of SCORE and their sum, score.

    rows: base (a search score), text_roots and heading_roots of the chunk; query, object, action, constraint and symptom roots of the
    question (q_roots, o_roots, a_roots, c_roots, y_roots), its anchors and commons (root, weight), wanted content types (expected), the
    chunk's types, and has_fact.
    """
    t = F.col("text_roots")
    commons = F.filter("commons", lambda x: F.array_contains(t, x["root"]))
    parts = {
        "base": F.greatest("base", F.lit(0.0)), "overlap": share(F.col("q_roots"), t), "object": share(F.col("o_roots"), t), "action": F.arrays_overlap("a_roots", t).cast("double"), "constraint": share(F.col("c_roots"), t), "symptom": share(F.col("y_roots"), t),
        "anchor": weighted_share(F.col("anchors"), t), "common": (F.size(commons) > 0).cast("double"), "content_type": F.arrays_overlap(F.filter("expected", lambda x: x != "unknown"), F.col("types")).cast("double"), "fact": F.col("has_fact").cast("double"),
        "heading": F.arrays_overlap("heading_roots", "q_roots").cast("double"),
    }
    rows = rows.withColumns({f"s_{k}": F.coalesce(c, F.lit(0.0)) for k, c in parts.items()})
    return rows.withColumn("score", F.round(F.least(sum((F.col(f"s_{k}") * w for k, w in SCORE.items()), F.lit(0.0)), F.lit(MOST_SCORE)) + EVEN, 4))


def discard_reason(rows: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """rows with reason, the first that rules a scored chunk out, null for none. rows also have not_about, strong (roots) and task_type."""
    t = F.col("text_roots")
    none = lambda c: (F.size(c) > 0) & ~F.arrays_overlap(c, t)
    reason = (
        F.when(F.col("not_about"), "not-about section")
        .when(none("o_roots"), "missing primary object terms")
        .when(none("strong"), "missing strong evidence term")
        .when(((F.size("constraints") > 0) | (F.col("task_type") == "debug")) & none("c_roots"), "missing requested constraint")
        .when((F.col("task_type") == "debug") & none("y_roots"), "missing requested symptom")
        .when(F.col("score") < least, "below evidence threshold")
    )
    return rows.withColumn("reason", reason)


def actionability(text: Column) -> Column:
    return F.least(sum((text.rlike(s).cast("int") for s in ACTIONABLE), F.lit(0)) / 4, F.lit(1.0))


def rerank(rows: DataFrame) -> DataFrame:
    """rows with r_<part> for each part of RERANK and reranked, not below 0. rows are scored, with content, exact (code-shaped terms of the
    question), section_index, conceptual and points_roots (roots of what the question needs)."""
    t, low = F.col("text_roots"), F.lower("content")
    act = actionability(F.col("content"))
    navigation = F.lit(False)
    for mark in NAVIGATION:
        navigation = navigation | F.contains(low, F.lit(mark))
    weak = F.when(F.length(F.btrim("content")) < 120, 0.10).otherwise(0.0) + F.when(navigation, 0.18).otherwise(0.0) + F.when((F.size("q_roots") > 0) & (F.col("s_overlap") < 0.2), 0.12).otherwise(0.0) + F.when((act == 0) & F.col("task_type").isin(*PRACTICAL), 0.08).otherwise(0.0)
    in_heading = F.arrays_overlap("o_roots", "heading_roots")
    extra = F.size(F.array_except("heading_roots", "o_roots"))
    definition = F.when(in_heading, F.when(extra <= 3, 0.42).otherwise(0.18)).otherwise(0.0) + F.when(F.arrays_overlap("o_roots", "text_roots"), 0.12).otherwise(0.0) + F.when(low.rlike(r"(^|[^a-z])(is|are|means|refers to)([^a-z]|$)|это |означает"), 0.34).otherwise(0.0)
    definition = definition + F.when(F.col("section_index") == 0, 0.10).otherwise(0.0) - F.when(extra >= 4, 0.14).otherwise(0.0)
    parts = {
        "object": F.arrays_overlap("o_roots", t).cast("double"), "action": F.arrays_overlap("a_roots", t).cast("double"), "constraint": F.arrays_overlap("c_roots", t).cast("double"), "requirement": share(F.col("points_roots"), t), "actionability": act,
        "exact_anchor": F.size(F.filter("exact", lambda x: F.contains(low, F.lower(x)))) / F.greatest(F.size("exact"), F.lit(1)), "heading": share(F.col("q_roots"), F.col("heading_roots")),
        "definition": F.when(F.col("conceptual"), F.greatest(F.least(definition, F.lit(1.0)), F.lit(0.0))).otherwise(0.0), "fact": F.col("has_fact").cast("double"), "near_miss": F.col("not_about").cast("double"), "weak": F.least(weak, F.lit(0.45)),
    }
    rows = rows.withColumns({f"r_{k}": F.coalesce(c, F.lit(0.0)) for k, c in parts.items()})
    return rows.withColumn("reranked", F.round(F.greatest(F.col("score") + sum((F.col(f"r_{k}") * w for k, w in RERANK.items()), F.lit(0.0)), F.lit(0.0)) + EVEN, 4))


def decide(rows: DataFrame) -> DataFrame:
    """rows with decision (accepted, partial, discarded) and reasons. Reranked rows, with external (the question wants outside documents)
    and is_external (the chunk is of one)."""
    have = lambda c: F.arrays_overlap(c, "text_roots")
    object_share, anchor_share = share(F.col("o_roots"), F.col("text_roots")), F.col("s_anchor")
    act, exact, needed = F.col("r_actionability"), F.col("r_exact_anchor"), F.col("r_requirement")
    generic = (F.col("s_overlap") < 0.34) & (act < 0.25) & (F.col("s_anchor") < 0.34)
    uncovered = F.col("external") & F.col("is_external") & (F.size(F.array_except("o_roots", "text_roots")) > 0)
    no_object = (F.size("o_roots") > 0) & ~have("o_roots")
    wrong = (F.size(F.filter("expected", lambda x: x != "unknown")) > 0) & (F.size("types") > 0) & (F.col("s_content_type") == 0)
    no_strong = (F.size("strong") > 0) & ~have("strong")
    some = have("o_roots") | have("a_roots") | have("y_roots")
    support = F.greatest(object_share, anchor_share, F.col("s_symptom"), F.col("s_constraint"), F.when(F.col("reranked") >= 0.42, 0.72).when(F.col("reranked") >= 0.24, 0.45).otherwise(0.0), needed, exact)
    support = F.greatest(support, F.when((act >= 0.5) & (have("o_roots") | (anchor_share > 0)), 0.70).otherwise(0.0))
    covers = needed >= 0.5
    decision = (
        F.when(F.btrim("content") == "", "discarded").when(F.col("reranked") < 0.16, "discarded").when(uncovered | no_object, "discarded").when(no_strong, F.when(some, "partial").otherwise("discarded"))
        .when(generic & (exact < 0.2) & (needed < 0.25), "partial").when(wrong & (support < 0.75), "discarded").when(generic & (support < 0.7), "partial").when((support >= 0.58) | covers, "accepted").when((support >= 0.35) | some, "partial").otherwise("discarded")
    )
    reason = (
        (F.col("reranked") < 0.16, "below_evidence_threshold"), (have("o_roots"), "object_match"), (have("a_roots"), "action_match"), (have("y_roots"), "symptom_match"), (have("c_roots"), "constraint_match"), (anchor_share > 0, "exact_anchor_match"), (covers, "covers_requirement"),
        (act >= 0.25, "actionability"), (F.col("r_heading") > 0, "heading_match"), (generic, "too_generic"), (uncovered, "missing_external_docs_object_coverage"), (no_object, "missing_object_terms"), (wrong, "wrong_content_type"), (no_strong, "common_terms_only"),
        ((decision == "partial") & generic, "insufficient_support"),
    )
    return rows.withColumns({"decision": decision, "reasons": F.array_compact(F.array(*[F.when(c, n) for c, n in reason]))})


def partial_order(reasons: Column) -> Column:
    return F.aggregate(reasons, F.lit(0), lambda s, r: s + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in PARTIAL_ORDER.items() for x in (k, v)]), r), F.lit(0)))


def pack(rows: DataFrame, question: str = "question_id", most: int = 5, alike: float = 0.72) -> DataFrame:
    """Rows of the pack, with place: in order of rank a chunk goes if its stems overlap an accepted one's by `alike`; of the accepted
    ones `most` stay, and where there is none the two best partial ones. rows are decided, with rank, id and text_roots, a few a question."""
    item = F.struct("rank", "id", F.col("text_roots").alias("roots"), "decision", "reranked", partial_order(F.col("reasons")).alias("order"))
    ranked = rows.where("decision <> 'discarded'").groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("e"))
    same = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) >= alike
    accepted = lambda acc: F.filter(acc, lambda y: y["decision"] == "accepted")
    kept = F.aggregate("e", F.filter("e", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(accepted(acc), lambda y: same(x["roots"], y["roots"])), acc).otherwise(F.concat(acc, F.array(x))))
    each = ranked.select(question, F.explode(kept).alias("x")).select(question, "x.*")
    any_accepted = F.max((F.col("decision") == "accepted").cast("int")).over(Window.partitionBy(question))
    each = each.withColumn("_any", any_accepted)
    by_partial = [F.when(F.col("decision") == "partial", -F.col("order")).otherwise(0), F.when(F.col("decision") == "partial", -F.col("reranked")).otherwise(0.0), "rank"]
    place = F.row_number().over(Window.partitionBy(question, "decision").orderBy(*by_partial))
    each = each.withColumn("place", place)
    weak = F.col("order") < 0
    chosen = F.when(F.col("_any") == 1, (F.col("decision") == "accepted") & (F.col("place") <= most)).otherwise((F.col("place") == 1) | ((F.col("place") == 2) & ~weak))
    return each.where(chosen).select(question, "id", "decision", "place", "rank", "roots")


def answer_modes(questions: DataFrame, packed: DataFrame, question: str = "question_id") -> DataFrame:
    """(question, accepted, partial, covered, answer_mode). questions: source_required, missing, and points_roots, an array of roots for each
    point that the answer has to make; packed: rows of the pack."""
    c = packed.groupBy(question).agg(F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "partial").alias("partial"), F.array_distinct(F.flatten(F.collect_list("roots"))).alias("_roots"))
    rows = questions.join(c, question, "left").withColumns({"accepted": F.coalesce("accepted", F.lit(0)), "partial": F.coalesce("partial", F.lit(0)), "_roots": F.coalesce("_roots", F.array().cast("array<string>"))})
    covered = F.size(F.filter("point_roots", lambda p: F.arrays_overlap(p, F.col("_roots"))))
    n = F.col("accepted") + F.col("partial")
    uncovered = (F.size("point_roots") > 0) & (covered < F.greatest(F.lit(1), F.floor(F.size("point_roots") / 2).cast("int")))
    mode = (
        F.when(~F.col("source_required"), "general_answer_without_sources").when(F.size("missing") > 0, "ask_for_missing_data").when(n == 0, "out_of_base").when(F.col("accepted") < F.least(F.lit(2), n), "partial_answer").when(uncovered, "partial_answer").otherwise("answer_from_materials")
    )
    return rows.select(question, "accepted", "partial", covered.alias("covered"), mode.alias("answer_mode"))


def source_matches(packed: DataFrame, modes: DataFrame, question: str = "question_id") -> DataFrame:
    """Rows of the pack that are named as sources: accepted ones of answers that rest on materials."""
    return packed.where("decision = 'accepted'").join(modes.where(F.col("answer_mode").isin(*SOURCED)).select(question), question, "left_semi")
