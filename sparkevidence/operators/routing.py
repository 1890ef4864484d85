"""Scores of documents for questions from eighteen signals and twelve penalties. The tables feed the columns and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signal to weight and the most that the signal counts. Fixed values.
SIGNALS = {
    "vector": (0.16, 1.0), "platform": (0.02, 1.5), "common": (0.04, 1.0), "specific": (0.12, 2.5), "anchor": (0.28, 1.0), "object": (0.34, 1.0), "action": (0.16, 1.0), "constraint": (0.16, 1.0), "symptom": (0.18, 1.0), "content_type": (0.16, 1.0), "course": (0.08, 1.0), "domain": (0.10, 1.0),
    "action_object": (0.10, 1.0), "question": (1.0, 0.40), "topic": (1.0, 0.30), "task": (1.0, 0.12), "keyword": (0.10, 1.0), "quality": (0.03, 1.0),
}
#: Penalties and their factors, in the order in which they apply; of the pairs only the first that holds does. The last has no name.
PENALTIES = (
    ("same_platform_but_wrong_task", 0.35), ("wrong_content_type", 0.58), ("unknown_content_type", 0.88), ("not_about", 0.18), ("general_common_term_only", 0.25), ("near_miss", 0.42), ("missing_anchor_terms", 0.78), ("missing_object_terms", 0.28), ("weak_object_coverage", 0.55),
    ("missing_action_terms", 0.72), ("missing_constraint_terms", 0.82), ("", 0.45),
)
#: Weights of what makes a document able to answer. Fixed values.
ANSWERABLE = {"anchor": 0.28, "object": 0.24, "action": 0.16, "symptom": 0.12, "constraint": 0.12, "content_type": 0.08}
EVEN = 1e-9


def _share(wanted: Column, have: Column) -> Column:
    return F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(1))


def signals(rows: DataFrame) -> DataFrame:
    """rows with g_<signal>. Of the question: platform_roots, facets (importance, root), anchors and commons (root, weight), o_roots, a_roots,
    c_roots, y_roots, keyword_roots, needle_roots, expected, course_hint roots with a confidence, domain_roots with one, task_type; of the
    document: roots, title_roots, topics and asked (arrays of root arrays), not_about_roots, types, task_types, vector, quality."""
    from sparkevidence.operators.evidence import weighted_share

    t = F.col("roots")
    matched = lambda items: F.least(F.size(F.filter(items, lambda x: F.arrays_overlap(x, "needle_roots"))), F.lit(6))
    wanted = F.filter("expected", lambda x: x != "unknown")
    both = F.size(F.array_intersect(wanted, "types"))
    specific = F.aggregate(F.filter("facets", lambda x: F.array_contains(t, x["root"])), F.lit(0.0), lambda s, x: s + x["importance"])
    rows = rows.withColumns({"g_object": _share(F.col("o_roots"), t), "g_action": _share(F.col("a_roots"), t), "g_symptom": _share(F.col("y_roots"), t), "_asked": matched("asked"), "_topics": matched("topics")})
    live = F.filter(F.array("g_object", "g_action", "g_symptom"), lambda x: x > 0)
    mean = F.when(F.size(live) == 0, 0.0).otherwise(F.least(F.aggregate(live, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(live), F.lit(1)), F.lit(1.0)))
    rest = {
        "vector": F.col("vector"), "platform": F.size(F.array_intersect("platform_roots", t)).cast("double"), "common": F.exists("commons", lambda x: F.array_contains(t, x["root"])).cast("double"), "specific": specific, "anchor": weighted_share(F.col("anchors"), t), "constraint": _share(F.col("c_roots"), t),
        "content_type": F.when((F.size(wanted) > 0) & (both > 0), F.least(F.lit(1.0), both / F.greatest(F.size(wanted), F.lit(1)) + 0.15)).otherwise(0.0), "course": F.when(F.arrays_overlap("course_roots", "title_roots"), F.least(F.lit(1.0), _share(F.col("course_roots"), F.col("title_roots")) * F.greatest("course_confidence", F.lit(0.35)))).otherwise(0.0),
        "domain": F.when(F.arrays_overlap("domain_roots", "roots"), F.greatest(F.lit(0.25), F.least(F.lit(1.0), "domain_confidence"))).otherwise(0.0), "action_object": F.when(F.col("_asked") > 0, 1.0).otherwise(mean), "question": F.col("_asked") * 0.20, "topic": F.col("_topics") * 0.10,
        "task": F.when((F.col("task_type") != "general") & F.array_contains("task_types", F.col("task_type")), 0.12).otherwise(0.0), "keyword": _share(F.col("keyword_roots"), t), "quality": F.greatest(F.least("quality", F.lit(1.0)), F.lit(0.0)),
    }
    return rows.withColumns({f"g_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in rest.items()})


def route(rows: DataFrame) -> DataFrame:
    """rows with route_score, penalties (names) and answerability, from signals()."""
    rows = signals(rows)
    g = lambda k: F.least(F.col(f"g_{k}"), F.lit(SIGNALS[k][1]))
    some = lambda *names: F.greatest(*[F.col(f"g_{n}") for n in names]) > 0
    wanted = F.size(F.filter("expected", lambda x: x != "unknown")) > 0
    hits = some("anchor", "object", "action", "constraint") | (F.col("_asked") > 0)
    about = (F.col("task_type") != "compare") & F.arrays_overlap("not_about_roots", F.concat("o_roots", "c_roots", "y_roots"))
    wrong = wanted & (F.size("types") > 0) & (F.col("g_content_type") == 0)
    holds = (
        (F.col("g_platform") > 0) & (F.col("g_specific") < 0.3) & (F.col("_asked") == 0), wrong, ~wrong & wanted & (F.size("types") == 0) & (F.col("_asked") == 0) & (F.col("_topics") == 0), about, (F.col("g_common") > 0) & ~hits,
        some("course", "domain", "platform") & ~hits & (F.col("g_symptom") == 0), (F.size("anchors") > 0) & (F.col("g_anchor") == 0), (F.size("o_roots") > 0) & (F.col("g_object") == 0), (F.col("g_object") > 0) & (F.size("o_roots") >= 3) & (F.col("g_object") < 0.4),
        (F.size("a_roots") > 0) & (F.col("g_action") == 0) & (F.col("_asked") == 0), (F.size("c_roots") > 0) & (F.col("g_constraint") == 0) & F.col("task_type").isin("debug", "setup"), (F.col("g_platform") == 0) & (F.col("g_specific") == 0) & (F.col("vector") < 0.68),
    )
    total = sum((g(k) * w for k, (w, _) in SIGNALS.items()), F.lit(0.0))
    for condition, (_, factor) in zip(holds, PENALTIES):
        total = total * F.when(F.coalesce(condition, F.lit(False)), factor).otherwise(1.0)
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, (n, _) in zip(holds, PENALTIES) if n]))
    able = F.least(sum((F.col(f"g_{k}") * w for k, w in ANSWERABLE.items()), F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({"route_score": F.round(total + EVEN, 4), "penalties": names, "answerability": F.round(able + EVEN, 4)})
