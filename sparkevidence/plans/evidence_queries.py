"""Queries from analysed questions to evidence packs and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import evidence as V
from sparkevidence.operators import questions as Q
from sparkevidence.operators import retrieval as R
from sparkevidence.operators import routing
from sparkevidence.plans import corpus, retrieval_queries
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.plans.retrieval_queries import _CUT, _match_sql, _roots_sql
from sparkevidence.sources.cuts import cut


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]" + ("" if values else "::VARCHAR[]")


def _any(low: str, marks) -> str:
    return "(" + " OR ".join(f"contains({low}, '{m}')" for m in marks) + ")"


def _root(word: str) -> str:
    return word[:7] if len(word) >= 8 else word[:5] if len(word) >= 6 else word


_MARKS = sorted({m[:6] for m in Q.DEFAULT.environment + Q.DEFAULT.constraint} | {m[:6] for m, _ in Q.DEFAULT.action})
_PLATFORM = r"(regexp_matches(t, '[0-9]') AND regexp_matches(t, '\p{L}'))"
_GENERIC = f"list_contains({_list(sorted({_root(w) for w in Q.DEFAULT.generic}))}, {_CUT})"
_MARKED = "(" + " OR ".join(f"starts_with(t, '{m}')" for m in _MARKS) + ")"
_TASK = "CASE " + " ".join(f"WHEN {_any('low', marks)} THEN '{name}'" for name, marks in Q.DEFAULT.task.items()) + " ELSE 'general' END"
_ACTION = "CASE " + " ".join(f"WHEN contains(low, '{m}') THEN '{n}'" for m, n in Q.DEFAULT.action) + " ELSE '' END"
_WANTED = "list_filter([" + ", ".join(f"CASE WHEN {_any('low', marks)} THEN '{name}' END" for name, marks in Q.DEFAULT.content.items()) + "], lambda x: x IS NOT NULL)"
_BY_TASK = "CASE task_type " + " ".join(f"WHEN '{t}' THEN {_list(k)}" for t, k in Q.DEFAULT.task_content.items()) + " ELSE ['unknown'] END"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_EXACT = T.EXACT.replace("++", "+")


def _analysis_sql(name: str, source: str) -> str:
    """CTEs that end in one of this name: the rows of source, which have a question, analysed."""
    keys0 = f"list_filter(list_transform(regexp_extract_all(low, '{Q.TOKEN}'), lambda t: trim(t, '.,:;!?()[]{{}}')), lambda t: t <> '' AND NOT list_contains({_list(Q.DEFAULT.stopword)}, t))"
    first = lambda c: _FIRST.format(c)
    return f"""{name}0 AS (SELECT *, lower(question) AS low FROM {source}), {name}1 AS (SELECT *, {keys0} AS k0, {_TASK} AS task_type, {_ACTION} AS action, regexp_extract_all(question, '{_EXACT}') AS e0 FROM {name}0),
    {name}2 AS (SELECT *, ({first("k0")})[1:24] AS keys, ({first("e0")})[1:12] AS exact FROM {name}1),
    {name}3 AS (SELECT *, list_filter(keys, lambda t: {_PLATFORM}) AS platform, list_filter(keys, lambda t: {_GENERIC}) AS generic, (list_filter(keys, lambda t: NOT {_PLATFORM} AND NOT {_GENERIC} AND NOT {_MARKED}))[1:8] AS objects,
        list_filter({_list(Q.DEFAULT.environment)}, lambda m: contains(low, m)) AS environment, list_filter({_list(Q.DEFAULT.constraint)}, lambda m: contains(low, m)) AS constraints, {_any("low", Q.DEFAULT.fresh)} AS fresh,
        CASE WHEN task_type = 'debug' THEN regexp_extract_all(question, '{Q.QUOTED.replace("'", "''")}', 1) ELSE []::VARCHAR[] END AS symptoms, {_any("low", Q.DEFAULT.official)} OR task_type = 'source_check' AS official FROM {name}2),
    {name}4 AS (SELECT *, coalesce(objects[2], '') AS attribute, official OR fresh OR {_any("low", Q.DEFAULT.content["external_docs"])} AS needs_external,
        list_filter([CASE WHEN task_type = 'debug' AND len(symptoms) = 0 THEN 'error text' END, CASE WHEN task_type = 'visual' THEN 'image' END], lambda x: x IS NOT NULL) AS missing,
        list_filter([CASE WHEN len(regexp_extract_all(low, '{Q.TOKEN}')) <= 3 AND len(objects) = 0 THEN 'too_short' END, CASE WHEN {_any("low", Q.DEFAULT.deictic)} THEN 'refers_to_context' END], lambda x: x IS NOT NULL) AS ambiguity FROM {name}3),
    {name}5 AS (SELECT *, list_concat({_WANTED}, CASE WHEN needs_external THEN ['official_docs', 'external_docs'] ELSE []::VARCHAR[] END) AS w0 FROM {name}4),
    {name} AS (SELECT *, (CASE WHEN len(w0) > 0 THEN {first("w0")} ELSE {_BY_TASK} END)[1:4] AS content_types FROM {name}5)"""


_SOCIAL = f"len(regexp_extract_all(low, '{Q.TOKEN}')) BETWEEN 1 AND 3 AND len(list_filter(regexp_extract_all(low, '{Q.TOKEN}'), lambda t: NOT list_contains({_list(Q.DEFAULT.social)}, trim(t, '.,:;!?()[]{{}}')))) = 0"
_SHOWN = ("objects", "platform", "constraints", "environment", "exact", "content_types", "missing", "ambiguity")


@query(f"""WITH turns AS (SELECT conv_id, turn, md5(text) AS text_md5, text AS question FROM conversations WHERE role = 'user'), {_analysis_sql("a", "turns")}
    SELECT conv_id, turn, text_md5, {_SOCIAL} AS social, task_type, action, attribute, fresh, needs_external, len(generic) AS generic, len(symptoms) AS symptoms, {", ".join(f"array_to_string({c}, '|') AS {c}" for c in _SHOWN)} FROM a""")
def analyze_questions(spark, sf_dir):
    """User turns: what each asks for."""
    t = corpus.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("text_md5"), F.col("text").alias("question"))
    a = Q.analyze(t)
    return a.select("conv_id", "turn", "text_md5", "social", "task_type", "action", "attribute", "fresh", "needs_external", F.size("generic").alias("generic"), F.size("symptoms").alias("symptoms"), *[F.array_join(c, "|").alias(c) for c in _SHOWN])


_FACETS = (("platform", "platform", 1.0), ("action", "list_filter([action], lambda x: x <> '')", 1.0), ("exact", "exact", 1.0), ("object", "objects", 0.9), ("environment", "environment", 0.9), ("constraint", "constraints", 0.7), ("symptom", "symptoms", 1.0))


@query(with_sql("questions", then=f""", {_analysis_sql("a", "questions")} SELECT DISTINCT question_id, role, text, importance FROM ({" UNION ALL ".join(f"SELECT question_id, '{role}' AS role, unnest({c}) AS text, {w}::DOUBLE AS importance FROM a" for role, c, w in _FACETS)})"""))
def explode_facets(spark, sf_dir):
    """One row for each facet of a question."""
    return Q.facets(Q.analyze(corpus.questions(spark, sf_dir)))


@query(with_sql("questions", then=f""", {_analysis_sql("a", "questions")}, r AS (SELECT question_id, ambiguity, list_distinct(list_transform(objects, lambda t: {_CUT})) AS roots FROM a), known AS (SELECT list_distinct(list_transform(list(DISTINCT lower(split_part(text, ' ', 1))), lambda t: {_CUT})) AS k FROM documents),
    outside AS (SELECT list_distinct(list_transform(list(DISTINCT lower(regexp_extract(html, '<title>([^ <]+)', 1))), lambda t: {_CUT})) AS o FROM pages)
    SELECT question_id, len(list_intersect(roots, k)) = 0 AND (len(ambiguity) > 0 OR len(roots) <= 1) AS incomplete, len(list_intersect(roots, o)) > 0 AS out_of_base FROM r, known, outside"""))
def question_gates(spark, sf_dir):
    """Questions that are incomplete or ask for what lies outside. Known objects here: first words of documents; outside: of pages' titles."""
    known = corpus.table(spark, sf_dir, "documents").select(T.root(F.lower(F.substring_index("text", " ", 1))).alias("root")).distinct()
    outside = corpus.table(spark, sf_dir, "pages").select(T.root(F.lower(F.regexp_extract("html", "<title>([^ <]+)", 1))).alias("root")).distinct()
    return Q.gates(Q.analyze(corpus.questions(spark, sf_dir)), known, outside)


def _stems(column):
    return F.array_distinct(F.transform(column, T.root))


def _asked(spark, sf_dir, weights=None):
    """Analysed questions with the stems that scores need, and their weighted stems."""
    a = Q.analyze(corpus.questions(spark, sf_dir))
    weights = retrieval_queries.asked_weights(spark, sf_dir) if weights is None else weights
    some = lambda holds: F.array_sort(F.collect_list(F.when(holds, F.struct("root", "weight"))))
    w = weights.groupBy("question_id").agg(some(F.col("weight") >= V.ANCHOR).alias("anchors"), some(F.col("weight") < V.WEAK).alias("commons"), F.array_sort(F.collect_set(F.when(F.col("weight") >= V.STRONG, F.col("root")))).alias("strong"))
    words = F.filter(Q.keywords(F.col("question")), lambda t: ~F.array_contains(F.col("generic"), t))
    return a.join(w, "question_id").select(
        "question_id", "question", "task_type", "constraints", "exact", "missing", F.col("content_types").alias("expected"), F.col("needs_external").alias("external"), "anchors", "commons", "strong", (F.col("task_type") == "explain").alias("conceptual"),
        _stems(words).alias("q_roots"), _stems(F.col("objects")).alias("o_roots"), _stems(F.filter(F.array("action"), lambda x: x != "")).alias("a_roots"), _stems(F.concat("constraints", F.filter(F.array("attribute"), lambda x: x != ""))).alias("c_roots"),
        _stems(F.flatten(F.transform("symptoms", T.tokens))).alias("y_roots"), F.transform(F.slice("objects", 1, 3), lambda o: F.array(T.root(o))).alias("point_roots"), (~F.col("social")).alias("source_required"),
    )


def _scored(spark, sf_dir, weights=None, top=None):
    """Chunks of routed documents, scored, with the reason that rules them out. weights, top: asked_weights and top_documents where they
    are written already, so that the corpus is not counted and searched again."""
    weights = retrieval_queries.asked_weights(spark, sf_dir) if weights is None else weights
    top = cut(retrieval_queries.top_documents(spark, sf_dir, weights), "routed") if top is None else top
    top = top.select("question_id", "document_id", F.col("score").alias("base"))
    c = corpus.chunks(spark, sf_dir, R.small(top.select("document_id").distinct())).join(top, "document_id").join(_asked(spark, sf_dir, weights), "question_id")
    terms = lambda column: _stems(T.significant_terms(F.col(column)))
    c = c.withColumns(
        {
            "text_roots": terms("content"), "heading_roots": terms("heading"), "types": F.when(F.col("course") == "en", F.array(F.lit("lesson_material"))).otherwise(F.array(F.lit("student_case"))), "has_fact": F.col("content").rlike("[0-9]{3,}"),
            "not_about": F.lower("heading").startswith("not about"), "is_external": F.col("source_name") == "src1", "section_index": F.col("chunk_index"), "points_roots": F.col("o_roots"),
        }
    )
    return cut(V.discard_reason(V.score_evidence(c)), "scored")


def _kept(spark, sf_dir, weights=None, top=None):
    """The eight best chunks of each question that nothing rules out, reranked and decided."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.col("score") + F.when(F.col("has_fact"), 0.02).otherwise(0.0)), "document_id", "chunk_index"))
    rows = _scored(spark, sf_dir, weights, top).where("reason is null").withColumn("first_rank", rank).where("first_rank <= 8")
    return V.decide(V.rerank(rows))


_SQL_PARTS = {
    "base": "greatest(base, 0)", "overlap": "len(list_intersect(q_roots, text_roots)) / greatest(len(q_roots), 1)", "object": "len(list_intersect(o_roots, text_roots)) / greatest(len(o_roots), 1)", "action": "list_has_any(a_roots, text_roots)::INT", "constraint": "len(list_intersect(c_roots, text_roots)) / greatest(len(c_roots), 1)",
    "symptom": "len(list_intersect(y_roots, text_roots)) / greatest(len(y_roots), 1)", "anchor": "CASE WHEN len(anchors) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(list_filter(anchors, lambda x: list_contains(text_roots, x.root)), lambda x: x.weight)), 0) / list_sum(list_transform(anchors, lambda x: x.weight)) END",
    "common": "(len(list_filter(commons, lambda x: list_contains(text_roots, x.root))) > 0)::INT", "content_type": "list_has_any(list_filter(expected, lambda x: x <> 'unknown'), types)::INT", "fact": "has_fact::INT", "heading": "list_has_any(heading_roots, q_roots)::INT",
}
_STEMS = lambda x: f"list_distinct(list_transform({x}, lambda t: {_CUT}))"
_NONE = lambda c: f"(len({c}) > 0 AND NOT list_has_any({c}, text_roots))"
_EVIDENCE_CTE = f"""{_analysis_sql("a", "questions")},
    w AS (SELECT question_id, coalesce(list({{'root': root, 'weight': weight}} ORDER BY root) FILTER (WHERE weight >= {V.ANCHOR}), []) AS anchors, coalesce(list({{'root': root, 'weight': weight}} ORDER BY root) FILTER (WHERE weight < {V.WEAK}), []) AS commons, coalesce(list(root ORDER BY root) FILTER (WHERE weight >= {V.STRONG}), []) AS strong FROM asked GROUP BY 1),
    qa AS (SELECT question_id, question, task_type, constraints, exact, missing, content_types AS expected, needs_external AS external, anchors, commons, strong, task_type = 'explain' AS conceptual, NOT ({_SOCIAL}) AS source_required, {_STEMS("list_filter(keys, lambda t: NOT list_contains(generic, t))")} AS q_roots, {_STEMS("objects")} AS o_roots,
        {_STEMS("list_filter([action], lambda x: x <> '')")} AS a_roots, {_STEMS("list_concat(constraints, list_filter([attribute], lambda x: x <> ''))")} AS c_roots, {_STEMS(f"flatten(list_transform(symptoms, lambda s: regexp_extract_all(lower(s), '{T.TOKEN}')))")} AS y_roots, list_transform(objects[1:3], lambda t: {_CUT}) AS points FROM a JOIN w USING (question_id)),
    ev0 AS (SELECT t.score AS base, document_id, chunk_index, content, heading, course, source_name, {_roots_sql("content")} AS text_roots, {_roots_sql("heading")} AS heading_roots, CASE WHEN course = 'en' THEN ['lesson_material'] ELSE ['student_case'] END AS types, regexp_matches(content, '[0-9]{{3,}}') AS has_fact, starts_with(lower(heading), 'not about') AS not_about,
        qa.* FROM top_docs t JOIN chunks USING (document_id) JOIN qa USING (question_id)),
    ev1 AS (SELECT *, {", ".join(f"({x})::DOUBLE AS s_{k}" for k, x in _SQL_PARTS.items())} FROM ev0), ev2 AS (SELECT *, round(least({" + ".join(f"s_{k} * {w}::DOUBLE" for k, w in V.SCORE.items())}, {V.MOST_SCORE}) + {V.EVEN}::DOUBLE, 4) AS score FROM ev1),
    scored AS (SELECT *, CASE WHEN not_about THEN 'not-about section' WHEN {_NONE("o_roots")} THEN 'missing primary object terms' WHEN {_NONE("strong")} THEN 'missing strong evidence term' WHEN (len(constraints) > 0 OR task_type = 'debug') AND {_NONE("c_roots")} THEN 'missing requested constraint'
        WHEN task_type = 'debug' AND {_NONE("y_roots")} THEN 'missing requested symptom' WHEN score < {V.LEAST_SCORE} THEN 'below evidence threshold' END AS reason FROM ev2)"""
_RERANK_PARTS = {
    "object": "list_has_any(o_roots, text_roots)::INT", "action": "list_has_any(a_roots, text_roots)::INT", "constraint": "list_has_any(c_roots, text_roots)::INT", "requirement": "len(list_intersect(o_roots, text_roots)) / greatest(len(o_roots), 1)", "actionability": "act",
    "exact_anchor": "len(list_filter(exact, lambda x: contains(lower(content), lower(x)))) / greatest(len(exact), 1)", "heading": "len(list_intersect(q_roots, heading_roots)) / greatest(len(q_roots), 1)",
    "definition": """CASE WHEN conceptual THEN greatest(least(CASE WHEN list_has_any(o_roots, heading_roots) THEN CASE WHEN extra <= 3 THEN 0.42::DOUBLE ELSE 0.18::DOUBLE END ELSE 0 END + CASE WHEN list_has_any(o_roots, text_roots) THEN 0.12::DOUBLE ELSE 0 END
        + CASE WHEN regexp_matches(lower(content), '(^|[^a-z])(is|are|means|refers to)([^a-z]|$)|это |означает') THEN 0.34::DOUBLE ELSE 0 END + CASE WHEN chunk_index = 0 THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN extra >= 4 THEN 0.14::DOUBLE ELSE 0 END, 1), 0) ELSE 0 END""",
    "fact": "has_fact::INT", "near_miss": "not_about::INT",
    "weak": f"""least(CASE WHEN len(trim(content)) < 120 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN {_any("lower(content)", V.NAVIGATION)} THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN len(q_roots) > 0 AND s_overlap < 0.2 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN act = 0 AND list_contains({_list(V.PRACTICAL)}, task_type) THEN 0.08::DOUBLE ELSE 0 END, 0.45)""",
}
_ACT = "least((" + " + ".join(f"regexp_matches(content, '{s}')::INT" for s in V.ACTIONABLE) + ") / 4, 1)"
_HAVE = lambda c: f"list_has_any({c}, text_roots)"
_RERANK_CTE = f"""{_EVIDENCE_CTE}, k0 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score + CASE WHEN has_fact THEN 0.02::DOUBLE ELSE 0 END DESC, document_id, chunk_index) AS first_rank FROM scored WHERE reason IS NULL),
    k1 AS (SELECT *, {_ACT}::DOUBLE AS act, len(list_filter(heading_roots, lambda x: NOT list_contains(o_roots, x))) AS extra FROM k0 WHERE first_rank <= 8), k2 AS (SELECT *, {", ".join(f"({x})::DOUBLE AS r_{k}" for k, x in _RERANK_PARTS.items())} FROM k1),
    k3 AS (SELECT *, round(greatest(score + ({" + ".join(f"r_{k} * {w}::DOUBLE" for k, w in V.RERANK.items())}), 0) + {V.EVEN}::DOUBLE, 4) AS reranked, s_overlap < 0.34 AND act < 0.25 AND s_anchor < 0.34 AS generic_text, external AND source_name = 'src1' AND len(list_filter(o_roots, lambda x: NOT list_contains(text_roots, x))) > 0 AS uncovered, {_NONE("o_roots")} AS no_object,
        len(list_filter(expected, lambda x: x <> 'unknown')) > 0 AND len(types) > 0 AND s_content_type = 0 AS wrong, {_NONE("strong")} AS no_strong, {_HAVE("o_roots")} OR {_HAVE("a_roots")} OR {_HAVE("y_roots")} AS some_hit, r_requirement >= 0.5 AS covers FROM k2),
    k4 AS (SELECT *, greatest(len(list_intersect(o_roots, text_roots)) / greatest(len(o_roots), 1), s_anchor, s_symptom, s_constraint, CASE WHEN reranked >= 0.42 THEN 0.72 WHEN reranked >= 0.24 THEN 0.45 ELSE 0 END::DOUBLE, r_requirement, r_exact_anchor, CASE WHEN act >= 0.5 AND ({_HAVE("o_roots")} OR s_anchor > 0) THEN 0.70 ELSE 0 END::DOUBLE) AS support FROM k3),
    k5 AS (SELECT *, CASE WHEN trim(content) = '' OR reranked < 0.16 OR uncovered OR no_object THEN 'discarded' WHEN no_strong THEN CASE WHEN some_hit THEN 'partial' ELSE 'discarded' END WHEN generic_text AND r_exact_anchor < 0.2 AND r_requirement < 0.25 THEN 'partial' WHEN wrong AND support < 0.75 THEN 'discarded' WHEN generic_text AND support < 0.7 THEN 'partial'
        WHEN support >= 0.58 OR covers THEN 'accepted' WHEN support >= 0.35 OR some_hit THEN 'partial' ELSE 'discarded' END AS decision FROM k4),
    decided AS (SELECT *, list_filter([CASE WHEN reranked < 0.16 THEN 'below_evidence_threshold' END, CASE WHEN {_HAVE("o_roots")} THEN 'object_match' END, CASE WHEN {_HAVE("a_roots")} THEN 'action_match' END, CASE WHEN {_HAVE("y_roots")} THEN 'symptom_match' END, CASE WHEN {_HAVE("c_roots")} THEN 'constraint_match' END, CASE WHEN s_anchor > 0 THEN 'exact_anchor_match' END, CASE WHEN covers THEN 'covers_requirement' END,
        CASE WHEN act >= 0.25 THEN 'actionability' END, CASE WHEN r_heading > 0 THEN 'heading_match' END, CASE WHEN generic_text THEN 'too_generic' END, CASE WHEN uncovered THEN 'missing_external_docs_object_coverage' END, CASE WHEN no_object THEN 'missing_object_terms' END, CASE WHEN wrong THEN 'wrong_content_type' END, CASE WHEN no_strong THEN 'common_terms_only' END, CASE WHEN decision = 'partial' AND generic_text THEN 'insufficient_support' END], lambda x: x IS NOT NULL) AS reasons FROM k5)"""
_ORDER_SQL = "coalesce(list_sum(list_transform(reasons, lambda r: CASE r " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.PARTIAL_ORDER.items()) + " ELSE 0 END)), 0)"
_PACK_CTE = f"""{_RERANK_CTE}, p0 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY reranked DESC, document_id, chunk_index) AS rank, {_ORDER_SQL} AS ord FROM decided),
    p1 AS (SELECT question_id, list([{{'rank': rank, 'document_id': document_id, 'chunk_index': chunk_index, 'roots': text_roots, 'decision': decision, 'reranked': reranked, 'ord': ord}}] ORDER BY rank) AS e FROM p0 WHERE decision <> 'discarded' GROUP BY 1),
    p2 AS (SELECT question_id, unnest(list_reduce(e, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.decision = 'accepted' AND len(list_intersect(y.roots, x[1].roots)) / greatest(len(list_distinct(list_concat(y.roots, x[1].roots))), 1) >= 0.72)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM p1),
    p3 AS (SELECT question_id, x.*, max((x.decision = 'accepted')::INT) OVER (PARTITION BY question_id) AS any_accepted FROM p2),
    p4 AS (SELECT *, row_number() OVER (PARTITION BY question_id, decision ORDER BY CASE WHEN decision = 'partial' THEN -ord ELSE 0 END, CASE WHEN decision = 'partial' THEN -reranked ELSE 0 END, rank) AS place FROM p3),
    packed AS (SELECT * FROM p4 WHERE CASE WHEN any_accepted = 1 THEN decision = 'accepted' AND place <= 5 ELSE place = 1 OR (place = 2 AND ord >= 0) END)"""


@query(_match_sql(f", {_EVIDENCE_CTE} SELECT question_id, document_id, chunk_index, score, {', '.join(f'round(s_{k}, 4) AS {k}' for k in V.SCORE)} FROM scored"))
def score_evidence(spark, sf_dir):
    """Every chunk of the routed documents with its score and the parts of it."""
    return _scored(spark, sf_dir).select("question_id", "document_id", "chunk_index", "score", *[F.round(f"s_{k}", 4).alias(k) for k in V.SCORE])


@query(_match_sql(f", {_EVIDENCE_CTE} SELECT question_id, document_id, chunk_index, score, reason FROM scored"))
def discard_evidence(spark, sf_dir):
    """Every chunk of the routed documents with the first reason that rules it out."""
    return _scored(spark, sf_dir).select("question_id", "document_id", "chunk_index", "score", "reason")


@query(_match_sql(f", {_RERANK_CTE} SELECT question_id, document_id, chunk_index, reranked, round(act, 4) AS actionability, round(r_weak, 4) AS weak, round(r_heading, 4) AS heading FROM k3"))
def rerank(spark, sf_dir):
    return _kept(spark, sf_dir).select("question_id", "document_id", "chunk_index", "reranked", *[F.round(f"r_{k}", 4).alias(k) for k in ("actionability", "weak", "heading")])


@query(_match_sql(f", {_RERANK_CTE} SELECT question_id, document_id, chunk_index, decision, array_to_string(reasons, ',') AS reasons FROM decided"))
def decide_evidence(spark, sf_dir):
    return _kept(spark, sf_dir).select("question_id", "document_id", "chunk_index", "decision", F.array_join("reasons", ",").alias("reasons"))


def _packed(spark, sf_dir, weights=None, top=None):
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("reranked"), "document_id", "chunk_index"))
    rows = _kept(spark, sf_dir, weights, top).withColumns({"rank": rank, "id": F.struct("document_id", "chunk_index")})
    return cut(V.pack(rows), "packed")


@query(_match_sql(f", {_PACK_CTE} SELECT question_id, document_id, chunk_index, decision, place FROM packed"))
def pack_evidence(spark, sf_dir):
    """The chunks that an answer may rest on: accepted ones that say something new, or the best partial ones."""
    return _packed(spark, sf_dir).select("question_id", "id.document_id", "id.chunk_index", "decision", "place")


_MODE_CTE = f"""{_PACK_CTE}, c AS (SELECT question_id, count_if(decision = 'accepted') AS accepted, count_if(decision = 'partial') AS partial, list_distinct(flatten(list(roots))) AS have FROM packed GROUP BY 1),
    m0 AS (SELECT qa.*, coalesce(accepted, 0) AS accepted, coalesce(partial, 0) AS partial, len(list_filter(points, lambda p: list_contains(coalesce(have, []), p))) AS covered FROM qa LEFT JOIN c USING (question_id)),
    modes AS (SELECT question_id, accepted, partial, covered, CASE WHEN NOT source_required THEN 'general_answer_without_sources' WHEN len(missing) > 0 THEN 'ask_for_missing_data' WHEN accepted + partial = 0 THEN 'out_of_base' WHEN accepted < least(2, accepted + partial) THEN 'partial_answer'
        WHEN len(points) > 0 AND covered < greatest(1, len(points) // 2) THEN 'partial_answer' ELSE 'answer_from_materials' END AS answer_mode FROM m0)"""


@query(_match_sql(f", {_MODE_CTE} SELECT * FROM modes"))
def answer_mode(spark, sf_dir):
    weights = retrieval_queries.asked_weights(spark, sf_dir)
    return V.answer_modes(_asked(spark, sf_dir, weights), _packed(spark, sf_dir, weights))


@query(_match_sql(f", {_MODE_CTE} SELECT p.question_id, p.document_id, p.chunk_index, p.place FROM packed p JOIN modes USING (question_id) WHERE decision = 'accepted' AND answer_mode IN ('answer_from_materials', 'partial_answer')"))
def source_matches(spark, sf_dir):
    """The chunks of each pack that are named as sources of the answer."""
    weights = retrieval_queries.asked_weights(spark, sf_dir)
    p = _packed(spark, sf_dir, weights)
    return V.source_matches(p, V.answer_modes(_asked(spark, sf_dir, weights), p)).select("question_id", "id.document_id", "id.chunk_index", "place")


@query(_match_sql(f""", {_analysis_sql("a", "questions")}, {retrieval_queries._MENTION_CTE.replace("documents", "(SELECT question_id AS doc_id, question AS text FROM questions)")}, s AS (SELECT DISTINCT doc_id AS question_id FROM mentions)
    SELECT question_id, document_id, rank FROM top_docs JOIN a USING (question_id) LEFT JOIN s USING (question_id) WHERE rank <= CASE WHEN task_type IN ('compare', 'source_check') THEN 3 WHEN s.question_id IS NOT NULL THEN 5 ELSE 1 END""".replace("LEFT JOIN s USING (question_id)", "LEFT JOIN s ON s.question_id = a.question_id")))
def trusted_documents(spark, sf_dir):
    """Three documents for comparisons and source checks, five where a service is named, else one."""
    q = corpus.questions(spark, sf_dir)
    named = R.mentions(q, "question_id", "question", retrieval_queries._services(spark)).select("question_id").distinct().withColumn("named", F.lit(True))
    rows = retrieval_queries.top_documents(spark, sf_dir).join(Q.analyze(q).select("question_id", "task_type"), "question_id").join(named, "question_id", "left")
    most = F.when(F.col("task_type").isin("compare", "source_check"), 3).when(F.col("named"), 5).otherwise(1)
    return rows.where(F.col("rank") <= most).select("question_id", "document_id", "rank")


_FACET_SQL = "list_concat(list_concat(list_transform(exact, lambda t: {'root': CUT, 'importance': 1.0::DOUBLE}), list_transform(objects, lambda t: {'root': CUT, 'importance': 0.9::DOUBLE})), list_transform(list_filter([action], lambda x: x <> ''), lambda t: {'root': CUT, 'importance': 1.0::DOUBLE}))".replace("CUT", _CUT)
_SHARE = lambda a, b: f"len(list_intersect({a}, {b})) / greatest(len({a}), 1)"
_G = lambda k: f"least(g_{k}, {routing.SIGNALS[k][1]})"
_HITS = "(greatest(g_anchor, g_object, g_action, g_constraint) > 0 OR asked_hits > 0)"
_HOLDS = (
    "g_platform > 0 AND g_specific < 0.3 AND asked_hits = 0", "wrong", "NOT wrong AND has_expected AND len(types) = 0 AND asked_hits = 0 AND topic_hits = 0", "task_type <> 'compare' AND list_has_any(not_about_roots, list_concat(list_concat(o_roots, c_roots), y_roots))", f"g_common > 0 AND NOT {_HITS}",
    f"greatest(g_course, g_domain, g_platform) > 0 AND NOT {_HITS} AND g_symptom = 0", "len(anchors) > 0 AND g_anchor = 0", "len(o_roots) > 0 AND g_object = 0", "g_object > 0 AND len(o_roots) >= 3 AND g_object < 0.4", "len(a_roots) > 0 AND g_action = 0 AND asked_hits = 0",
    "len(c_roots) > 0 AND g_constraint = 0 AND task_type IN ('debug', 'setup')", "g_platform = 0 AND g_specific = 0 AND vector < 0.68",
)
_PENALTY_NAMES = ", ".join("CASE WHEN " + c + " THEN '" + n + "' END" for c, (n, _) in zip(_HOLDS, routing.PENALTIES) if n)
_MEAN = "CASE WHEN (g_object > 0)::INT + (g_action > 0)::INT + (g_symptom > 0)::INT = 0 THEN 0 ELSE least((g_object + g_action + g_symptom) / ((g_object > 0)::INT + (g_action > 0)::INT + (g_symptom > 0)::INT), 1) END"
_ROUTE_CTE = f"""{_EVIDENCE_CTE}, qx AS (SELECT question_id, qa.* EXCLUDE (question_id), list_transform(platform, lambda t: {_CUT}) AS platform_roots, {_FACET_SQL} AS facets, {_STEMS("keys")} AS keyword_roots, {_roots_sql("a.question")} AS needle_roots, {_STEMS("list_filter([coalesce(platform[1], a.exact[1], '')], lambda x: x <> '')")} AS domain_roots,
        CASE WHEN coalesce(platform[1], a.exact[1], '') <> '' THEN 0.72 ELSE 0 END::DOUBLE AS domain_confidence FROM (SELECT * EXCLUDE (exact, question) FROM qa) qa JOIN (SELECT question_id, question, platform, exact, objects, action, keys FROM a) a USING (question_id)),
    dx AS (SELECT doc_id AS document_id, {_roots_sql("text")} AS roots, {_roots_sql("split_part(text, chr(10), 1)")} AS title_roots, list_transform(string_split(text, chr(10))[1:30], lambda l: {_roots_sql("l")}) AS topics, CASE WHEN lang = 'en' THEN ['lesson_material'] WHEN lang = 'de' THEN ['student_case'] ELSE []::VARCHAR[] END AS types,
        CASE WHEN lang = 'fr' THEN ['debug', 'explain'] ELSE ['setup'] END AS task_types, CASE WHEN doc_id % 10 = 0 THEN {_roots_sql("split_part(text, chr(10), 2)")} ELSE []::VARCHAR[] END AS not_about_roots, least(1.0::DOUBLE, n_chars / 1000.0::DOUBLE) AS quality, doc_id FROM documents),
    r0 AS (SELECT t.score AS vector, dx.*, qx.*, [title_roots] AS asked, [lang_word] AS course_roots FROM top_docs t JOIN dx USING (document_id) JOIN qx USING (question_id), (SELECT 'englis' AS lang_word)),
    r1 AS (SELECT *, ({_SHARE("o_roots", "roots")})::DOUBLE AS g_object, ({_SHARE("a_roots", "roots")})::DOUBLE AS g_action, ({_SHARE("y_roots", "roots")})::DOUBLE AS g_symptom, least(len(list_filter(asked, lambda x: list_has_any(x, needle_roots))), 6) AS asked_hits, least(len(list_filter(topics, lambda x: list_has_any(x, needle_roots))), 6) AS topic_hits,
        list_filter(expected, lambda x: x <> 'unknown') AS ex FROM r0),
    r2 AS (SELECT *, len(ex) > 0 AS has_expected, vector AS g_vector, len(list_intersect(platform_roots, roots))::DOUBLE AS g_platform, (len(list_filter(commons, lambda x: list_contains(roots, x.root))) > 0)::INT::DOUBLE AS g_common, coalesce(list_sum(list_transform(list_filter(facets, lambda x: list_contains(roots, x.root)), lambda x: x.importance)), 0)::DOUBLE AS g_specific,
        ({_SQL_PARTS["anchor"].replace("text_roots", "roots")})::DOUBLE AS g_anchor, ({_SHARE("c_roots", "roots")})::DOUBLE AS g_constraint, CASE WHEN len(ex) > 0 AND len(list_intersect(ex, types)) > 0 THEN least(1.0::DOUBLE, len(list_intersect(ex, types)) / greatest(len(ex), 1) + 0.15::DOUBLE) ELSE 0 END::DOUBLE AS g_content_type,
        0::DOUBLE AS g_course, CASE WHEN list_has_any(domain_roots, roots) THEN greatest(0.25, least(1.0, domain_confidence)) ELSE 0 END::DOUBLE AS g_domain, (CASE WHEN asked_hits > 0 THEN 1.0 ELSE {_MEAN} END)::DOUBLE AS g_action_object, asked_hits * 0.20::DOUBLE AS g_question, topic_hits * 0.10::DOUBLE AS g_topic,
        CASE WHEN task_type <> 'general' AND list_contains(task_types, task_type) THEN 0.12 ELSE 0 END::DOUBLE AS g_task, ({_SHARE("keyword_roots", "roots")})::DOUBLE AS g_keyword, greatest(least(quality, 1.0::DOUBLE), 0) AS g_quality FROM r1),
    r3 AS (SELECT *, has_expected AND len(types) > 0 AND g_content_type = 0 AS wrong FROM r2)"""


@query(_match_sql(f", {_ROUTE_CTE} SELECT question_id, document_id, round(({' + '.join(f'{_G(k)} * {w}::DOUBLE' for k, (w, _) in routing.SIGNALS.items())}) {' '.join(f'* CASE WHEN {c} THEN {f}::DOUBLE ELSE 1 END' for c, (_, f) in zip(_HOLDS, routing.PENALTIES))} + {routing.EVEN}::DOUBLE, 4) AS route_score, array_to_string(list_filter([{_PENALTY_NAMES}], lambda x: x IS NOT NULL), ',') AS penalties, round(least({' + '.join(f'g_{k} * {w}::DOUBLE' for k, w in routing.ANSWERABLE.items())}, 1) + {routing.EVEN}::DOUBLE, 4) AS answerability FROM r3"))
def route_documents(spark, sf_dir):
    """Routed documents with their weighted signals, named penalties and how far they can answer."""
    stems = lambda c: _stems(T.significant_terms(c))
    q = corpus.questions(spark, sf_dir)
    a = Q.analyze(q)
    own = lambda c, w: F.transform(c, lambda t: F.struct(T.root(t).alias("root"), F.lit(w).alias("importance")))
    more = a.select(
        "question_id", F.transform("platform", T.root).alias("platform_roots"), F.concat(own("exact", 1.0), own("objects", 0.9), own(F.filter(F.array("action"), lambda x: x != ""), 1.0)).alias("facets"), _stems(Q.keywords(F.col("question"))).alias("keyword_roots"), stems(F.col("question")).alias("needle_roots"),
        _stems(F.filter(F.array("domain"), lambda x: x != "")).alias("domain_roots"), "domain_confidence", F.array(F.lit("englis")).alias("course_roots"), F.lit(0.0).alias("course_confidence"),
    )
    none = F.array().cast("array<string>")
    top = cut(retrieval_queries.top_documents(spark, sf_dir).select("question_id", "document_id", F.col("score").alias("vector")), "routed")
    d = corpus.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id").join(R.small(top.select("document_id").distinct()), "document_id", "left_semi")
    d = d.select(
        "document_id", stems(F.col("text")).alias("roots"), stems(F.substring_index("text", "\n", 1)).alias("title_roots"), F.transform(F.slice(F.split("text", "\n"), 1, 30), stems).alias("topics"), F.when(F.col("lang") == "en", F.array(F.lit("lesson_material"))).when(F.col("lang") == "de", F.array(F.lit("student_case"))).otherwise(none).alias("types"),
        F.when(F.col("lang") == "fr", F.array(F.lit("debug"), F.lit("explain"))).otherwise(F.array(F.lit("setup"))).alias("task_types"), F.when(F.col("document_id") % 10 == 0, stems(F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")))).otherwise(none).alias("not_about_roots"), F.least(F.lit(1.0), F.col("n_chars") / 1000).alias("quality"),
    ).withColumn("asked", F.array("title_roots"))
    rows = top.join(d, "document_id").join(_asked(spark, sf_dir).join(more, "question_id"), "question_id")
    return routing.route(rows).select("question_id", "document_id", "route_score", F.array_join("penalties", ",").alias("penalties"), "answerability")
