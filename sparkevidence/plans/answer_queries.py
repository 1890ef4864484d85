"""Queries of answers, their checks, suggestion states and derived cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import answers as A
from sparkevidence.operators import evidence as V
from sparkevidence.operators import retrieval as R
from sparkevidence.operators import terms
from sparkevidence.plans import corpus, evidence_queries, retrieval_queries
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.plans.corpus_queries import _STATS_CTE, _TERMS_CTE, _redact_sql
from sparkevidence.plans.evidence_queries import _MODE_CTE
from sparkevidence.plans.retrieval_queries import _match_sql, _roots_sql

_WHY = lambda *rules: "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for c, n in rules) + "], lambda x: x IS NOT NULL)"
_CLEAN1 = "regexp_replace(regexp_replace(trim(regexp_replace(p, '[ \\t\\n]+', ' ', 'g'), ' -'), '^#+ *', ''), '^[0-9]+[.)] *', '')"
_NOISY = " OR ".join(f"contains(lower(sentence), '{m}')" for m in A.NOISY)
_GAIN = " + ".join(f"CASE WHEN regexp_matches(sentence, '{s}') THEN {w}::DOUBLE ELSE 0 END" for w, s in A.SENTENCE)
_SENTENCES = f"""{_MODE_CTE}, l0 AS (SELECT question_id, place, unnest(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM packed JOIN chunks USING (document_id, chunk_index)),
    l1 AS (SELECT question_id, place, unnest(string_split(regexp_replace(line, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1))) AS p FROM l0), l2 AS (SELECT question_id, place, {_CLEAN1} AS c FROM l1), l3 AS (SELECT question_id, place, CASE WHEN len(c) > 240 THEN rtrim(substring(c, 1, 237)) || '...' ELSE c END AS sentence FROM l2),
    l4 AS (SELECT *, round({_GAIN} + greatest(0, 0.12::DOUBLE - (place - 1) * 0.02::DOUBLE), 4) AS gain, array_to_string((string_split(lower(sentence), ' '))[1:18], ' ') AS k FROM l3 WHERE len(sentence) >= 18 AND NOT regexp_matches(sentence, '^[=_ -]+$') AND NOT ({_NOISY})),
    l5 AS (SELECT *, row_number() OVER (PARTITION BY question_id, k ORDER BY gain DESC, place, sentence) AS r FROM l4), said AS (SELECT question_id, sentence, row_number() OVER (PARTITION BY question_id ORDER BY gain DESC, place, sentence) AS rank FROM l5 WHERE r = 1)"""


def _said(spark, sf_dir, packed):
    # Packs hold a few chunks a question, so they go to the texts; no text is shuffled.
    c = corpus.chunks(spark, sf_dir, R.small(packed.select("id.document_id").distinct()))
    p = packed.select("question_id", "place", "id.document_id", "id.chunk_index")
    return A.sentences(c.join(R.small(p), ["document_id", "chunk_index"]))


@query(_match_sql(f", {_SENTENCES} SELECT question_id, rank, sentence FROM said WHERE rank <= 5"))
def extractive_sentences(spark, sf_dir):
    """The five best sentences of each question's evidence pack."""
    return _said(spark, sf_dir, evidence_queries._packed(spark, sf_dir))


_BULLETS = lambda n: f"coalesce((SELECT string_agg(chr(10) || '- ' || sentence, '' ORDER BY rank) FROM said WHERE said.question_id = m.question_id AND rank <= {n}), '')"
_OPEN = "CASE WHEN len(uncovered) > 0 THEN chr(10) || 'Nothing was found on: ' || array_to_string(uncovered, ', ') || '.' ELSE '' END"


@query(_match_sql(f""", {_SENTENCES}, u AS (SELECT question_id, missing, list_filter(points, lambda p: NOT list_contains(coalesce(have, []), p)) AS uncovered FROM qa LEFT JOIN c USING (question_id)), m AS (SELECT modes.*, missing, uncovered, EXISTS (SELECT 1 FROM said WHERE said.question_id = modes.question_id) AS any_said FROM modes JOIN u USING (question_id))
    SELECT question_id, CASE WHEN answer_mode = 'answer_from_materials' AND any_said THEN 'The materials say:' || {_BULLETS(5)} || {_OPEN} WHEN answer_mode = 'partial_answer' THEN 'The materials tell a part of it:' || {_BULLETS(4)} || {_OPEN}
        WHEN answer_mode IN ('ask_for_missing_data', 'answer_from_materials') THEN 'Needed: ' || array_to_string(CASE WHEN len(missing) > 0 THEN missing ELSE ['a passage of the materials that confirms it'] END, ', ') || '.' WHEN answer_mode = 'out_of_base' THEN 'The materials hold no passage that confirms an answer.' ELSE '' END AS answer,
        CASE answer_mode WHEN 'answer_from_materials' THEN 'answered' WHEN 'partial_answer' THEN 'partial' WHEN 'ask_for_missing_data' THEN 'needs_input' WHEN 'out_of_base' THEN 'not_found' ELSE 'general' END AS status FROM m"""))
def extractive_answers(spark, sf_dir):
    """A text for each question, from its evidence pack and by its mode."""
    weights = retrieval_queries.asked_weights(spark, sf_dir)
    q, packed = evidence_queries._asked(spark, sf_dir, weights), evidence_queries._packed(spark, sf_dir, weights)
    modes = V.answer_modes(q, packed)
    have = packed.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list("roots"))).alias("have"))
    open_points = F.filter(F.flatten("point_roots"), lambda p: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), p))
    points = q.join(have, "question_id", "left").select("question_id", "missing", open_points.alias("uncovered"))
    return A.extractive_answers(modes.join(points, "question_id"), _said(spark, sf_dir, packed))


_MARK, _LINES = A.SOURCE_MARK.replace("'", "''"), "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_MARKED = f"(regexp_matches(x, '{_MARK}') OR starts_with(lower(x), '- http'))"


@query(f"""WITH v AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'Sources: ' || text ELSE text END AS text FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, list_distinct(flatten(list({_roots_sql("text")}))) AS roots FROM conversations WHERE role = 'user' GROUP BY 1),
    b AS (SELECT v.*, coalesce(u.roots, []) AS roots, {_LINES} AS ls FROM v LEFT JOIN u USING (conv_id)), w AS (SELECT *, {_roots_sql(f"regexp_replace(array_to_string(list_filter(ls, lambda x: NOT {_MARKED}), chr(10)), 'https?://[^ ' || chr(10) || ']+', ' ', 'g')")} AS words FROM b)
    SELECT conv_id, turn, md5(text) AS text_md5, coalesce(((regexp_matches(text, '{_MARK}') OR regexp_matches(lower(text), 'https?://|docs')) AND (len(words) = 0 OR (len(words) <= 6 AND len(list_intersect(words, roots)) < 2) OR (len(text) <= 160 AND len(list_intersect(words, roots)) < 2))) OR (len(ls) > 0 AND len(list_filter(ls, lambda x: NOT {_MARKED})) = 0), false) AS source_only FROM w""")
def weak_answer(spark, sf_dir):
    """Assistant turns (every fourth led by a mark of sources) that only name sources, against the words of the user's turns."""
    t = corpus.table(spark, sf_dir, "conversations")
    roots = t.where("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(F.transform(T.significant_terms(F.col("text")), T.root))))).alias("roots"))
    v = t.where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Sources: "), "text")).otherwise(F.col("text")).alias("answer"))
    v = v.join(roots, "conv_id", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))
    return A.weak_answers(v).select("conv_id", "turn", F.md5("answer").alias("text_md5"), "source_only")


_HEDGED = " OR ".join(f"contains(lower(s), '{h}')" for h in A.HEDGES)


@query(f"""WITH s AS (SELECT conv_id, turn, md5(text) AS text_md5, list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(s) > 0) AS ss FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, text_md5, len(ss) AS sentences, len(list_filter(ss, lambda s: NOT ({_HEDGED}) AND NOT ends_with(rtrim(s), ':') AND len(regexp_extract_all(s, '{T.TOKEN}')) >= 3)) AS claims FROM s""")
def split_claims(spark, sf_dir):
    """How many sentences of each assistant turn claim something."""
    t = corpus.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.size(T.split_sentences(F.col("text"))).alias("sentences"), F.size(A.claims(F.col("text"))).alias("claims"))


@query("""WITH a AS (SELECT conv_id, count_if(role = 'assistant') AS answered, count_if(role = 'assistant' AND len(text) >= 60) AS supported, coalesce(bool_or(role = 'assistant' AND regexp_matches(text, 'https?://|(?i)source:')), false) AS leaks FROM conversations GROUP BY 1),
    s AS (SELECT *, CASE WHEN answered = 0 THEN 'needs_input' WHEN answered > 3 THEN 'partial' ELSE 'answered' END AS status FROM a), f AS (SELECT *, CASE WHEN status NOT IN ('answered', 'partial') THEN status WHEN answered > 0 AND supported = 0 THEN 'not_found' WHEN supported < answered OR leaks THEN 'partial' ELSE status END AS final_status FROM s)
    SELECT conv_id, status, answered AS claims, supported, leaks, final_status, final_status IN ('answered', 'partial') AND NOT leaks AS show_sources FROM f""")
def final_status(spark, sf_dir):
    """Conversations' drafts after their claims were looked at; here an answer is a claim, long ones are supported."""
    said = F.col("role") == "assistant"
    a = corpus.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(said).alias("claims"), F.count_if(said & (F.length("text") >= 60)).alias("supported"), F.coalesce(F.bool_or(said & F.col("text").rlike("https?://|(?i)source:")), F.lit(False)).alias("leaks"))
    rows = a.withColumn("status", F.when(F.col("claims") == 0, "needs_input").when(F.col("claims") > 3, "partial").otherwise("answered"))
    return A.final_status(rows).select("conv_id", "status", "claims", "supported", "leaks", "final_status", "show_sources")


_E5 = [("i % 17 = 0", "empty_answer"), ("i % 7 = 0", "status_not_allowed"), ("i % 9 = 0", "mode_not_allowed"), ("coalesce(s0, '') <> 'active'", "selected_document_not_active"), ("i % 10 = 0", "no_accepted_evidence"), ("i % 10 <> 0 AND coalesce(s0, '') <> 'active'", "accepted_evidence_not_active"), ("i % 8 = 0 OR i % 10 = 0", "source_not_from_evidence"), ("s0 = 'archived'", "archived_document"),
       ("i % 10 <> 0 AND NOT contains(lower(text), lower(lang))", "required_terms_missing"), ("i % 17 <> 0 AND i % 11 = 0", "raw_uuid"), ("i % 17 <> 0 AND i % 12 = 0", "debug_metadata"), ("i % 17 <> 0 AND i % 14 = 0", "evidence_block"), ("i % 11 = 0 AND i % 17 <> 0", "secret_like_text"), ("i % 10 = 0 AND i % 9 <> 0", "insufficient_evidence_not_handled")]


@query(with_sql("docs", then=f""", x AS (SELECT d.doc_id AS i, text, lang, status AS s0 FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN (SELECT document_id, status FROM docs) s ON s.document_id = d.doc_id)
    SELECT i AS case_id, array_to_string({_WHY(*_E5)}, ',') AS failures, CASE WHEN len({_WHY(*_E5)}) > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM x""").replace("SELECT d.doc_id AS i, text,", "SELECT d.doc_id AS i, d.text AS text,"))
def quality_checks(spark, sf_dir):
    """Answers that err by rule, held against fifteen checks."""
    d = corpus.table(spark, sf_dir, "labels").select("doc_id").join(corpus.table(spark, sf_dir, "documents"), "doc_id")
    i, none = F.col("doc_id"), F.array().cast("array<bigint>")
    cases = d.select(i.alias("case_id"), F.array(F.lit("answered"), F.lit("partial")).alias("statuses"), F.array(F.lit("answer_from_materials")).alias("modes"), F.array(F.array("lang")).alias("groups"), F.lit(True).alias("evidence_required"))
    answer = F.concat(F.lit("It is so. "), F.when(i % 11 == 0, "01234567-89ab-cdef-0123-456789abcdef ").otherwise(""), F.when(i % 12 == 0, "chunk_id ").otherwise(""), F.when(i % 14 == 0, "Evidence: x").otherwise(""))
    results = d.select(
        i.alias("case_id"), F.when(i % 17 == 0, "").otherwise(answer).alias("answer"), F.when(i % 7 == 0, "failed").otherwise("answered").alias("status"), F.when(i % 9 == 0, "out_of_base").otherwise("answer_from_materials").alias("answer_mode"), F.array(i).alias("selected"), F.when(i % 10 == 0, none).otherwise(F.array(i)).alias("accepted"),
        F.when(i % 8 == 0, F.array(i, i + 1)).otherwise(F.array(i)).alias("sources"), F.when(i % 10 == 0, "").otherwise(F.col("text")).alias("accepted_text"), F.array(F.lit("label")).alias("labels"),
    )
    out = A.quality_checks(cases, results, corpus.documents(spark, sf_dir).select("document_id", "status"))
    return out.select("case_id", F.array_join("failures", ",").alias("failures"), "outcome")


#: States of a suggestion that an event may lead from and to. Fixed values of the demonstration tables.
ALLOWED = (("pending", "view", "previewed"), ("previewed", "click", "ready"), ("ready", "purchase", "activated"), ("previewed", "purchase", "failed"), ("failed", "view", "previewed"))
_STEP = "CASE s || '|' || a " + " ".join(f"WHEN '{x}|{y}' THEN '{z}'" for x, y, z in ALLOWED) + " ELSE s END"


@query(f"SELECT user_id, list_reduce(list_prepend('pending', list(event_type ORDER BY event_id)), lambda s, a: {_STEP}) AS status FROM events GROUP BY 1")
def suggestion_transitions(spark, sf_dir):
    """Each suggestion's state (here: one a user) after its events, of which only allowed ones take effect."""
    e = corpus.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    return A.transitions(e.select("user_id").distinct().withColumn("status", F.lit("pending")), e, list(ALLOWED), "user_id").select("user_id", "status")


@query(with_sql("docs", then=f""", f AS (SELECT source_name, status, document_id, title, row_number() OVER (PARTITION BY source_name, status ORDER BY document_id) AS r FROM docs WHERE status IN ('active', 'archived') AND len(title) >= 12)
    SELECT CASE status WHEN 'active' THEN 'found' ELSE 'excluded' END || '-' || source_name AS case_id, CASE status WHEN 'active' THEN 'uploaded_material' ELSE 'archived_exclusion' END AS category, 'What is said about ' || {_redact_sql("title")} || '?' AS question, CASE status WHEN 'active' THEN document_id END AS expected, CASE status WHEN 'archived' THEN document_id END AS forbidden FROM f WHERE r = 1"""))
def discover_cases(spark, sf_dir):
    """Evaluation cases that the documents themselves give."""
    return A.discovered_cases(corpus.documents(spark, sf_dir))


@query(with_sql("chunks", then=f""", {_TERMS_CTE}, {_STATS_CTE}, c AS (SELECT row_number() OVER (ORDER BY document_frequency DESC, term) - 1 AS rank, term FROM stats ORDER BY document_frequency DESC, term LIMIT 40), n AS (SELECT unnest(range((SELECT count(*) // 10 FROM documents))) AS id), w AS (SELECT id, unnest(range(12)) AS i FROM n)
    SELECT -id - 1 AS document_id, string_agg(term, ' ' ORDER BY i) AS text FROM w JOIN c ON rank = (id * 7 + i * (1 + id % 3)) % 40 GROUP BY id"""))
def distractor_corpus(spark, sf_dir):
    """One document of the forty most common terms for every ten of the corpus."""
    from pyspark.sql import Window

    stats = terms.term_statistics(corpus.chunks(spark, sf_dir)).orderBy(F.desc("document_frequency"), "term").limit(40)
    common = stats.select((F.row_number().over(Window.orderBy(F.desc("document_frequency"), "term")) - 1).alias("rank"), "term")
    return A.distractors(common, corpus.table(spark, sf_dir, "documents").count() // 10)
