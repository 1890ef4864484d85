"""Answers put together from evidence, and checks of answers that were supplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T

#: What a sentence gains by its shape. Fixed values.
SENTENCE = (
    (0.25, r"(^|[^0-9])[0-9]+[.)][ ]|(^| )[-•] "),
    (0.25, r"`[^`]+`|[A-Za-z0-9_.-]+[.][A-Za-z0-9_.-]+"),
    (0.25, r"(?i)(^|[^a-z0-9_])(python|pip|npm|npx|docker|git|curl|touch|mkdir|cd)([^a-z0-9_]|$)"),
    (0.20, r"(?i)must|use |check |create |add |set |нужно|используйте|проверь|создай|добавь|настрой|укажи"),
    (0.15, r"(?i)example|format|parameter|command|file|condition|result|пример|формат|параметр|команда|файл|условие|результат"),
)
NOISY = ("next lesson", "previous lesson", "subscribe", "следующий урок", "предыдущий урок", "подписаться", "http://", "https://")
#: Marks of a line that names sources. Fixed values.
SOURCE_MARK = r"(?i)(^|[^\p{L}])(sources?|источники?|references?)[ ]*[:：]"
HEDGES = ("maybe", "perhaps", "possibly", "возможно", "вероятно", "не указано")
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
RESIDUE = ("traceback", "lorem ipsum", "todo:", "undefined")
DEBUG = ("chunk_id", "document_id", "evidence_id", "metadata")


def cleaned(sentence: Column) -> Column:
    """Single-spaced, without list and heading marks, cut at 240 characters."""
    x = F.btrim(F.regexp_replace(sentence, "[ \t\n]+", " "), F.lit(" -"))
    x = F.regexp_replace(F.regexp_replace(x, "^#+ *", ""), "^[0-9]+[.)] *", "")
    return F.when(F.length(x) > 240, F.concat(F.rtrim(F.substring(x, 1, 237)), F.lit("..."))).otherwise(x)


def sentences(evidence: DataFrame, question: str = "question_id", most: int = 5) -> DataFrame:
    """(question, rank, sentence): the best sentences of each question's evidence (question, place, content), each first 18 words once.

    Short and noisy ones do not count; a sentence gains by its SENTENCE shapes and by the place of its evidence.
    """
    lines = F.filter(F.transform(F.split("content", "\n"), F.btrim), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])[ \t]+")))
    rows = evidence.select(question, "place", F.explode(F.transform(parts, cleaned)).alias("sentence"))
    low = F.lower("sentence")
    noisy = F.lit(False)
    for mark in NOISY:
        noisy = noisy | F.contains(low, F.lit(mark))
    rows = rows.where((F.length("sentence") >= 18) & ~F.col("sentence").rlike("^[=_ -]+$") & ~noisy)
    gained = sum((F.when(F.col("sentence").rlike(shape), w).otherwise(0.0) for w, shape in SENTENCE), F.lit(0.0)) + F.greatest(F.lit(0.0), 0.12 - (F.col("place") - 1) * 0.02)
    rows = rows.withColumns({"_score": F.round(gained, 4), "_key": F.array_join(F.slice(F.split(low, " "), 1, 18), " ")})
    first = rows.groupBy(question, "_key").agg(F.min(F.struct((-F.col("_score")).alias("s"), "place", "sentence")).alias("m")).select(question, "m.*")
    rank = F.row_number().over(Window.partitionBy(question).orderBy("s", "place", "sentence"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(question, "rank", "sentence")


def extractive_answers(modes: DataFrame, said: DataFrame, question: str = "question_id") -> DataFrame:
    """(question, answer, status) by mode. modes: (question, answer_mode, uncovered, missing); said: rows of sentences()."""
    lists = said.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("_s"))
    rows = modes.join(lists, question, "left")
    bullets = lambda n: F.array_join(F.transform(F.slice(F.coalesce("_s", F.array().cast("array<struct<rank:int,sentence:string>>")), 1, n), lambda x: F.concat(F.lit("\n- "), x["sentence"])), "")
    open_points = F.when(F.size("uncovered") > 0, F.concat(F.lit("\nNothing was found on: "), F.array_join("uncovered", ", "), F.lit("."))).otherwise("")
    lacking = F.when(F.size("missing") > 0, F.col("missing")).otherwise(F.array(F.lit("a passage of the materials that confirms it")))
    answer = (
        F.when((F.col("answer_mode") == "answer_from_materials") & F.col("_s").isNotNull(), F.concat(F.lit("The materials say:"), bullets(5), open_points))
        .when(F.col("answer_mode") == "partial_answer", F.concat(F.lit("The materials tell a part of it:"), bullets(4), open_points))
        .when(F.col("answer_mode").isin("ask_for_missing_data", "answer_from_materials"), F.concat(F.lit("Needed: "), F.array_join(lacking, ", "), F.lit(".")))
        .when(F.col("answer_mode") == "out_of_base", "The materials hold no passage that confirms an answer.")
        .otherwise("")
    )
    status = F.when(F.col("answer_mode") == "answer_from_materials", "answered").when(F.col("answer_mode") == "partial_answer", "partial").when(F.col("answer_mode") == "ask_for_missing_data", "needs_input").when(F.col("answer_mode") == "out_of_base", "not_found").otherwise("general")
    return rows.select(question, answer.alias("answer"), status.alias("status"))


def claims(answer: Column) -> Column:
    """The sentences of an answer that claim something: not hedged, not ended by a colon, three tokens at least."""
    hedged = lambda s: F.exists(F.array(*[F.lit(h) for h in HEDGES]), lambda h: F.contains(F.lower(s), h))
    return F.filter(T.split_sentences(answer), lambda s: ~hedged(s) & ~F.endswith(F.rtrim(s), F.lit(":")) & (T.count_tokens(s) >= 3))


def weak_answers(rows: DataFrame, answer: str = "answer", evidence_roots: str = "roots") -> DataFrame:
    """rows with source_only: answers that only name sources, by their body without source lines and addresses: no words, or few that
    the evidence's roots know."""
    lines = F.filter(F.transform(F.split(answer, "\n"), F.btrim), lambda x: x != "")
    marked = lambda x: x.rlike(SOURCE_MARK) | F.lower(x).startswith("- http")
    body = F.array_join(F.filter(lines, lambda x: ~marked(x)), "\n")
    words = F.array_distinct(F.transform(T.significant_terms(F.regexp_replace(body, "https?://[^ \n]+", " ")), T.root))
    shared, sourceish = F.size(F.array_intersect(words, evidence_roots)), F.col(answer).rlike(SOURCE_MARK) | F.lower(answer).rlike("https?://|docs")
    weak = sourceish & ((F.size(words) == 0) | ((F.size(words) <= 6) & (shared < 2)) | ((F.length(answer) <= 160) & (shared < 2))) | ((F.size(lines) > 0) & F.forall(lines, marked))
    return rows.withColumn("source_only", F.coalesce(weak, F.lit(False)))


def final_status(rows: DataFrame) -> DataFrame:
    """rows (status, supported, claims, leaks) with final_status and show_sources: unsupported claims or leaks take an answer back to
    partial, none supported to not_found; sources are shown where something was answered and nothing leaked."""
    status = F.when(~F.col("status").isin("answered", "partial"), F.col("status")).when((F.col("claims") > 0) & (F.col("supported") == 0), "not_found").when((F.col("supported") < F.col("claims")) | F.col("leaks"), "partial").otherwise(F.col("status"))
    rows = rows.withColumn("final_status", status)
    return rows.withColumn("show_sources", F.col("final_status").isin("answered", "partial") & ~F.col("leaks"))


def quality_checks(cases: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, failures, warnings, outcome). cases: statuses, modes, groups (each of which needs one term in the accepted evidence),
    evidence_required; results: answer, status, answer_mode, selected, accepted (document ids), sources, accepted_text, labels;
    documents: (document_id, status)."""
    listed = results.select("case_id", F.explode(F.array_distinct(F.concat(F.transform("selected", lambda d: F.struct(d.alias("document_id"), F.lit("s").alias("k"))), F.transform("accepted", lambda d: F.struct(d.alias("document_id"), F.lit("a").alias("k")))))).alias("x")).select("case_id", "x.*")
    state = listed.join(documents, "document_id", "left").groupBy("case_id").agg(
        F.count_if((F.col("k") == "s") & (F.coalesce("status", F.lit("")) != "active")).alias("_selected_off"), F.count_if((F.col("k") == "a") & (F.coalesce("status", F.lit("")) != "active")).alias("_accepted_off"), F.count_if(F.col("status") == "archived").alias("_archived")
    )
    r = cases.join(results, "case_id", "left").join(state, "case_id", "left").na.fill(0, ["_selected_off", "_accepted_off", "_archived"])
    text = F.coalesce("answer", F.lit(""))
    one_of = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.lower(text), m))
    met = F.forall("groups", lambda g: F.exists(g, lambda t: F.contains(F.lower(F.coalesce("accepted_text", F.lit(""))), F.lower(t))))
    nothing = F.size(F.coalesce("accepted", F.array().cast("array<bigint>"))) == 0
    failures = (
        (F.btrim(text) == "", "empty_answer"), (~F.array_contains("statuses", F.coalesce("status", F.lit(""))), "status_not_allowed"), ((F.size("modes") > 0) & ~F.array_contains("modes", F.coalesce("answer_mode", F.lit(""))), "mode_not_allowed"), (F.col("_selected_off") > 0, "selected_document_not_active"),
        (F.col("evidence_required") & nothing, "no_accepted_evidence"), (F.col("_accepted_off") > 0, "accepted_evidence_not_active"), (F.size(F.array_except("sources", "accepted")) > 0, "source_not_from_evidence"), (F.col("_archived") > 0, "archived_document"), (~met & ~nothing, "required_terms_missing"),
        (text.rlike(UUID), "raw_uuid"), (one_of(DEBUG), "debug_metadata"), (F.contains(text, F.lit("Evidence:")), "evidence_block"), (T.contains_secret(F.concat_ws("\n", text, F.array_join("labels", "\n"))), "secret_like_text"), (one_of(RESIDUE), "residue"),
        (nothing & ~F.coalesce("answer_mode", F.lit("")).isin("out_of_base", "ask_for_missing_data", "general_answer_without_sources"), "insufficient_evidence_not_handled"),
    )
    f = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in failures]))
    w = F.array_compact(F.array(F.when(F.size(F.coalesce("sources", F.array().cast("array<bigint>"))) > 3, "many_sources"), F.when(F.length(text) > 2000, "long_answer")))
    return r.select("case_id", f.alias("failures"), w.alias("warnings"), F.when(F.col("answer").isNull(), "NOT_RUN").when(F.size(f) > 0, "FAIL").when(F.size(w) > 0, "WARN").otherwise("PASS").alias("outcome"))


def transitions(states: DataFrame, events: DataFrame, allowed: list[tuple[str, str, str]], key: str) -> DataFrame:
    """(key, status, applied, refused): states (key, status) after their events (key, seq, action), each carried out only where `allowed`
    (from, action, to) has it. The fold runs over one key's events in order of seq."""
    table = F.create_map(*[F.lit(x) for a, b, c in allowed for x in (f"{a}|{b}", c)])
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("_e"))
    rows = states.join(ordered, key, "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<seq:bigint,action:string>>")))
    start = F.struct(F.col("status").alias("s"), F.lit(0).alias("a"), F.lit(0).alias("r"))
    to = lambda acc, e: F.element_at(table, F.concat_ws("|", acc["s"], e["action"]))
    done = F.aggregate("_e", start, lambda acc, e: F.struct(F.coalesce(to(acc, e), acc["s"]).alias("s"), (acc["a"] + to(acc, e).isNotNull().cast("int")).alias("a"), (acc["r"] + to(acc, e).isNull().cast("int")).alias("r")))
    return rows.withColumn("_d", done).select(key, F.col("_d.s").alias("status"), F.col("_d.a").alias("applied"), F.col("_d.r").alias("refused"))


def discovered_cases(docs: DataFrame) -> DataFrame:
    """(case_id, category, question, expected, forbidden) from documents (document_id, source_name, title, status): of each source its first
    active one is to be found, and its first archived one is not."""
    first = docs.where("status in ('active', 'archived') and length(title) >= 12").groupBy("source_name", "status").agg(F.min(F.struct("document_id", "title")).alias("d"))
    active = F.col("status") == "active"
    return first.select(F.concat_ws("-", F.when(active, "found").otherwise("excluded"), "source_name").alias("case_id"), F.when(active, "uploaded_material").otherwise("archived_exclusion").alias("category"), F.concat(F.lit("What is said about "), T.redact(F.col("d.title")), F.lit("?")).alias("question"), F.when(active, F.col("d.document_id")).alias("expected"), F.when(~active, F.col("d.document_id")).alias("forbidden"))


def distractors(common: DataFrame, n: int, words: int = 12) -> DataFrame:
    """(document_id, text): n documents of common terms (rank, term, from 0), each of so many in a turn of its own; ids are negative."""
    size = common.count()
    ids = common.sparkSession.range(n).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("i")).withColumn("rank", ((F.col("id") * 7 + F.col("i") * (1 + F.col("id") % 3)) % max(size, 1)).cast("int"))
    rows = ids.join(F.broadcast(common) if size <= 100_000 else common, "rank").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), " ").alias("text"))
    return rows.select((-F.col("id") - 1).alias("document_id"), "text")
