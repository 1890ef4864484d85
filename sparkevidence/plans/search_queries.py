"""Queries of search over whole tables: trigram similarity, cover density, and both merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import search
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql

_KEY = ["document_id", "chunk_index"]
_TOKENS = f"regexp_extract_all(lower(x), '{T.TOKEN}')"
_GRAMS = f"list_distinct(flatten(list_transform(list_distinct({_TOKENS}), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_TRIGRAM_CTE = f"""qg0 AS (SELECT question_id, {_GRAMS.replace("(x)", "(question)")} AS g FROM questions), qg AS (SELECT question_id, len(g) AS qn, unnest(g) AS g FROM qg0),
    side AS (SELECT document_id, chunk_index, content AS x, 'c' AS side FROM chunks UNION ALL SELECT document_id, chunk_index, heading, 'h' FROM chunks),
    cg0 AS (SELECT document_id, chunk_index, side, {_GRAMS} AS g FROM side), cg AS (SELECT document_id, chunk_index, side, len(g) AS cn, unnest(g) AS g FROM cg0),
    shared AS (SELECT question_id, document_id, chunk_index, side, count(*) AS n, any_value(qn) AS qn, any_value(cn) AS cn FROM qg JOIN cg USING (g) GROUP BY 1, 2, 3, 4),
    tri AS (SELECT question_id, document_id, chunk_index, max(round(n / (qn + cn - n), 6)) AS trigram FROM shared WHERE n >= 0.3::DOUBLE * (qn + cn - n) - 1e-9 GROUP BY 1, 2, 3)"""


def _cover_cte(rows: str, keys: str) -> str:
    """rows: a table of (keys, x). For every hit, the latest place of each asked token so far; a cover ends where the least of these moves on."""
    return f"""qt AS (SELECT question_id, unnest(list_distinct({_TOKENS.replace("(x)", "(question)")})) AS token FROM questions), qk AS (SELECT question_id, count(*) AS k FROM qt GROUP BY 1),
    tk AS (SELECT {keys}, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM {rows}),
    hit AS (SELECT question_id, {keys}, token, pos FROM tk JOIN qt USING (token)),
    all_of AS (SELECT question_id, {keys}, any_value(k) AS k FROM hit JOIN qk USING (question_id) GROUP BY question_id, {keys} HAVING count(DISTINCT token) = any_value(k)),
    h AS (SELECT hit.*, row_number() OVER (PARTITION BY question_id, {keys} ORDER BY pos) AS i FROM hit JOIN all_of USING (question_id, {keys})),
    seen AS (SELECT h.question_id, {keys.replace("document_id", "h.document_id").replace("chunk_index", "h.chunk_index")}, h.pos, h.i, t.token, max(CASE WHEN h.token = t.token THEN h.pos END) OVER (PARTITION BY h.question_id, {keys.replace("document_id", "h.document_id").replace("chunk_index", "h.chunk_index")}, t.token ORDER BY h.pos) AS last FROM h JOIN qt t ON t.question_id = h.question_id),
    low AS (SELECT question_id, {keys}, pos, any_value(i) AS i, CASE WHEN count(last) = count(*) THEN min(last) END AS low FROM seen GROUP BY question_id, {keys}, pos),
    ends AS (SELECT *, lag(low) OVER (PARTITION BY question_id, {keys} ORDER BY pos) AS before FROM low),
    cover AS (SELECT question_id, {keys}, pos - low + 1 - (e.i - s.i + 1) AS gaps FROM ends e JOIN (SELECT question_id, {keys}, pos AS low, i FROM h) s USING (question_id, {keys}, low) WHERE low IS NOT NULL AND (before IS NULL OR low > before)),
    density AS (SELECT question_id, {keys}, count(*) AS covers, round(sum(0.1::DOUBLE / (1 + gaps)), 6) AS score FROM cover GROUP BY question_id, {keys})"""


@query(with_sql("chunks", "questions", then=f", {_TRIGRAM_CTE} SELECT * FROM tri"))
def trigram_candidates(spark, sf_dir):
    """All pairs of a question and a chunk of the whole table that are alike by trigrams of content or heading."""
    return search.trigram_candidates(corpus.questions(spark, sf_dir), corpus.chunks(spark, sf_dir), "question_id", _KEY, "question", "content", "heading")


def _short_questions(spark, sf_dir):
    """Questions as people type them: the benchmark's texts cut to three words from their fifth on."""
    words = F.slice(T.tokens(F.col("question")), 5, 3)
    return corpus.questions(spark, sf_dir).select("question_id", F.array_join(words, " ").alias("question"))


_SHORT = f"long AS (SELECT item_id AS question_id, text AS x FROM benchmark), questions AS (SELECT question_id, array_to_string({_TOKENS}[5:7], ' ') AS question FROM long)"


@query(f"WITH {_SHORT}, docs AS (SELECT doc_id AS document_id, text AS x FROM documents), {_cover_cte('docs', 'document_id')} SELECT * FROM density")
def cover_density(spark, sf_dir):
    """Documents that hold all tokens of a short question, by how densely they stand together."""
    d = corpus.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    return search.cover_density(_short_questions(spark, sf_dir), d, "question_id", ["document_id"], "question", "text")


@query(with_sql("chunks", then=f", {_SHORT}, cx AS (SELECT document_id, chunk_index, content AS x FROM chunks), {_TRIGRAM_CTE}, {_cover_cte('cx', 'document_id, chunk_index')}, joined AS (SELECT question_id, document_id, chunk_index, coalesce(score, 0) AS text_score, coalesce(trigram, 0) AS trigram, greatest(coalesce(score, 0), coalesce(trigram, 0)) AS score FROM density FULL JOIN tri USING (question_id, document_id, chunk_index)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, text_score DESC, trigram DESC, document_id, chunk_index) AS rank FROM joined) WHERE rank <= 20"))
def search_chunks(spark, sf_dir):
    """The 20 best chunks of each short question over the whole table, by cover density and trigrams (a top-k report)."""
    q, c = _short_questions(spark, sf_dir), corpus.chunks(spark, sf_dir)
    text = search.cover_density(q, c, "question_id", _KEY, "question", "content")
    trigram = search.trigram_candidates(q, c, "question_id", _KEY, "question", "content", "heading")
    return search.merged_candidates(text, trigram, "question_id", _KEY)
