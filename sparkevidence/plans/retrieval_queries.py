"""Queries from questions to evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import retrieval as R
from sparkevidence.operators import terms
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.plans.corpus_queries import _SIGNIFICANT, _STATS_CTE, _STOP, _TERMS_CTE, _WEIGHTS_CTE, weighted_terms
from sparkevidence.sources.cuts import cut

_CUT = "CASE WHEN len(t) >= 8 THEN substring(t, 1, 7) WHEN len(t) >= 6 THEN substring(t, 1, 5) ELSE t END"


def _roots_sql(column: str) -> str:
    return f"list_distinct(list_transform({_SIGNIFICANT.replace('content', column)}, lambda t: {_CUT}))"


_MATCH_CTE = f"""root_weights AS (SELECT {_CUT.replace("(t", "(term").replace("ELSE t ", "ELSE term ")} AS root, max(weight) AS weight FROM weights GROUP BY 1),
    qr AS (SELECT question_id, unnest({_roots_sql("question")}) AS root FROM questions), dr AS (SELECT doc_id AS document_id, unnest({_roots_sql("text")}) AS root FROM documents),
    asked AS (SELECT qr.*, coalesce(weight, {R.UNSEEN}) AS weight FROM qr LEFT JOIN root_weights USING (root)), total AS (SELECT question_id, sum(weight) AS total FROM asked GROUP BY 1),
    matches AS (SELECT question_id, document_id, count(*) AS matched, round(sum(weight) / any_value(total), 6) AS score FROM asked JOIN dr USING (root) JOIN total USING (question_id) GROUP BY 1, 2),
    top_docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS rank FROM matches WHERE score >= 0.12) WHERE rank <= 5)"""


def _match_sql(then: str) -> str:
    return with_sql("chunks", "questions", then=f", {_TERMS_CTE}, {_STATS_CTE}, {_WEIGHTS_CTE}, {_MATCH_CTE} {then}")


def _root_weights(spark, sf_dir, asked):
    roots = R.small(cut(asked.select("root").distinct(), "roots"))
    return weighted_terms(spark, sf_dir, roots).groupBy(T.root(F.col("term")).alias("root")).agg(F.max("weight").alias("weight"))


def asked_weights(spark, sf_dir):
    """(question_id, root, weight) of all questions."""
    asked = R.roots(corpus.questions(spark, sf_dir), "question_id", "question")
    return cut(R.weighted(asked, _root_weights(spark, sf_dir, asked)), "asked")


def _matches(spark, sf_dir, weights=None):
    """weights: asked_weights of all questions where they are known, so that the corpus is not counted again."""
    asked = R.roots(corpus.questions(spark, sf_dir), "question_id", "question")
    w = _root_weights(spark, sf_dir, asked) if weights is None else weights.select("root", "weight").distinct()
    d = corpus.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    return R.document_matches(asked, R.roots(d, "document_id", "text"), w)


@query(_match_sql("SELECT question_id, document_id, matched, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS rank FROM matches) WHERE rank <= 50"))
def weighted_match_ratio(spark, sf_dir):
    """The 50 documents of each question with the greatest weighted share of its stems (a top-k report)."""
    return R.top_per(_matches(spark, sf_dir), "question_id", "score", "document_id", 50)


@query(_match_sql("SELECT * FROM top_docs"))
def top_documents(spark, sf_dir, weights=None):
    """The five best documents of each question."""
    return R.top_per(_matches(spark, sf_dir, weights), "question_id", "score", "document_id", 5, 0.12)


_CHUNK_CTE = f"""cr AS (SELECT document_id, chunk_index, content, {_roots_sql("content")} AS roots FROM chunks), ql AS (SELECT question_id, question, {_roots_sql("question")} AS roots FROM questions),
    scored AS (SELECT question_id, document_id, chunk_index, content, question, t.score AS document_score, round(len(list_intersect(cr.roots, ql.roots)) / greatest(len(ql.roots), 1), 6) AS overlap, cr.roots FROM top_docs t JOIN cr USING (document_id) JOIN ql USING (question_id)),
    evidence AS (SELECT *, CASE WHEN overlap = 0 THEN 'no shared terms' WHEN overlap < 0.18 THEN 'below minimum score' WHEN len(content) < 20 THEN 'too short' END AS discarded FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, document_id, chunk_index) AS rank FROM evidence WHERE discarded IS NULL)"""


def _scored_chunks(spark, sf_dir):
    top = cut(top_documents(spark, sf_dir).select("question_id", "document_id", F.col("score").alias("document_score")), "routed")
    stems = lambda c: F.array_distinct(F.transform(T.significant_terms(F.col(c)), T.root))
    q = corpus.questions(spark, sf_dir).withColumn("q_roots", stems("question"))
    c = corpus.chunks(spark, sf_dir, R.small(top.select("document_id").distinct())).join(top, "document_id").withColumn("roots", stems("content")).join(q, "question_id")
    overlap = F.round(F.size(F.array_intersect("roots", "q_roots")) / F.greatest(F.size("q_roots"), F.lit(1)), 6)
    c = c.withColumn("overlap", overlap)
    discarded = F.when(F.col("overlap") == 0, "no shared terms").when(F.col("overlap") < 0.18, "below minimum score").when(F.length("content") < 20, "too short")
    return c.withColumn("discarded", discarded)


def _ranked_chunks(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("overlap"), "document_id", "chunk_index"))
    return _scored_chunks(spark, sf_dir).where("discarded is null").withColumn("rank", rank)


@query(_match_sql(f", {_CHUNK_CTE} SELECT question_id, document_id, chunk_index, overlap, rank FROM ranked WHERE rank <= 8"))
def top_chunks(spark, sf_dir):
    return _ranked_chunks(spark, sf_dir).where("rank <= 8").select("question_id", "document_id", "chunk_index", "overlap", "rank")


@query(_match_sql(f""", {_CHUNK_CTE}, tri AS (SELECT *, list_distinct(list_transform(range(1, len(question) + 2), lambda i: substring('  ' || lower(question) || ' ', i, 3))) AS a,
    list_distinct(list_transform(range(1, len(content) + 2), lambda i: substring('  ' || lower(content) || ' ', i, 3))) AS b FROM ranked WHERE rank <= 8)
    SELECT question_id, document_id, chunk_index, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS trigram,
    round(document_score * 0.6::DOUBLE + overlap * 0.3::DOUBLE + round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) * 0.1::DOUBLE, 4) AS hybrid FROM tri"""))
def hybrid_score(spark, sf_dir):
    """Trigram similarity and the weighted sum of the three scores, for the chunks of first rank."""
    c = _ranked_chunks(spark, sf_dir).where("rank <= 8").withColumn("trigram", F.round(R.trigram_similarity(F.col("question"), F.col("content")), 6))
    return c.select("question_id", "document_id", "chunk_index", "trigram", F.round(R.hybrid(F.col("document_score"), F.col("overlap"), F.col("trigram")), 4).alias("hybrid"))





@query()
def near_duplicate_evidence(spark, sf_dir):
    """Accepted chunks without those that repeat an earlier one; a test holds the fold against a loop."""
    e = _ranked_chunks(spark, sf_dir).where("rank <= 8").withColumn("id", F.concat_ws("/", "document_id", "chunk_index"))
    return R.without_redundant(e, "question_id")


@query(_match_sql(f", {_CHUNK_CTE} SELECT question_id, document_id, count(*) AS chunks, min(rank) AS first_rank FROM ranked WHERE rank <= 8 GROUP BY ALL"))
def evidence_per_document(spark, sf_dir):
    return top_chunks(spark, sf_dir).groupBy("question_id", "document_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("rank").alias("first_rank"))


_TOK = f"regexp_extract_all(lower(text), '{T.TOKEN}')"


@query(with_sql("questions", then=f""", dt AS (SELECT doc_id AS document_id, len({_TOK}) AS n, unnest(list_distinct({_TOK})) AS token FROM documents), qt AS (SELECT question_id, unnest(list_distinct({_TOK.replace("text", "question")})) AS token FROM questions),
    qn AS (SELECT question_id, count(*) AS k FROM qt GROUP BY 1) SELECT question_id, document_id, round(any_value(k) / (1 + ln(1 + any_value(n))), 6) AS score FROM qt JOIN dt USING (token) JOIN qn USING (question_id) GROUP BY 1, 2 HAVING count(*) = any_value(k)"""))
def fulltext_score(spark, sf_dir):
    """Documents that hold every token of a question; more tokens and shorter documents score higher."""
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), T.tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    q = corpus.questions(spark, sf_dir).select("question_id", T.tokens(F.col("question")).alias("tokens"))
    return R.holds_all(q, d).select("question_id", "document_id", F.round(F.col("k") / (1 + F.ln(1 + F.col("n"))), 6).alias("score"))


@query(f"""WITH r AS (SELECT doc_id, unnest(list_transform({_SIGNIFICANT.replace("content", "text")}, lambda t: {_CUT})) AS root FROM documents),
    c AS (SELECT doc_id, ('0x' || substring(sha256(root), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM r GROUP BY ALL) SELECT doc_id, slot, round(n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def hash_embedding(spark, sf_dir):
    return R.hash_embedding(corpus.table(spark, sf_dir, "documents"), "doc_id", "text")


def _vectors(spark, sf_dir):
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of every fiftieth, exactly."""
    v, q = _vectors(spark, sf_dir)
    return R.cosine_topk(v, q, 10, v.count(), q.count())


@query()
def ann_topk(spark, sf_dir):
    """The same by hashing; a test holds its recall against the exact search."""
    v, q = _vectors(spark, sf_dir)
    return R.ann_topk(v, q, 10)


#: Names by which texts mention the services of the demonstration tables. Fixed values.
SERVICES = (("gpl", "gnu general public license"), ("gpl", "public license"), ("apache", "apache license"), ("apache", "licensed under the apache license"), ("mit", "mit license"), ("cc", "cc by"), ("rights", "all rights reserved"), ("article", "the on"), ("article", "of the"))


def _services(spark):
    return spark.createDataFrame(list(SERVICES), "service_id string, alias string")


_SERVICES_SQL = "services AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{a}')" for s, a in SERVICES) + ") v(service_id, alias))"
_MENTION_CTE = f"""{_SERVICES_SQL}, w AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS t FROM documents), hits AS (SELECT doc_id, service_id, alias, len(string_split(substring(t, 1, strpos(t, ' ' || alias || ' ')), ' ')) - 2 AS word_at,
    CASE WHEN len(alias) >= 8 THEN 0.98 WHEN len(alias) >= 4 THEN 0.95 ELSE 0.90 END::DOUBLE AS confidence FROM w, services WHERE contains(t, ' ' || alias || ' ')),
    mentions AS (SELECT doc_id, service_id, alias, word_at, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, service_id ORDER BY confidence DESC, len(alias) DESC, word_at) AS r FROM hits) WHERE r = 1)"""


def _mentions(spark, sf_dir):
    return R.mentions(corpus.table(spark, sf_dir, "documents"), "doc_id", "text", _services(spark))


@query(f"WITH {_MENTION_CTE} SELECT doc_id, service_id, alias, greatest(word_at, 0) AS word_at, confidence FROM mentions")
def best_mention_per_service(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query(f"WITH {_MENTION_CTE} SELECT service_id, count(*) AS documents FROM mentions GROUP BY 1")
def service_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("service_id").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {_MENTION_CTE} SELECT source, service_id, count(*) AS n FROM mentions JOIN documents USING (doc_id) GROUP BY ALL")
def service_tag_counts(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "source")
    return _mentions(spark, sf_dir).join(d, "doc_id").groupBy("source", "service_id").agg(F.count(F.lit(1)).alias("n"))


_CLAIM = f"list_distinct(list_transform({_SIGNIFICANT.replace('content', 'X')}, lambda t: substring(t, 1, 7)))"


@query(f"""WITH s AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(x) > 0) AS ss FROM conversations WHERE role = 'assistant'),
    c AS (SELECT conv_id, turn * 10000 + unnest(range(len(ss))) AS claim_no, {_CLAIM.replace("X", "unnest(ss)")} AS c FROM s), e AS (SELECT conv_id, {_CLAIM.replace("X", "text")} AS s FROM conversations WHERE role = 'user'),
    m AS (SELECT c.conv_id, claim_no, max(coalesce(len(list_intersect(c, s)), 0)) AS best, max(len(c)) AS n FROM c LEFT JOIN e USING (conv_id) GROUP BY 1, 2)
    SELECT conv_id, claim_no, best, n > 0 AND (best >= least(3, n) OR best >= 0.55 * n) AS supported FROM m""")
def verify_claims(spark, sf_dir):
    """Sentences of assistant turns against the user turns of their conversation."""
    t = corpus.table(spark, sf_dir, "conversations")
    claims = t.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "claim")).select("conv_id", (F.col("turn") * 10000 + F.col("i")).alias("claim_no"), "claim")
    # a turn that repeats in a conversation gives the same claim number twice; the best of both counts
    return R.verify_claims(claims, t.where("role = 'user'").select("conv_id", F.col("text").alias("span")), "conv_id")


_MERGE = with_sql("questions", then=f""", dt AS (SELECT doc_id, list_distinct({_TOK}) AS t, {_roots_sql("text")} AS r FROM documents), qt AS (SELECT question_id, list_distinct({_TOK.replace("text", "question")}) AS t, {_roots_sql("question")} AS r FROM questions),
    f AS (SELECT question_id, doc_id, 1.0::DOUBLE AS fulltext FROM qt, dt WHERE len(list_intersect(qt.t, dt.t)) = len(qt.t)), x AS (SELECT question_id, doc_id, round(len(list_intersect(qt.r, dt.r)) / greatest(len(qt.r), 1), 6) AS lexical FROM qt, dt WHERE len(list_intersect(qt.r, dt.r)) > 0)
    SELECT question_id, doc_id AS document_id, fulltext, lexical, greatest(coalesce(fulltext, 0), coalesce(lexical, 0)) AS best FROM f FULL JOIN x USING (question_id, doc_id) WHERE coalesce(lexical, 1) >= 0.3""")


@query(_MERGE)
def merge_candidates(spark, sf_dir):
    """Full-text and lexical candidates as one row for each pair, with each side's score."""
    d = corpus.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    q = corpus.questions(spark, sf_dir)
    full = fulltext_score(spark, sf_dir).select("question_id", "document_id", F.lit(1.0).alias("fulltext"), F.lit(None).cast("double").alias("lexical"))
    qr = R.roots(q, "question_id", "question")
    total = qr.groupBy("question_id").agg(F.count(F.lit(1)).alias("k"))
    lexical = R.roots(d, "document_id", "text").join(R.small(qr), "root").groupBy("question_id", "document_id").agg(F.count(F.lit(1)).alias("c")).join(total, "question_id")
    lexical = lexical.select("question_id", "document_id", F.lit(None).cast("double").alias("fulltext"), F.round(F.col("c") / F.col("k"), 6).alias("lexical")).where("lexical >= 0.3")
    both = full.unionByName(lexical).groupBy("question_id", "document_id").agg(F.max("fulltext").alias("fulltext"), F.max("lexical").alias("lexical"))
    return both.withColumn("best", F.greatest(F.coalesce("fulltext", F.lit(0.0)), F.coalesce("lexical", F.lit(0.0))))
