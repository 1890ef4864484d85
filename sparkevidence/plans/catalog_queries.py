"""Queries of catalogs, enrichment, metadata and reviewed plans. What the given tables lack is derived by formula, alike in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import catalog as C
from sparkevidence.operators import lifecycle
from sparkevidence.operators import questions as Q
from sparkevidence.operators import retrieval as R
from sparkevidence.operators import reviews as V
from sparkevidence.operators import terms
from sparkevidence.plans import corpus, governance_queries, ingest_queries, retrieval_queries
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.plans.corpus_queries import _SIGNIFICANT, _STATS_CTE, _TERMS_CTE
from sparkevidence.plans.evidence_queries import _analysis_sql, _any
from sparkevidence.plans.ingest_queries import _SNAPSHOTS
from sparkevidence.plans.retrieval_queries import _match_sql
from sparkevidence.sources.cuts import cut

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_ID = lambda x: f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), '_(docs|documentation)$', '')"
_GLOSS = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[\\p{{Pd}}\\x{{2212}}]+', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'))"
_WHY = lambda *rules: "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for c, n in rules) + "], lambda x: x IS NOT NULL)"


def _services(spark, sf_dir):
    """A service for each host of a page; risk by scheme."""
    p = corpus.table(spark, sf_dir, "pages")
    return p.select(T.normalize_service_id(F.substring_index(T.url_domain(F.col("url")), ".", -2)).alias("service_id"), T.url_domain(F.col("url")).alias("domain"), F.when(F.col("url").startswith("https:"), "low").when(F.col("url").startswith("http:"), "plain").otherwise("none").alias("risk"))


_SERVICES = f"services AS (SELECT {_ID(f'''array_to_string(string_split({_HOST}, '.')[-2:], '.')''')} AS service_id, {_HOST} AS domain, CASE WHEN starts_with(url, 'https:') THEN 'low' WHEN starts_with(url, 'http:') THEN 'plain' ELSE 'none' END AS risk FROM pages)"


@query(f"""WITH {_SERVICES}, g AS (SELECT service_id, count(*) AS n, max((NOT regexp_matches(domain, '^[a-z0-9-]+([.][a-z0-9-]+)+$') OR regexp_matches(domain, '^[0-9.]+$'))::INT) AS d, max((risk NOT IN ('low', 'medium', 'high'))::INT) AS r FROM services GROUP BY 1)
    SELECT service_id, unnest({_WHY(("n > 1", "duplicate_id"), ("d = 1", "bad_domain"), ("r = 1", "bad_risk"))}) AS issue FROM g""")
def catalog_tables(spark, sf_dir):
    """What is wrong with a catalog of services."""
    return C.catalog_issues(_services(spark, sf_dir))


def _catalog_parts(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    registry = _services(spark, sf_dir).groupBy("service_id").agg(F.min("domain").alias("domain")).withColumn("name", F.lit(None).cast("string"))
    by_source = d.groupBy(T.normalize_service_id(F.col("source")).alias("service_id")).agg(F.min("lang").alias("name"), F.min(F.lit(None).cast("string")).alias("domain"))
    by_lang = d.groupBy(T.normalize_service_id(F.col("source")).alias("service_id")).agg(F.max("lang").alias("name"), F.max(F.concat("source", F.lit(".example.org"))).alias("domain"))
    return [registry, by_source, by_lang]


@query(f"""WITH {_SERVICES}, parts AS (SELECT 0 AS p, service_id, min(domain) AS domain, NULL::VARCHAR AS name FROM services GROUP BY 2 UNION ALL SELECT 1, {_ID("source")}, NULL, min(lang) FROM documents GROUP BY 2 UNION ALL SELECT 2, {_ID("source")}, max(source || '.example.org'), max(lang) FROM documents GROUP BY 2)
    SELECT service_id, arg_min(domain, p) FILTER (WHERE domain IS NOT NULL) AS domain, arg_min(name, p) FILTER (WHERE name IS NOT NULL) AS name, count(DISTINCT p) AS catalogs FROM parts GROUP BY 1""")
def merge_catalogs(spark, sf_dir):
    """Three catalogs as one, earlier ones first."""
    return C.merge_catalogs(_catalog_parts(spark, sf_dir))


def _glossary(spark, sf_dir):
    """Aliases: a source's short first words; rules: words that follow them, of every fiftieth document."""
    d = corpus.table(spark, sf_dir, "documents").where("doc_id % 50 < 20").select("doc_id", "source", F.filter(F.split(C.glossary_text(F.col("text")), "[^\\p{L}\\p{N}_]+"), lambda x: x != "").alias("w"))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("zz"))
    aliases = d.select(F.col("source").alias("service_id"), word(1).alias("phrase")).distinct()
    kind = F.when(F.col("doc_id") % 3 == 0, "exact").when(F.col("doc_id") % 3 == 1, "config").otherwise("anchor")
    rules = d.select(F.col("source").alias("service_id"), F.col("doc_id").cast("string").alias("rule_id"), F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), word(2).alias("phrase")), F.struct(F.lit(2).alias("ordinal"), F.concat_ws(" ", word(3), word(4)).alias("phrase")))).alias("p"), kind.alias("kind"), F.concat_ws("_", word(2), word(3)).alias("term"))
    return aliases, rules.select("service_id", "rule_id", "p.ordinal", "p.phrase", "kind", "term")


_ENRICH = f"""g0 AS (SELECT doc_id, source, list_filter(string_split_regex({_GLOSS("text")}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 50 < 20), g AS (SELECT doc_id, source, coalesce(w[2], 'zz') AS w1, coalesce(w[3], 'zz') AS w2, coalesce(w[4], 'zz') AS w3, coalesce(w[5], 'zz') AS w4 FROM g0),
    al AS (SELECT DISTINCT source AS service_id, w1 AS phrase FROM g), ru AS (SELECT source AS service_id, doc_id::VARCHAR AS rule_id, unnest([w2, w3 || ' ' || w4]) AS phrase, CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'config' ELSE 'anchor' END AS kind, w2 || '_' || w3 AS term FROM g),
    qt AS (SELECT question_id, ' ' || array_to_string(list_filter(string_split_regex({_GLOSS("question")}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM questions), named AS (SELECT DISTINCT question_id, service_id FROM qt JOIN al ON contains(t, ' ' || phrase || ' ')),
    hits AS (SELECT DISTINCT question_id, service_id, rule_id, kind, term FROM qt JOIN ru ON contains(t, ' ' || phrase || ' ') JOIN named USING (question_id, service_id)),
    enriched AS (SELECT question_id, list_sort(list(DISTINCT service_id)) AS services, coalesce(list_sort(list(DISTINCT term) FILTER (WHERE kind = 'exact')), []) AS exact_terms, coalesce(list_sort(list(DISTINCT term) FILTER (WHERE kind = 'config')), []) AS config_terms, coalesce(list_sort(list(DISTINCT term) FILTER (WHERE kind = 'anchor')), []) AS anchors FROM hits GROUP BY 1)"""
_LISTS = ("services", "exact_terms", "config_terms", "anchors")


@query(with_sql("questions", then=f", {_ENRICH} SELECT question_id, {', '.join(f'''array_to_string({c}, ',') AS {c}''' for c in _LISTS)} FROM enriched"))
def enrich_questions(spark, sf_dir):
    """Services that questions name and the terms that a glossary adds for them."""
    out = C.enrich_questions(corpus.questions(spark, sf_dir), *_glossary(spark, sf_dir))
    return out.select("question_id", *[F.array_join(c, ",").alias(c) for c in _LISTS])


@query(with_sql("questions", then=f""", {_ENRICH}, {_analysis_sql("a", "questions")}, s0 AS (SELECT question_id, question, config_terms[1:8] AS cf, list_concat(anchors, exact_terms) AS p0, list_filter(list_concat([action, attribute], objects[1:4]), lambda x: x <> '') AS b0 FROM enriched JOIN a USING (question_id)),
    s1 AS (SELECT *, (list_filter(p0, lambda x, i: list_position(p0, x) = i))[1:8] AS p, (list_filter(b0, lambda x, i: list_position(b0, x) = i))[1:6] AS b FROM s0), s2 AS (SELECT *, list_concat(p, cf) AS x1, list_concat(list_concat(p, b), cf) AS x2 FROM s1 WHERE len(p) > 0),
    s3 AS (SELECT question_id, question, [array_to_string((list_filter(x1, lambda x, i: list_position(x1, x) = i))[1:12], ' '), array_to_string((list_filter(x2, lambda x, i: list_position(x2, x) = i))[1:14], ' ')] AS v FROM s2), s4 AS (SELECT question_id, list_filter(list_filter(v, lambda x, i: list_position(v, x) = i), lambda x: x <> '' AND {_GLOSS("x")} <> {_GLOSS("question")}) AS v FROM s3)
    SELECT question_id, unnest(range(len(v))) AS variant, unnest(v) AS query FROM s4"""))
def service_scoped_queries(spark, sf_dir):
    """Up to two searches for each question that names a service."""
    q = corpus.questions(spark, sf_dir)
    return C.scoped_queries(C.enrich_questions(q, *_glossary(spark, sf_dir)), Q.analyze(q))


@query(f"SELECT doc_id, md5({_GLOSS('text')}) AS normal_md5 FROM documents")
def normalize_glossary_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.md5(C.glossary_text(F.col("text"))).alias("normal_md5"))


_EXPECTED_TERMS = ("mit license", "cc-by", "apache license", "the", "v1.0")


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[\\p{{Pd}}\\x{{2212}}]', '-', 'g'), '[ \\t\\n]+', ' ', 'g')) AS x FROM documents), w AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _EXPECTED_TERMS)}) v(term))
    SELECT doc_id, term FROM t, w WHERE regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_-])' || regexp_replace(term, '([^a-z0-9 ])', '\\\\\\1', 'g') || '($|[^\\p{{L}}\\p{{N}}_-])')""")
def expectation_term_matches(spark, sf_dir):
    """Which of some expected terms stand in each document as words of their own."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(x) for x in _EXPECTED_TERMS])).alias("term"))
    return d.where(C.expectation_matches(F.col("term"), F.col("text"))).select("doc_id", "term")


@query(f"SELECT page_id, coalesce(nullif({_ID('declared')}, ''), {_ID('source')}) AS service_id FROM (SELECT page_id, split_part({_HOST}, '.', 1) || CASE WHEN page_id % 2 = 0 THEN '_docs' ELSE '' END AS source, CASE WHEN page_id % 3 = 0 THEN {_HOST} || ' Documentation' END AS declared FROM pages)")
def service_source(spark, sf_dir):
    """The service of each page's source, declared or by its name."""
    host = T.url_domain(F.col("url"))
    source = F.concat(F.substring_index(host, ".", 1), F.when(F.col("page_id") % 2 == 0, "_docs").otherwise(""))
    return corpus.table(spark, sf_dir, "pages").select("page_id", C.service_of(source, F.when(F.col("page_id") % 3 == 0, F.concat(host, F.lit(" Documentation")))).alias("service_id"))


@query("SELECT doc_id, lang FROM documents WHERE source = 'src1' AND lang = 'en'")
def scope(spark, sf_dir):
    """Documents of one workspace (here: source) and course."""
    d = corpus.table(spark, sf_dir, "documents").withColumn("course", F.col("lang"))
    return C.scope(d, "src1", "en", by="source").select("doc_id", "lang")


@query(r"""WITH s AS (SELECT doc_id, list_concat(""" + ", list_concat(".join(f"list_transform(regexp_extract_all(text, '{s}'), lambda t: {{'term': t, 'class': '{k}'}})" for k, s in C.ANCHOR_SHAPES) + ", list_transform((list_filter(regexp_extract_all(text, '" + T.EXACT.replace("++", "+") + "'), lambda x, i: list_position(regexp_extract_all(text, '" + T.EXACT.replace("++", "+") + "'), x) = i))[1:12], lambda t: {'term': t, 'class': 'exact'})" + ")" * len(C.ANCHOR_SHAPES) + r""" AS f FROM documents),
    n AS (SELECT doc_id, f, list_transform(f, lambda x: x.term) AS names FROM s), k AS (SELECT doc_id, unnest((list_filter(f, lambda x, i: list_position(names, x.term) = i))[1:30]) AS a FROM n) SELECT doc_id, a.term AS term, a.class AS class FROM k""")
def extract_anchor_terms(spark, sf_dir):
    """Shaped and code-like terms of each document, thirty at most."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(C.anchor_terms(F.col("text"))).alias("a"))
    return d.where("a is not null").select("doc_id", "a.term", "a.class")


@query(with_sql("chunks", then=f""", tt AS (SELECT doc_id, unnest({_SIGNIFICANT.replace("content", "(split_part(text, chr(10), 1) || ' ' || text)")}) AS term FROM documents), df AS (SELECT term, count(*) AS document_frequency FROM tt GROUP BY 1), cc AS (SELECT term, count(*) AS chunk_frequency FROM (SELECT unnest({_SIGNIFICANT}) AS term FROM chunks) GROUP BY 1)
    SELECT term, coalesce(document_frequency, 0) AS document_frequency, coalesce(chunk_frequency, 0) AS chunk_frequency FROM df FULL JOIN cc USING (term)"""))
def corpus_term_statistics(spark, sf_dir):
    """Terms counted in titles and texts of documents, and apart from them in chunks."""
    d = corpus.table(spark, sf_dir, "documents").select(F.concat_ws(" ", F.substring_index("text", "\n", 1), "text").alias("text"))
    return terms.corpus_statistics(d, corpus.chunks(spark, sf_dir))


@query(with_sql("chunks", then=f""", {_TERMS_CTE}, {_STATS_CTE}, e AS (SELECT term, document_id, row_number() OVER (PARTITION BY term ORDER BY document_id DESC) AS r FROM (SELECT DISTINCT term, document_id FROM terms)), x AS (SELECT term, string_agg(document_id::VARCHAR, ',' ORDER BY r) AS examples FROM e WHERE r <= 3 GROUP BY 1)
    SELECT s.term, document_frequency, term_type, examples FROM stats s LEFT JOIN x USING (term)"""))
def term_examples(spark, sf_dir):
    """Statistics of terms with their three latest documents."""
    return terms.with_examples(terms.term_statistics(corpus.chunks(spark, sf_dir)), corpus.chunks(spark, sf_dir)).select("term", "document_frequency", "term_type", F.array_join("examples", ",").alias("examples"))


@query(with_sql("docs", then=f", {governance_queries._HEALTH}, s AS (SELECT CASE WHEN health = 'unknown' THEN 'not_configured' WHEN active = 0 THEN 'configured_not_indexed' WHEN health IN ('failed', 'warning') THEN 'needs_review' ELSE 'indexed' END AS docs_status FROM h) SELECT docs_status, count(*) AS services FROM s GROUP BY 1"))
def service_docs_status(spark, sf_dir):
    """How many services have documents in which state."""
    h = governance_queries._health(spark, sf_dir)
    status = F.when(F.col("health") == "unknown", "not_configured").when(F.col("active") == 0, "configured_not_indexed").when(F.col("health").isin("failed", "warning"), "needs_review").otherwise("indexed")
    return h.groupBy(status.alias("docs_status")).agg(F.count(F.lit(1)).alias("services"))


@query(_match_sql(""", d AS (SELECT doc_id AS document_id, split_part(text, chr(10), 1) AS title, source FROM documents WHERE doc_id % 9 <> 0) SELECT question_id, t.document_id, rank, title, source, d.document_id IS NULL AS lost FROM top_docs t LEFT JOIN d ON t.document_id = d.document_id"""))
def hydrate_documents(spark, sf_dir):
    """Routed documents with title and source; lost where the document table (here without every ninth) no longer has them."""
    d = corpus.table(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select(F.col("doc_id").alias("document_id"), F.substring_index("text", "\n", 1).alias("title"), "source")
    top = retrieval_queries.top_documents(spark, sf_dir).select("question_id", "document_id", "rank")
    return lifecycle.hydrated(top, d, "document_id").select("question_id", "document_id", "rank", "title", "source", "lost")


@query(with_sql("chunks", then="""SELECT document_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'chunk' ELSE d.source END AS owner, d.lang AS lang, chunk_index::VARCHAR AS part FROM chunks JOIN documents d ON d.doc_id = document_id"""))
def enrich_chunk_metadata(spark, sf_dir):
    """Chunks' metadata laid over their documents'."""
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.create_map(F.lit("owner"), "source", F.lit("lang"), "lang").alias("meta"))
    own = F.when(F.col("chunk_index") % 2 == 0, F.create_map(F.lit("owner"), F.lit("chunk"), F.lit("part"), F.col("chunk_index").cast("string"))).otherwise(F.create_map(F.lit("part"), F.col("chunk_index").cast("string")))
    c = corpus.chunks(spark, sf_dir).select("document_id", "chunk_index", own.alias("own")).join(d, "document_id").withColumn("key", F.struct("document_id", "chunk_index"))
    out = C.merged_metadata(c.select("key", "meta"), c.select("key", "own"), "key", "meta", "own")
    return out.select("key.document_id", "key.chunk_index", F.col("metadata")["owner"].alias("owner"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["part"].alias("part"))


@query("SELECT doc_id, source AS owner, CASE WHEN quality IS NOT NULL THEN 'q' || quality ELSE lang END AS lang FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def merge_document_metadata(spark, sf_dir):
    """Documents' metadata with that of their children (here: labels) laid over it."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("owner"), "source", F.lit("lang"), "lang").alias("meta"))
    labels = corpus.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.create_map(F.lit("lang"), F.concat(F.lit("q"), F.col("q").cast("string"))).alias("own"))
    out = C.merged_metadata(d, labels, "doc_id", "meta", "own")
    return out.select("doc_id", F.col("metadata")["owner"].alias("owner"), F.col("metadata")["lang"].alias("lang"))


@query("""SELECT * FROM (SELECT source, term, observations, confidence FROM (WITH t AS (SELECT source, unnest(list_distinct(regexp_extract_all(text, '""" + T.EXACT.replace("++", "+") + """'))) AS term FROM documents) SELECT source, term, count(*) AS observations, round(least(0.52::DOUBLE + least(0.025::DOUBLE * count(*), 0.18) + 0.08::DOUBLE, 0.95), 4) AS confidence FROM t GROUP BY ALL)) ORDER BY confidence DESC, source, term LIMIT 100""")
def top_glossary_candidates(spark, sf_dir):
    """The hundred surest candidates, a top-k report."""
    return governance_queries.glossary_candidates(spark, sf_dir).orderBy(F.desc("confidence"), "source", "term").limit(100)


@query(_match_sql(""", s AS (SELECT question_id, document_id, 0 AS x, score FROM top_docs UNION ALL SELECT question_id, document_id, 1, round(score * 1.25::DOUBLE, 6) FROM matches JOIN documents ON doc_id = document_id WHERE source = 'src1' AND score >= 0.2)
    SELECT question_id, document_id, max(score) AS score, max(CASE WHEN x = 1 THEN score END) > coalesce(max(CASE WHEN x = 0 THEN score END), -1) AS from_extra FROM s GROUP BY 1, 2""").replace("max(CASE WHEN x = 1 THEN score END) > coalesce(max(CASE WHEN x = 0 THEN score END), -1) AS from_extra", "coalesce(max(CASE WHEN x = 1 THEN score END), -2) > coalesce(max(CASE WHEN x = 0 THEN score END), -1) AS from_extra"))
def merge_scoped_results(spark, sf_dir):
    """Routed documents and those of a search within one source, each with its higher score."""
    # Both searches keep of the same matches; those that neither takes are not written.
    matches = cut(retrieval_queries._matches(spark, sf_dir).where("score >= 0.12"), "matches")
    base = R.top_per(matches, "question_id", "score", "document_id", 5, 0.12).select("question_id", "document_id", "score")
    inside = corpus.table(spark, sf_dir, "documents").where("source = 'src1'").select(F.col("doc_id").alias("document_id"))
    extra = matches.where("score >= 0.2").join(inside, "document_id").select("question_id", "document_id", F.round(F.col("score") * 1.25, 6).alias("score"))
    return C.higher_scored(base, extra, ["question_id", "document_id"])


@query("SELECT d.doc_id, e.vec_id IS NOT NULL AS embedded FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(vec_id) AS vec_id FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 2 = 0 GROUP BY 1) e ON e.h = sha256(d.text)")
def embed_batch(spark, sf_dir):
    """Documents with the vectors that are stored for their content; here those of even ids are."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = corpus.table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").join(d, F.col("vec_id") == F.col("doc_id")).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min_by("embedding", "vec_id").alias("v"))
    return C.with_embedding(d, v, 64).select("doc_id", F.col("v").isNotNull().alias("embedded"))


_CARD_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_any('low', marks)} THEN '{name}' END" for name, marks in Q.DEFAULT.content.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(({_CARD_TYPES})[1:3], ',') AS content_types FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def card_content_types(spark, sf_dir):
    """Kinds of material that a document's words hint at, three at most."""
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.array_join(Q.hinted_types(F.lower("text")), ",").alias("content_types"))


@query("SELECT doc_id, md5(concat_ws(chr(10), split_part(text, chr(10), 1), source, lang, rtrim(substring(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), 1, 700)))) AS card_text_md5, md5(concat_ws(chr(10), split_part(text, chr(10), 1), text)) AS embedding_text_md5 FROM documents")
def card_text(spark, sf_dir):
    """The texts that cards and embeddings are searched by."""
    title = F.substring_index("text", "\n", 1)
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.concat_ws("\n", title, "source", "lang", T.summarize(F.col("text"), 700))).alias("card_text_md5"), F.md5(F.concat_ws("\n", title, "text")).alias("embedding_text_md5"))


@query(f"WITH names AS (SELECT page_id, {_HOST} AS name FROM pages) SELECT page_id, name FROM names WHERE {_ID('name')} NOT IN (SELECT {_ID('source')} FROM documents UNION SELECT {_ID('name')} FROM names WHERE page_id % 3 = 0)")
def known_service_exclusion(spark, sf_dir):
    """Services of pages that neither a source nor an earlier page (every third) has."""
    p = corpus.table(spark, sf_dir, "pages").select("page_id", T.url_domain(F.col("url")).alias("name"))
    known = corpus.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).union(p.where("page_id % 3 = 0").select("name"))
    return C.unknown_services(p, known)


_PLAN = f"""{_SNAPSHOTS}, j AS (SELECT document_key, old.content_hash AS o, new.content_hash AS n FROM old FULL JOIN new USING (document_key)), ad AS (SELECT n AS o, min(document_key) AS successor, count(*) AS k FROM j WHERE o IS NULL GROUP BY 1),
    plan AS (SELECT document_key, CASE WHEN j.o IS NULL THEN 'added' WHEN n IS NULL AND k = 1 THEN 'moved' WHEN n IS NULL THEN 'missing' WHEN j.o = n THEN 'unchanged' ELSE 'changed' END AS class, CASE WHEN n IS NULL THEN successor END AS successor FROM j LEFT JOIN ad ON ad.o = j.o)"""


@query(f"WITH {_PLAN} SELECT document_key, class, successor, CASE WHEN class = 'moved' THEN 'relocate' WHEN successor IS NOT NULL THEN 'choose_successor' ELSE 'archive_or_keep' END AS question FROM plan WHERE class IN ('missing', 'moved')")
def review_queue(spark, sf_dir):
    """What an owner decides on after a reconciliation."""
    return V.review_queue(V.reconcile(*ingest_queries._snapshots(spark, sf_dir)))


_R = [("old.content_hash IS NULL", "old_key_not_active"), ("new.content_hash IS NULL", "new_key_not_discovered"), ("old.content_hash <> new.content_hash", "content_differs"), ("taken.document_key IS NOT NULL", "key_collision"), ("wanted.k > 1", "requested_twice")]


@query(f"""WITH {_SNAPSHOTS}, req AS (SELECT source || '/' || doc_id AS document_key, source || '/' || (doc_id + CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 0 END) AS new_key FROM documents WHERE doc_id % 3 = 0), wanted AS (SELECT new_key, count(*) AS k FROM req GROUP BY 1)
    SELECT req.document_key, req.new_key, req.document_key AS moved_from, array_to_string({_WHY(*_R)}, ',') AS reasons, len({_WHY(*_R)}) = 0 AS ready FROM req LEFT JOIN old ON old.document_key = req.document_key LEFT JOIN new ON new.document_key = req.new_key LEFT JOIN old taken ON taken.document_key = req.new_key JOIN wanted ON wanted.new_key = req.new_key""")
def relocation_plan(spark, sf_dir):
    """Requests to move keys, with what stands against each."""
    old, new = ingest_queries._snapshots(spark, sf_dir)
    d = corpus.table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    name = lambda i: F.concat("source", F.lit("/"), i.cast("string"))
    out = V.relocation_plan(d.select(name(F.col("doc_id")).alias("document_key"), name(F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 20).otherwise(0)).alias("new_key")), old, new)
    return out.withColumn("reasons", F.array_join("reasons", ","))


_B = "len(list_filter(string_split(n, chr(10)), lambda x: lower(trim(x)) IN (" + ", ".join(f"'{b}'" for b in T.BOILERPLATE) + "))) > 0"
_RP = [("n IS NULL", "key_not_extracted"), ("n = text", "nothing_changed"), (_B, "boilerplate_left"), ("contains(lower(text), lower(lang)) AND NOT contains(lower(n), lower(lang))", "required_term_lost")]


@query(f"""WITH x AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 7 = 0 THEN text || chr(10) || 'Menu' ELSE replace(text, 'e', '') END AS n FROM documents) SELECT doc_id, array_to_string({_WHY(*_RP)}, ',') AS reasons, len({_WHY(*_RP)}) = 0 AS ready FROM x""")
def key_reprocess_plan(spark, sf_dir):
    """Documents extracted anew against what they were."""
    d = corpus.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    new = d.where(i % 11 != 0).select("doc_id", F.when(i % 5 == 0, F.col("text")).when(i % 7 == 0, F.concat("text", F.lit("\nMenu"))).otherwise(F.replace("text", F.lit("e"), F.lit(""))).alias("text"))
    out = V.reprocess_plan(d.select("doc_id", "text"), new, d.select("doc_id", F.col("lang").alias("term")), key="doc_id")
    return out.withColumn("reasons", F.array_join("reasons", ","))


_DC = [("active = 0", "no_active_version"), ("active > saved_active", "active_not_in_backup"), ("document_id % 6 = 0", "draft_not_in_backup"), ("drifted > 0", "other_rows_drifted")]


@query(with_sql("docs", then=f""", g AS (SELECT document_key, count_if(status = 'active') AS active, count_if(status = 'active' AND document_id % 6 <> 0) AS saved_active, count_if(status <> 'draft' AND document_id % 31 = 0) AS drifted FROM docs GROUP BY 1)
    SELECT document_id, document_key, array_to_string({_WHY(*_DC)}, ',') AS reasons, len({_WHY(*_DC)}) = 0 AS ready FROM docs JOIN g USING (document_key) WHERE status = 'draft'"""))
def draft_cleanup_plan(spark, sf_dir):
    """Drafts and what stands against deleting them; the backup lacks every sixth row, every 31st has drifted."""
    d = corpus.documents(spark, sf_dir).select("document_id", "document_key", "status")
    out = V.draft_cleanup_plan(d, d.where("document_id % 6 <> 0").select("document_id"), d.where("document_id % 31 = 0").select("document_id"))
    return out.withColumn("reasons", F.array_join("reasons", ","))


_AP = [("NOT starts_with(lower(url), 'https://')", "not_https"), ("regexp_matches(url, '[?#]')", "url_not_exact"), (f"{_HOST} <> domain", "domain_differs"), ("NOT known", "domain_not_allowed"), ("page_id % 4 = 0", "preview_not_ready"), ("page_id % 5 = 0", "not_confirmed")]


@query(f"""WITH p AS (SELECT page_id, url, regexp_replace({_HOST}, '^(www|m)[.]', '') AS domain FROM pages), q AS (SELECT *, domain LIKE '%.example.com' OR domain LIKE '%.example.org' AS known FROM p) SELECT page_id AS candidate_id, domain, array_to_string({_WHY(*_AP)}, ',') AS reasons, len({_WHY(*_AP)}) = 0 AS ready FROM q""")
def activation_policy(spark, sf_dir):
    """Candidates and what stands against activating them."""
    i = F.col("page_id")
    p = corpus.table(spark, sf_dir, "pages").select(i.alias("candidate_id"), "url", F.regexp_replace(T.url_domain(F.col("url")), "^(www|m)[.]", "").alias("domain"), F.when(i % 4 == 0, "failed").otherwise("ready").alias("preview"), (i % 5 != 0).alias("confirmed"))
    out = V.activation_policy(p, p.where("domain like '%.example.com' or domain like '%.example.org'").select("domain"))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH p AS (SELECT page_id, url, split_part({_HOST}, '.', -3) AS name, lower(url) AS u FROM pages), asked AS (SELECT name, count(*) AS questions FROM p WHERE {_ID("name")} NOT IN (SELECT {_ID("name")} FROM p WHERE page_id % 4 = 0) GROUP BY 1),
    good AS (SELECT name, page_id, url, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN contains(u, '/en/') THEN 3 ELSE 0 END - CASE WHEN contains(u, '?') THEN 2 ELSE 0 END DESC, page_id) AS r FROM p WHERE starts_with(u, 'https://')) SELECT a.name, questions, page_id, url FROM asked a LEFT JOIN (SELECT * FROM good WHERE r = 1) g USING (name)""")
def discover_candidates(spark, sf_dir):
    """Services that are asked for (here: of pages), known by none (here: of every fourth page), with their best page."""
    p = corpus.table(spark, sf_dir, "pages").withColumn("host", T.url_domain(F.col("url"))).withColumn("name", F.coalesce(F.get(F.split("host", "[.]"), F.size(F.split("host", "[.]")) - 3), F.lit("")))
    low = F.lower("url")
    score = F.when(F.contains(low, F.lit("/en/")), 3).otherwise(0) - F.when(F.contains(low, F.lit("?")), 2).otherwise(0)
    return V.discover_candidates(p.select("name"), p.where("page_id % 4 = 0").select("name"), p.select("name", "page_id", "url"), low.startswith("https://"), score)


@query(f"""WITH {_SNAPSHOTS}, twice AS (SELECT * FROM new UNION ALL SELECT * FROM new WHERE ends_with(document_key, '3')), g AS (SELECT document_key, count(*) AS n, max((length(content_hash) <> 64)::INT) AS bad FROM twice GROUP BY 1)
    SELECT document_key, array_to_string({_WHY(("split_part(document_key, '/', 1) IN ('src7', 'src8')", "outside_scope"), ("n > 1", "duplicate_key"), ("bad = 1", "bad_hash"))}, ',') AS reasons FROM g""")
def verify_snapshot(spark, sf_dir):
    """A snapshot (here with some keys twice) against the scope of all sources but two."""
    _, new = ingest_queries._snapshots(spark, sf_dir)
    scopes = corpus.table(spark, sf_dir, "documents").where("source not in ('src7', 'src8')").select(F.col("source").alias("prefix")).distinct()
    out = V.verify_snapshot(new.unionByName(new.where(F.col("document_key").endswith("3"))), scopes)
    return out.withColumn("reasons", F.array_join("reasons", ","))


_AR = [("coalesce(decision, '') <> 'archive'", "not_decided"), ("saved IS NULL", "no_backup"), ("saved <> content_hash", "backup_out_of_date"), ("successor IS NOT NULL AND live IS NULL", "successor_not_active")]


@query(f"""WITH {_SNAPSHOTS}, m AS (SELECT old.*, split_part(document_key, '/', 2)::BIGINT AS i, split_part(document_key, '/', 1) AS s FROM old ANTI JOIN new USING (document_key)), d AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'keep' ELSE 'archive' END AS decision, CASE WHEN i % 4 = 0 THEN s || '/' || (i + 20) END AS successor,
    CASE WHEN i % 9 = 0 THEN NULL WHEN i % 8 = 0 THEN 'older' ELSE content_hash END AS saved FROM m), j AS (SELECT d.*, n.document_key AS live FROM d LEFT JOIN new n ON n.document_key = d.successor) SELECT document_key, successor, array_to_string({_WHY(*_AR)}, ',') AS reasons, len({_WHY(*_AR)}) = 0 AS ready FROM j""")
def archive_plan(spark, sf_dir):
    """Missing keys and what stands against archiving them, by the owner's decisions, the backup and what is active."""
    old, new = ingest_queries._snapshots(spark, sf_dir)
    missing = old.join(new.select("document_key"), "document_key", "left_anti")
    i, s = F.substring_index("document_key", "/", -1).cast("long"), F.substring_index("document_key", "/", 1)
    decisions = missing.select("document_key", F.when(i % 5 == 0, "keep").otherwise("archive").alias("decision"), F.when(i % 4 == 0, F.concat(s, F.lit("/"), (i + 20).cast("string"))).alias("successor"))
    backup = missing.where(i % 9 != 0).select("document_key", F.when(i % 8 == 0, "older").otherwise(F.col("content_hash")).alias("content_hash"))
    out = V.archive_plan(missing, decisions, backup, new)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+(?:[./][A-Za-z0-9]+)+'))) AS term FROM documents), r AS (SELECT doc_id || ':' || term AS item, term, CASE doc_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'edited' ELSE 'approved' END AS decision, CASE WHEN doc_id % 4 = 1 THEN term || '_x' ELSE term END AS t FROM t),
    k AS (SELECT DISTINCT lower(term) AS k FROM t WHERE doc_id % 6 = 0), f AS (SELECT lower(t) AS k, min(item) AS first FROM r WHERE decision <> 'rejected' GROUP BY 1)
    SELECT item, t AS term, CASE WHEN decision = 'rejected' THEN 'not_approved' WHEN SECRET OR regexp_matches(t, '[0-9]{4,}') THEN 'sensitive' WHEN k.k IS NOT NULL THEN 'known' WHEN item > first THEN 'duplicate' ELSE 'apply' END AS action FROM r LEFT JOIN k ON k.k = lower(t) LEFT JOIN f ON f.k = lower(t)""".replace("SECRET", "(" + " OR ".join(f"regexp_matches(t, '{s}')" for s, _ in T.SECRETS) + ")"))
def glossary_apply_plan(spark, sf_dir):
    """Reviewed terms (here: dotted ones) and which are applied; terms of every sixth document are known already."""
    i = F.col("doc_id")
    t = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+(?:[./][A-Za-z0-9]+)++"), F.lit(0)))).alias("term"))
    reviewed = t.select(F.concat_ws(":", i.cast("string"), "term").alias("item"), "term", F.when(i % 4 == 0, "rejected").when(i % 4 == 1, "edited").otherwise("approved").alias("decision"), F.concat("term", F.lit("_x")).alias("edited"))
    return V.glossary_plan(reviewed, t.where(i % 6 == 0).select("term"))


@query(f"""WITH p AS (SELECT page_id, regexp_replace({_HOST}, '^(www|m)[.]', '') AS domain, len(html) AS chars FROM pages), c AS (SELECT DISTINCT domain FROM p), n AS (SELECT domain, count(*) AS pages, count_if(chars < 500) AS short FROM p WHERE page_id % 5 <> 0 GROUP BY 1), o AS (SELECT DISTINCT domain FROM p WHERE page_id % 40 = 0)
    SELECT c.domain, coalesce(pages, 0) AS pages, coalesce(short, 0) AS short, CASE WHEN o.domain IS NOT NULL THEN 'already_connected' WHEN coalesce(pages, 0) = 0 THEN 'failed' WHEN pages < 3 OR short * 3 > pages THEN 'needs_review' ELSE 'ready' END AS state FROM c LEFT JOIN n ON n.domain = c.domain LEFT JOIN o ON o.domain = c.domain""")
def preview_queue(spark, sf_dir):
    """Candidates' previews; every fifth page could not be read, domains of every fortieth are connected."""
    p = corpus.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(T.url_domain(F.col("url")), "^(www|m)[.]", "").alias("domain"), F.length("html").alias("chars"))
    return V.preview_states(p, p.where("page_id % 5 <> 0"), p.where("page_id % 40 = 0"))


@query(f"""SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]+)$', 1) AS filename, {_ID("regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)")} AS service_id,
    regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]+)$', 1), '[.][a-z]+$', ''), '[-_]+', ' ', 'g') AS title FROM pages""")
def url_names(spark, sf_dir):
    """File names, service ids and titles that addresses give."""
    p = corpus.table(spark, sf_dir, "pages")
    return p.select("page_id", T.url_filename(F.col("url")).alias("filename"), T.normalize_service_id(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)).alias("service_id"), T.title_from_url(F.col("url")).alias("title"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en'), p AS (SELECT query_id, vec_id, round(list_dot_product(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS score FROM q, s WHERE vec_id <> query_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 8""")
def top_cards(spark, sf_dir):
    """The eight nearest cards of one course for each query vector, exactly."""
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit("all").alias("workspace_id"), F.col("lang").alias("course"))
    cards = v.join(C.scope(d, "all", "en").select("vec_id"), "vec_id", "left_semi")
    return R.top_by_vector(cards, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 8)


@query(with_sql("lines", then="""SELECT document_id, count(*) AS lines, count_if(regexp_matches(lower(h), '^(page|section|chapter|part|lesson)? ?[0-9.]*$') OR lower(h) IN ('introduction', 'overview', 'other', 'unknown', 'none', 'untitled')) AS generic, max(length(h)) AS longest
    FROM (SELECT *, rtrim(substring(trim(regexp_replace(regexp_replace(line, '^[#*>\\- ]+', ''), '[ \\t]+', ' ', 'g')), 1, 160)) AS h FROM lines) GROUP BY 1"""))
def generic_headings(spark, sf_dir):
    """How many of a document's lines would say nothing as headings."""
    rows = corpus.lines(spark, sf_dir)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.is_generic_heading(F.col("line"))).alias("generic"), F.max(F.length(T.clean_heading(F.col("line")))).alias("longest"))
