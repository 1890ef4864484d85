"""Queries of screening, facets, evidence packs, service states and reviewed plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import retrieval as R
from sparkevidence.plans import corpus, ingest_queries, retrieval_queries
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.plans.ingest_queries import _SNAPSHOTS
from sparkevidence.plans.retrieval_queries import _CHUNK_CTE, _MENTION_CTE, _match_sql

#: Host and path parts that rule out a page as official documentation. Fixed values.
FORBIDDEN = ("forum", "blog", "community", "reddit", "medium", "news")
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"


@query(f"""SELECT page_id, array_to_string(list_filter([CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'not_https' END, CASE WHEN NOT contains({_HOST}, '.') OR regexp_matches({_HOST}, '^[0-9.]+$') OR ends_with({_HOST}, '.local') THEN 'not_public' END,
    CASE WHEN regexp_matches(lower(url), '{"|".join(FORBIDDEN)}') THEN 'forbidden' END, CASE WHEN NOT regexp_matches(lower(url), 'docs|guide|api|reference|manual') THEN 'no_docs_marker' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pages""")
def public_https_result(spark, sf_dir):
    """Why a search result is not taken as official documentation; none if it is."""
    host, low = T.url_domain(F.col("url")), F.lower("url")
    reasons = F.array_compact(F.array(F.when(~low.startswith("https://"), "not_https"), F.when(~F.contains(host, F.lit(".")) | host.rlike("^[0-9.]+$") | host.endswith(".local"), "not_public"), F.when(low.rlike("|".join(FORBIDDEN)), "forbidden"), F.when(~low.rlike("docs|guide|api|reference|manual"), "no_docs_marker")))
    return corpus.table(spark, sf_dir, "pages").select("page_id", F.array_join(reasons, ",").alias("reasons"))


@query(f"SELECT host, page_id, url, r AS rank FROM (SELECT page_id, url, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS r FROM pages) WHERE r <= 5")
def scan_search_results(spark, sf_dir):
    """At most five stored results for each query (here: host)."""
    p = corpus.table(spark, sf_dir, "pages").withColumn("host", T.url_domain(F.col("url")))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("rank <= 5").select("host", "page_id", "url", "rank")


@query("""SELECT event_id, event_type, user_id FROM events WHERE json_extract_string(props, '$.k') = '1' OR event_type = 'purchase'""")
def metadata_contains(spark, sf_dir):
    """Containment of a key and value in open metadata, or of a promoted column."""
    e = corpus.table(spark, sf_dir, "events")
    return e.where((F.get_json_object("props", "$.k") == "1") | (F.col("event_type") == "purchase")).select("event_id", "event_type", "user_id")


@query(with_sql("lines", then="""SELECT document_id, count(*) AS lines, count_if(joined) AS joined FROM (SELECT document_id, NOT regexp_matches(line, '^(#|[-*] |[0-9]+[.] |[|])') AND NOT regexp_matches(lag(line) OVER (PARTITION BY document_id ORDER BY line_no), '[.!?:]$|^(#|[|])') AND line_no > 0 AS joined FROM lines) GROUP BY 1"""))
def join_wrapped_lines(spark, sf_dir):
    """How many of a document's lines go on from the line before: no mark at its start, no end mark before it."""
    before = F.lag("line").over(Window.partitionBy("document_id").orderBy("line_no"))
    joined = ~F.col("line").rlike("^(#|[-*] |[0-9]+[.] |[|])") & ~before.rlike("[.!?:]$|^(#|[|])") & (F.col("line_no") > 0)
    return corpus.lines(spark, sf_dir).withColumn("joined", joined).groupBy("document_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("joined").alias("joined"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3,}')) AS numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([A-Z]{2,}[-_][0-9]{2,})', 1))), ',') AS fact_ids FROM documents""")
def extract_fact_ids(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z]{2,}[-_][0-9]{2,})"), F.lit(1))))
    return d.select("doc_id", F.regexp_count("text", F.lit("[0-9]{3,}")).alias("numbers"), F.array_join(ids, ",").alias("fact_ids"))


@query(r"""SELECT conv_id, turn, md5(text) AS text_md5, CASE WHEN len(b) = 1 AND NOT regexp_matches(text, 'https?://|@') THEN b[1] END AS unknown_service FROM (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+[A-Z][A-Za-z]+')) AS b FROM conversations WHERE role = 'user')""")
def detect_unknown_service(spark, sf_dir):
    """The brand-shaped token of a user turn, if there is exactly one and no address."""
    t = corpus.table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("b", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+[A-Z][A-Za-z]+"), F.lit(0))))
    return t.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.when((F.size("b") == 1) & ~F.col("text").rlike("https?://|@"), F.try_element_at("b", F.lit(1))).alias("unknown_service"))


@query(r"""SELECT doc_id, regexp_matches(text, '[\x{FFFD}]|Ã.|â€') AS broken, regexp_matches(text, '[A-Za-z0-9_-]{32,}') AS random_token, len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) * 4 > len(text) AS noise FROM documents""")
def noise_terms(spark, sf_dir):
    d, x = corpus.table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", x.rlike(r"[\x{FFFD}]|Ã.|â€").alias("broken"), x.rlike("[A-Za-z0-9_-]{32,}").alias("random_token"), (F.regexp_count(x, F.lit(r"[^\p{L}\p{N}\s]")) * 4 > F.length(x)).alias("noise"))


@query(_match_sql(f""", {_CHUNK_CTE}, pool AS (SELECT *, round(overlap * 0.7::DOUBLE + document_score * 0.3::DOUBLE, 4) AS rescored FROM ranked WHERE rank <= 16)
    SELECT question_id, document_id, chunk_index, rescored, k FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rescored DESC, document_id, chunk_index) AS k FROM pool) WHERE k <= 4"""))
def over_fetch_rerank(spark, sf_dir):
    """Four times as many by the cheap score, then the best by a second one."""
    pool = retrieval_queries._ranked_chunks(spark, sf_dir).where("rank <= 16").withColumn("rescored", F.round(F.col("overlap") * 0.7 + F.col("document_score") * 0.3, 4))
    return pool.withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rescored"), "document_id", "chunk_index"))).where("k <= 4").select("question_id", "document_id", "chunk_index", "rescored", "k")


@query(with_sql("docs", then="SELECT document_id, title FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY document_id) AS r FROM docs) WHERE r = 1"))
def keep_first_dedupe(spark, sf_dir):
    """The first document of each title, either case; a grouped minimum, no window over frequent titles."""
    d = corpus.documents(spark, sf_dir)
    return d.groupBy(F.lower("title").alias("t")).agg(F.min(F.struct("document_id", "title")).alias("m")).select("m.document_id", "m.title")


_COURSE = "['english', 'en'], ['deutsch', 'german', 'de'], ['francais', 'french', 'fr'], ['espanol', 'spanish', 'es']"


@query(f"""WITH a AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS course, unnest([{_COURSE}]) AS aliases), w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')) AS t FROM documents),
    h AS (SELECT doc_id, course, len(list_intersect(t, aliases)) / len(aliases) AS coverage FROM w, a), b AS (SELECT doc_id, course, coverage, row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, course) AS r FROM h WHERE coverage > 0)
    SELECT doc_id, course, round(least(0.95, 0.42::DOUBLE + 0.48::DOUBLE * coverage), 4) AS confidence FROM b WHERE r = 1""")
def best_course_alias(spark, sf_dir):
    """The course whose aliases a text covers best: an equi join of words and aliases."""
    rows = [("en", x, 2) for x in ("english", "en")] + [("de", x, 3) for x in ("deutsch", "german", "de")] + [("fr", x, 3) for x in ("francais", "french", "fr")] + [("es", x, 3) for x in ("espanol", "spanish", "es")]
    a = spark.createDataFrame(rows, "course string, word string, n int")
    w = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    h = w.join(F.broadcast(a), "word").groupBy("doc_id", "course").agg((F.count(F.lit(1)) / F.first("n")).alias("coverage"))  # eleven rows
    b = h.groupBy("doc_id").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "course")).alias("b"))
    return b.select("doc_id", "b.course", F.round(F.least(F.lit(0.95), 0.42 + 0.48 * -F.col("b.c")), 4).alias("confidence"))


@query("""SELECT 'documents' AS kind, source AS key, count(*) AS observations, 0.50::DOUBLE AS base FROM documents GROUP BY source UNION ALL SELECT 'pages', lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), count(*), 0.58::DOUBLE FROM pages GROUP BY 2
    UNION ALL SELECT 'turns', role, count(*), 0.72::DOUBLE FROM conversations GROUP BY role UNION ALL SELECT 'events', event_type, count(*), 0.52::DOUBLE FROM events GROUP BY event_type""")
def observation_union(spark, sf_dir):
    """Observations of four tables, each with its own base confidence."""
    part = lambda table, kind, key, base: corpus.table(spark, sf_dir, table).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("observations")).select(F.lit(kind).alias("kind"), "key", "observations", F.lit(base).alias("base"))
    parts = [part("documents", "documents", F.col("source"), 0.50), part("pages", "pages", T.url_domain(F.col("url")), 0.58), part("conversations", "turns", F.col("role"), 0.72), part("events", "events", F.col("event_type"), 0.52)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_MENTION_CTE} SELECT doc_id, count(*) AS services, string_agg(service_id, ',' ORDER BY service_id) AS service_ids, CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN max(service_id) = 'article' THEN 'inactive' ELSE 'confirmed' END AS state FROM mentions GROUP BY doc_id")
def service_suggestions(spark, sf_dir):
    """Each document's mentioned services and the state they give it."""
    m = R.mentions(corpus.table(spark, sf_dir, "documents"), "doc_id", "text", retrieval_queries._services(spark))
    state = F.when(F.count(F.lit(1)) > 1, "ambiguous").when(F.max("service_id") == "article", "inactive").otherwise("confirmed")
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("services"), F.array_join(F.array_sort(F.collect_list("service_id")), ",").alias("service_ids"), state.alias("state"))


@query(with_sql("docs", then=f", {_MENTION_CTE}, s AS (SELECT service_id, count(DISTINCT source_name) AS sources, count(*) AS documents FROM mentions JOIN docs ON doc_id = document_id WHERE status = 'active' GROUP BY 1) SELECT service_id, sources, documents, CASE WHEN sources = 1 THEN 'ok' WHEN sources > 1 THEN 'several_sources' ELSE 'none' END AS scope FROM s"))
def source_scope(spark, sf_dir):
    """Services whose active documents come from exactly one source, or why not."""
    m = R.mentions(corpus.table(spark, sf_dir, "documents"), "doc_id", "text", retrieval_queries._services(spark))
    d = corpus.documents(spark, sf_dir).where("status = 'active'").select(F.col("document_id").alias("doc_id"), "source_name")
    s = m.join(d, "doc_id").groupBy("service_id", "source_name").agg(F.count(F.lit(1)).alias("n")).groupBy("service_id").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("documents"))
    return s.withColumn("scope", F.when(F.col("sources") == 1, "ok").when(F.col("sources") > 1, "several_sources").otherwise("none"))


@query(f"""WITH {_SNAPSHOTS}, c AS (SELECT document_key, CASE WHEN old.content_hash IS NULL THEN 'added' WHEN new.content_hash IS NULL THEN 'missing' WHEN old.content_hash = new.content_hash THEN 'unchanged' ELSE 'changed' END AS class FROM old FULL JOIN new USING (document_key))
    SELECT split_part(document_key, '/', 1) AS source, count(*) AS n_keys, count_if(class = 'missing') AS missing, count_if(class = 'changed') AS changed, CASE WHEN count_if(class = 'missing') * 4 > count(*) THEN 'blocked' WHEN count_if(class = 'missing') > 0 THEN 'needs_review' ELSE 'ready' END AS readiness FROM c GROUP BY 1""")
def reprocessing_plan(spark, sf_dir):
    """Each source's counts by class and whether it can be processed again without an owner's decision."""
    c = ingest_queries.reconcile(spark, sf_dir).groupBy(F.substring_index("document_key", "/", 1).alias("source")).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("class") == "missing").alias("missing"), F.count_if(F.col("class") == "changed").alias("changed"))
    return c.withColumn("readiness", F.when(F.col("missing") * 4 > F.col("n_keys"), "blocked").when(F.col("missing") > 0, "needs_review").otherwise("ready"))


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), n AS (SELECT host, count(*) AS n FROM p GROUP BY 1) SELECT page_id, host FROM p JOIN n USING (host) WHERE n = 1 ORDER BY page_id DESC LIMIT 50""")
def pending_suggestions(spark, sf_dir):
    """The 50 newest suggestions whose host has no other, a top-k report."""
    p = corpus.table(spark, sf_dir, "pages").groupBy(T.url_domain(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("page_id"))
    return p.where("n = 1").select("page_id", "host").orderBy(F.desc("page_id")).limit(50)
