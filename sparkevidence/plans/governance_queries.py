"""Queries that govern sources: status, health, gates, suggestions and glossary candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import health, suggestions
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql

_NOW = 1704067200 + 40 * 86400


@query(with_sql("docs", then="""SELECT source_name, count(*) AS total, count_if(status = 'active') AS active, count_if(status = 'archived') AS archived, max(created_s) AS latest_s, substring(sha256(arg_max(text, created_s)), 1, 16) AS latest_hash, count_if(text = '') AS empty FROM docs GROUP BY 1"""))
def source_index_status(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    return d.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "archived").alias("archived"), F.max("created_s").alias("latest_s"),
        F.max_by(F.substring(F.sha2("text", 256), 1, 16), "created_s").alias("latest_hash"), F.count_if(F.col("text") == "").alias("empty"),
    )


_HEALTH = """h0 AS (SELECT source_name, count(*) AS total, count_if(text = '') AS empty, count_if(len(text) < 200) AS short, count_if(status = 'active') AS active, max(CASE WHEN status = 'active' THEN created_s END) AS latest_s, CASE source_name WHEN 'src1' THEN 20 WHEN 'src2' THEN 60 ELSE 30 END AS threshold FROM docs GROUP BY 1),
    h AS (SELECT source_name, active, threshold, CASE WHEN latest_s IS NOT NULL THEN greatest((1707523200 - latest_s) // 86400, 0) END AS age_days, CASE WHEN total = 0 OR threshold IS NULL THEN 'unknown' WHEN active = 0 THEN 'inactive' WHEN empty > 0 THEN 'failed' WHEN short * 4 > total THEN 'warning' WHEN greatest((1707523200 - latest_s) // 86400, 0) > threshold THEN 'stale' ELSE 'healthy' END AS health FROM h0)"""


def _health(spark, sf_dir):
    """Each source's state by its documents, quality and age against its threshold, from a table of thresholds."""
    d = corpus.documents(spark, sf_dir)
    status = d.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.max(F.when(F.col("status") == "active", F.col("created_s"))).alias("latest_s"),
        F.when(F.count_if(F.col("text") == "") > 0, "FAIL").when(F.count_if(F.length("text") < 200) * 4 > F.count(F.lit(1)), "WARN").otherwise("PASS").alias("quality"),
    )
    policy = spark.createDataFrame([("src1", 20), ("src2", 60)], "source_name string, days int")
    return health.source_health(status, policy, _NOW).select("source_name", "active", "threshold", "age_days", "health")


@query(with_sql("docs", then=f", {_HEALTH} SELECT * FROM h"))
def source_health(spark, sf_dir):
    return _health(spark, sf_dir)


_LEVELS = """s AS (SELECT source_name, count(*) AS total, count_if(status = 'active') AS active, max(CASE WHEN status = 'active' THEN created_s END) AS latest_s, arg_max(course, document_id) AS service_id, CASE WHEN count(*) % 3 = 0 THEN (count(*) % 40)::INT END AS refresh_days FROM docs GROUP BY 1),
    t AS (SELECT *, coalesce(CASE source_name WHEN 'src1' THEN 20 WHEN 'src2' THEN 60 END, CASE service_id WHEN 'de' THEN 35 WHEN 'fr' THEN 45 END, CASE WHEN refresh_days >= 1 THEN refresh_days END, 30) AS threshold, CASE WHEN latest_s IS NOT NULL THEN greatest((1707523200 - latest_s) // 86400, 0) END AS age_days FROM s)"""


@query(with_sql("docs", then=f""", {_LEVELS} SELECT source_name, service_id, refresh_days, threshold, age_days, CASE WHEN total = 0 THEN 'unknown' WHEN active = 0 THEN 'inactive' WHEN age_days IS NULL THEN 'unknown' WHEN age_days > threshold THEN 'stale' ELSE 'healthy' END AS health FROM t"""))
def health_by_levels(spark, sf_dir):
    """Each source against its threshold: its own, its service's, how often it is fetched anew, or the default. The language of a source's
    last document stands for its service here."""
    d = corpus.documents(spark, sf_dir)
    n = F.count(F.lit(1))
    status = d.groupBy("source_name").agg(
        n.alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.max(F.when(F.col("status") == "active", F.col("created_s"))).alias("latest_s"), F.lit("PASS").alias("quality"),
        F.max_by("course", "document_id").alias("service_id"), F.when(n % 3 == 0, (n % 40).cast("int")).alias("refresh_days"),
    )
    policy = spark.createDataFrame([("src1", 20), ("src2", 60)], "source_name string, days int")
    services = spark.createDataFrame([("de", 35), ("fr", 45)], "service_id string, days int")
    return health.source_health(status, policy, _NOW, services=services).select("source_name", "service_id", "refresh_days", "threshold", "age_days", "health")


@query(with_sql("docs", then=f", {_HEALTH} SELECT health, count(*) AS sources FROM h GROUP BY 1"))
def health_summary(spark, sf_dir):
    return _health(spark, sf_dir).groupBy("health").agg(F.count(F.lit(1)).alias("sources"))


@query(with_sql("docs", then=f", {_HEALTH} SELECT source_name, health FROM h WHERE health IN ('stale', 'inactive') OR lower(source_name) = 'src3'"))
def filter_health(spark, sf_dir):
    return _health(spark, sf_dir).where("health in ('stale', 'inactive') or lower(source_name) = 'src3'").select("source_name", "health")


@query(with_sql("docs", "chunks", then="""SELECT count_if(status = 'active') AS active_documents, count_if(status = 'archived') AS archived, count(DISTINCT source_name) AS sources, (SELECT count(*) FROM chunks JOIN docs USING (document_id) WHERE status = 'active') AS active_chunks FROM docs"""))
def knowledge_base_status(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    by_source = d.groupBy("source_name").agg(F.count_if(F.col("status") == "active").alias("a"), F.count_if(F.col("status") == "archived").alias("r"))
    chunks = corpus.chunks(spark, sf_dir).join(d.where("status = 'active'").select("document_id"), "document_id", "left_semi").agg(F.count(F.lit(1)).alias("active_chunks"))
    return by_source.agg(F.sum("a").alias("active_documents"), F.sum("r").alias("archived"), F.count(F.lit(1)).alias("sources")).crossJoin(chunks)  # one row each


@query(with_sql("docs", then="SELECT document_id, title, created_s FROM docs WHERE status = 'active' AND source_name <> 'src0' ORDER BY created_s DESC, document_id LIMIT 20"))
def recent_materials(spark, sf_dir):
    """The 20 newest active documents outside one source, a top-k report."""
    return corpus.documents(spark, sf_dir).where("status = 'active' and source_name <> 'src0'").select("document_id", "title", "created_s").orderBy(F.desc("created_s"), "document_id").limit(20)


@query(with_sql("docs", then="""SELECT course, count(*) AS documents, array_to_string(list_sort(list_distinct(list(lower(source_name))))[1:24], ',') AS aliases FROM docs GROUP BY course"""))
def course_aliases(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).groupBy("course", F.lower("source_name").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("course").orderBy("alias"))
    return d.withColumn("r", rank).groupBy("course").agg(F.sum("n").alias("documents"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 24, F.struct("r", "alias")))), lambda x: x["alias"]), ",").alias("aliases"))


@query(with_sql("docs", then="""SELECT source_name, count(*) AS fetched, count_if(len(text) < 200) AS short, count_if(regexp_matches(title, '^[^ ]*$')) AS one_word_titles, CASE WHEN count(*) < 5 THEN 'FAIL' WHEN count_if(len(text) < 200) * 10 > count(*) THEN 'FAIL' ELSE 'PASS' END AS gate,
    array_to_string(list_filter([CASE WHEN count(*) < 5 THEN 'too_few_pages' END, CASE WHEN count_if(len(text) < 200) * 10 > count(*) THEN 'short_pages' END], lambda x: x IS NOT NULL), ',') AS reasons FROM docs GROUP BY 1"""))
def activation_gate(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).groupBy("source_name").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.length("text") < 200).alias("short"), F.count_if(F.col("title").rlike("^[^ ]*$")).alias("one_word_titles"))
    reasons = F.array_compact(F.array(F.when(F.col("fetched") < 5, "too_few_pages"), F.when(F.col("short") * 10 > F.col("fetched"), "short_pages")))
    return d.select("*", F.when(F.size(reasons) > 0, "FAIL").otherwise("PASS").alias("gate"), F.array_join(reasons, ",").alias("reasons"))


@query(r"""SELECT conv_id, count(*) AS answers, count_if(regexp_matches(text, '\{[^{}]*:[^{}]*\}')) AS raw_dumps, count_if(len(regexp_extract_all(text, '(?m)^[-*] ')) > 5) AS long_lists, count_if(len(text) < 20) AS fallbacks FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def evidence_log_warnings(spark, sf_dir):
    t, x = corpus.table(spark, sf_dir, "conversations").where("role = 'assistant'"), F.col("text")
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if(x.rlike(r"\{[^{}]*:[^{}]*\}")).alias("raw_dumps"), F.count_if(F.regexp_count(x, F.lit("(?m)^[-*] ")) > 5).alias("long_lists"), F.count_if(F.length(x) < 20).alias("fallbacks"))


@query(with_sql("lines", then="""SELECT document_id, max(CASE WHEN line_no = 0 AND len(line) < 5 THEN 1 ELSE 0 END) AS short_title, count(*) - count(DISTINCT line) AS repeated_lines, max(CASE WHEN regexp_matches(line, '[^ ]{40,}') THEN 1 ELSE 0 END) AS glued, max(CASE WHEN regexp_matches(line, '\\.(md|txt|json)( |$)') THEN 1 ELSE 0 END) AS file_name FROM lines GROUP BY 1"""))
def ingest_bad_signs(spark, sf_dir):
    per = corpus.lines(spark, sf_dir).groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    flag = lambda c: F.max(c.cast("int"))
    return per.groupBy("document_id").agg(flag((F.col("first") == 0) & (F.length("line") < 5)).alias("short_title"), F.sum(F.col("n") - 1).alias("repeated_lines"), flag(F.col("line").rlike("[^ ]{40,}")).alias("glued"), flag(F.col("line").rlike(r"\.(md|txt|json)( |$)")).alias("file_name"))


@query("""WITH k AS (SELECT conv_id, turn, role, md5(text) AS m, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS exchange FROM conversations)
    SELECT conv_id, exchange, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM k GROUP BY 1, 2""")
def conversation_sessions(spark, sf_dir):
    """A new exchange starts at each user turn."""
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "m").rowsBetween(Window.unboundedPreceding, 0)
    t = corpus.table(spark, sf_dir, "conversations").withColumn("m", F.md5("text"))
    t = t.withColumn("exchange", F.sum((F.col("role") == "user").cast("int")).over(along))
    return t.groupBy("conv_id", "exchange").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


_SLUG = "lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]+)$', 1))"


@query(f"SELECT page_id, {_SLUG} AS slug, count(*) OVER (PARTITION BY {_SLUG}) AS pages FROM pages")
def canonical_collisions(spark, sf_dir):
    """How many pages share each page's last path part; counted by group and joined back, so a frequent part needs no large window."""
    slug = F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), "([^/]+)$", 1))
    p = corpus.table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"))
    return p.join(p.groupBy("slug").agg(F.count(F.lit(1)).alias("pages")), "slug")


@query(r"""WITH t AS (SELECT source, unnest(list_distinct(regexp_extract_all(text, '[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Za-z0-9]+(?:[./][A-Za-z0-9]+)+|v[0-9]+(?:\.[0-9]+)+'))) AS term FROM documents),
    g AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL) SELECT source, term, n AS observations, round(least(0.52::DOUBLE + least(0.025::DOUBLE * n, 0.18) + 0.08::DOUBLE, 0.95), 4) AS confidence FROM g""")
def glossary_candidates(spark, sf_dir):
    """Code-shaped terms of each source with a confidence from the number of observations."""
    t = corpus.table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.EXACT), F.lit(0)))).alias("term"))
    g = t.groupBy("source", "term").agg(F.count(F.lit(1)).alias("observations"))
    return g.withColumn("confidence", F.round(F.least(F.lit(0.52) + F.least(0.025 * F.col("observations"), F.lit(0.18)) + 0.08, F.lit(0.95)), 4))


@query(r"""SELECT source, count(*) AS documents, count_if(quality = 0) AS bad, count_if(toxic = 1) AS toxic, round(count_if(quality = 0) / count(*), 6) AS bad_share FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def labelled_quality(spark, sf_dir):
    """Gold labels by source."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "source").join(corpus.table(spark, sf_dir, "labels"), "doc_id")
    out = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return out.withColumn("bad_share", F.round(F.col("bad") / F.col("documents"), 6))


_SUGGESTED = r"""p AS (SELECT page_id, page_id * 3600 AS ts, regexp_replace(trim(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '[^a-z0-9]+', '_', 'g'), '_'), '_(docs|documentation)$', '') AS service_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS url FROM pages),
    o AS (SELECT * FROM p WHERE page_id % 5 = 0), n AS (SELECT service_id, url, count(*) AS suggestions, min(ts) AS first_s FROM p WHERE page_id % 5 <> 0 OR page_id % 15 = 0 GROUP BY ALL), l AS (SELECT service_id, max(ts) AS last FROM o GROUP BY 1),
    m AS (SELECT n.*, last, EXISTS (SELECT 1 FROM o WHERE o.service_id = n.service_id AND o.url = n.url) AS held FROM n LEFT JOIN l USING (service_id)), f AS (SELECT *, row_number() OVER (PARTITION BY service_id, held ORDER BY first_s, url) AS r FROM m)"""


@query(f"WITH {_SUGGESTED} SELECT service_id, url, suggestions, first_s, CASE WHEN held THEN 'reused' WHEN coalesce(first_s - last < 86400, false) OR r > 1 THEN 'cooling' ELSE 'pending' END AS outcome FROM f")
def suggestion_upserts(spark, sf_dir):
    """Suggestions against stored ones (every fifth page): reused, cooling for a day, or pending."""
    p = corpus.table(spark, sf_dir, "pages").select("page_id", T.url_domain(F.col("url")).alias("service_id"), "url", (F.col("page_id") * 3600).alias("ts"))
    return suggestions.upserted(p.where("page_id % 5 = 0"), p.where("page_id % 5 <> 0 or page_id % 15 = 0"), 86400)


_KEY = "trim(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""WITH s AS (SELECT page_id, {_KEY} AS service, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS u FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY service, u ORDER BY page_id) AS r FROM s)
    SELECT service, u AS url, count(*) AS suggestions, min(page_id) AS first_page, CASE WHEN count(*) > 1 THEN 'reused' ELSE 'pending' END AS status FROM f GROUP BY service, u""")
def upsert_suggestion(spark, sf_dir):
    """Suggestions by normalised (service, url): the first is pending, later ones reuse it."""
    p = corpus.table(spark, sf_dir, "pages")
    url = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "")
    service = F.btrim(F.regexp_replace(T.url_domain(F.col("url")), "[^a-z0-9]+", "_"), F.lit("_"))
    out = p.groupBy(service.alias("service"), url.alias("url")).agg(F.count(F.lit(1)).alias("suggestions"), F.min("page_id").alias("first_page"))
    return out.withColumn("status", F.when(F.col("suggestions") > 1, "reused").otherwise("pending"))


@query(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, lower(url) AS u FROM pages), s AS (SELECT *, CASE WHEN contains(u, 'docs') OR contains(u, 'guide') THEN 3 ELSE 0 END + CASE WHEN contains(u, 'api') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(u, '^https?://[^/]+/?$') THEN 4 ELSE 0 END AS score FROM p)
    SELECT host, page_id, score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS r FROM s) WHERE r = 1""")
def best_docs_result(spark, sf_dir):
    """Each host's best page by selection score; the earliest wins ties."""
    p = corpus.table(spark, sf_dir, "pages").withColumn("host", T.url_domain(F.col("url"))).withColumn("u", F.lower("url"))
    has = lambda x: F.contains("u", F.lit(x))
    score = F.when(has("docs") | has("guide"), 3).otherwise(0) + F.when(has("api"), 2).otherwise(0) - F.when(F.col("u").rlike("^https?://[^/]+/?$"), 4).otherwise(0)
    best = p.withColumn("score", score).groupBy("host").agg(F.max(F.struct("score", (-F.col("page_id")).alias("p"))).alias("b"))
    return best.select("host", (-F.col("b.p")).alias("page_id"), "b.score")
