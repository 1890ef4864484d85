"""Queries over sources, versions and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import urls
from sparkevidence.operators import lifecycle
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.sources import pages as P


@query(r"""SELECT page_id, trim(regexp_replace(title0, '\s+', ' ', 'g')) AS title, n_h1, n_links FROM (SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS title0, len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, len(regexp_extract_all(html, '<a [^>]*href="')) AS n_links FROM pages WHERE strlen(html) <= 2000000)""")
def extract_pages(spark, sf_dir):
    """Stored pages to title, headings and links."""
    out = P.extract_pages(P.screened(corpus.table(spark, sf_dir, "pages")))
    return out.select("page_id", "title", F.size("headings").alias("n_h1"), F.size("links").alias("n_links"))


@query()
def extract_page_text(spark, sf_dir):
    """The structured text of each stored page; tests hold the parser against literal pages."""
    return P.extract_pages(P.screened(corpus.table(spark, sf_dir, "pages"))).select("page_id", "structured_text")


@query(r"""SELECT page_id, regexp_matches(url, '^https?://') AND (h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org')
    AND NOT list_has_any(string_split(p, '/'), ['login', 'signin', 'admin', 'account', 'settings', 'logout']) AND NOT regexp_matches(p, '(?i)\.(png|jpe?g|gif|svg|pdf|zip|gz|tar|mp4|mp3|exe|css|js|woff2?)$') AS allowed
    FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS p FROM pages)""")
def url_allowed(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages")
    return p.select("page_id", P.url_allowed(F.col("url"), F.array(F.lit("example.com"), F.lit("example.org"))).alias("allowed"))


@query("SELECT page_id, strlen(html) AS bytes FROM pages WHERE strlen(html) <= 2000000")
def scan_page_snapshot(spark, sf_dir):
    return P.screened(corpus.table(spark, sf_dir, "pages")).select("page_id", F.octet_length("html").cast("long").alias("bytes"))


@query(with_sql("docs", then="SELECT document_key, arg_max(document_id, version) AS document_id, max(version) AS version, arg_max(status, version) AS status FROM docs GROUP BY document_key"))
def latest_version(spark, sf_dir):
    return lifecycle.latest_versions(corpus.documents(spark, sf_dir))


@query(with_sql("docs", then="SELECT document_key, document_id, version, status FROM docs WHERE status = 'active'"))
def active_version(spark, sf_dir):
    return lifecycle.active_versions(corpus.documents(spark, sf_dir))


@query(with_sql("docs", "chunks", then="SELECT c.document_id, c.chunk_index FROM chunks c SEMI JOIN (SELECT document_id FROM docs WHERE status = 'active') d ON c.document_id = d.document_id"))
def active_only(spark, sf_dir):
    """Chunks of active documents."""
    active = corpus.documents(spark, sf_dir).where("status = 'active'").select("document_id")
    return corpus.chunks(spark, sf_dir).select("document_id", "chunk_index").join(active, "document_id", "left_semi")


def _stored(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    return d.where("document_id % 5 <> 0").select("document_key", "version", "status", F.sha2("text", 256).alias("content_hash"), F.lit("p1").alias("signature"))


def _incoming(spark, sf_dir):
    """Every key's latest text; every third key with a changed signature."""
    d = corpus.documents(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    d = d.groupBy("document_key").agg(F.max(F.struct("version", "document_id", "content_hash")).alias("m"))
    signature = F.when(F.col("m.document_id") % 3 == 0, "p2").otherwise("p1")
    return d.select("document_key", "m.content_hash", signature.alias("signature"))


_INGEST = """stored AS (SELECT document_key, version, status, sha256(text) AS content_hash, 'p1' AS signature FROM docs WHERE document_id % 5 <> 0),
    incoming AS (SELECT document_key, sha256(arg_max(text, version)) AS content_hash, CASE WHEN arg_max(document_id, version) % 3 = 0 THEN 'p2' ELSE 'p1' END AS signature FROM docs GROUP BY document_key),
    latest AS (SELECT document_key, max(version) AS last FROM stored GROUP BY document_key),
    active AS (SELECT document_key, max(version) AS v, arg_max(content_hash, version) AS h, arg_max(signature, version) AS s FROM stored WHERE status = 'active' GROUP BY document_key),
    plan AS (SELECT i.document_key, CASE WHEN h = content_hash AND s = signature THEN 'skip' WHEN last IS NULL THEN 'new' ELSE 'new_version' END AS action,
        CASE WHEN h = content_hash AND s = signature THEN v ELSE coalesce(last, 0) + 1 END AS version, content_hash, signature FROM incoming i LEFT JOIN latest USING (document_key) LEFT JOIN active USING (document_key))"""


@query(with_sql("docs", then=f", {_INGEST} SELECT document_key, action, version FROM plan"))
def plan_ingest(spark, sf_dir):
    return lifecycle.plan_ingest(_incoming(spark, sf_dir), _stored(spark, sf_dir))


@query(with_sql("docs", then=f""", {_INGEST} SELECT s.document_key, s.version, CASE WHEN p.document_key IS NOT NULL AND status = 'active' THEN 'archived' ELSE status END AS status, s.content_hash, s.signature
    FROM stored s LEFT JOIN (SELECT document_key FROM plan WHERE action <> 'skip') p USING (document_key) UNION ALL SELECT document_key, version, 'active', content_hash, signature FROM plan WHERE action <> 'skip'"""))
def apply_ingest(spark, sf_dir):
    return lifecycle.apply_ingest(_stored(spark, sf_dir), _incoming(spark, sf_dir))


@query(with_sql("docs", then=f", {_INGEST} SELECT action, count(*) AS n FROM plan GROUP BY action"))
def ingest_run_stats(spark, sf_dir):
    return lifecycle.plan_ingest(_incoming(spark, sf_dir), _stored(spark, sf_dir)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("docs", then="""SELECT document_id, document_key, version + (document_id % 2)::INT AS version, coalesce(status = 'active' AND document_id % 2 = 0, false) AS done FROM docs"""))
def archive_exact(spark, sf_dir):
    """Requests whose version is off by one for odd ids, so that half of them must not take effect."""
    d = corpus.documents(spark, sf_dir)
    return lifecycle.archive_exact(d, d.select("document_id", "document_key", (F.col("version") + F.col("document_id") % 2).cast("int").alias("version")))


_SNAPSHOTS = """old AS (SELECT source || '/' || doc_id AS document_key, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0),
    new AS (SELECT source || '/' || doc_id AS document_key, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 6 <> 0)"""


def _snapshots(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").withColumn("document_key", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    old = d.where("doc_id % 7 <> 0").select("document_key", F.sha2("text", 256).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, d.where("doc_id % 6 <> 0").select("document_key", F.sha2(changed, 256).alias("content_hash"))


@query(f"""WITH {_SNAPSHOTS} SELECT document_key, CASE WHEN old.content_hash IS NULL THEN 'added' WHEN new.content_hash IS NULL THEN 'missing' WHEN old.content_hash = new.content_hash THEN 'unchanged' ELSE 'changed' END AS class
    FROM old FULL JOIN new USING (document_key)""")
def reconcile(spark, sf_dir):
    return lifecycle.snapshot_classes(*_snapshots(spark, sf_dir))


@query(f"""WITH {_SNAPSHOTS} SELECT document_key, CASE WHEN old.content_hash IS NULL THEN 'added' WHEN new.content_hash IS NULL THEN 'removed' ELSE 'modified' END AS drift
    FROM old FULL JOIN new USING (document_key) WHERE old.content_hash IS DISTINCT FROM new.content_hash""")
def drift(spark, sf_dir):
    return lifecycle.row_drift(*_snapshots(spark, sf_dir), "document_key")


@query(f"WITH {_SNAPSHOTS} SELECT document_key, 'discovered_only' AS side FROM new ANTI JOIN old USING (document_key) UNION ALL SELECT document_key, 'active_only' FROM old ANTI JOIN new USING (document_key)")
def key_differences(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    only = lambda a, b, side: a.join(b, "document_key", "left_anti").select("document_key", F.lit(side).alias("side"))
    return only(new, old, "discovered_only").unionByName(only(old, new, "active_only"))


@query(f"WITH {_SNAPSHOTS} SELECT document_key FROM old INTERSECT SELECT document_key FROM new")
def key_intersection(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return old.select("document_key").intersect(new.select("document_key"))


@query("""SELECT source, count(*) AS rows, CAST(sum(('0x' || substring(sha256(doc_id || chr(31) || coalesce(lang, chr(0)) || chr(31) || n_chars || chr(31) || coalesce(source, chr(0)) || chr(31) || text), 1, 8))::BIGINT) AS BIGINT) AS digest FROM documents GROUP BY source""")
def table_fingerprint(spark, sf_dir):
    return lifecycle.table_fingerprint(corpus.table(spark, sf_dir, "documents"), ["source"])


@query("""SELECT 'documents' AS "table", 'n_chars >= 0' AS rule, count_if(NOT n_chars >= 0) AS n FROM documents UNION ALL SELECT 'documents', 'text not empty', count_if(text = '') FROM documents
    UNION ALL SELECT 'labels', 'quality in 0, 1', count_if(quality NOT IN (0, 1)) FROM labels UNION ALL SELECT 'conversations', 'known role', count_if(role NOT IN ('user', 'assistant', 'tool')) FROM conversations
    UNION ALL SELECT 'labels', 'document exists', count(*) FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'documents', 'unique text', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def constraint_violations(spark, sf_dir):
    d, labels, talk = (corpus.table(spark, sf_dir, t) for t in ("documents", "labels", "conversations"))
    orphans, copies = labels.join(d, "doc_id", "left_anti"), lifecycle.duplicates(d, "text")
    return lifecycle.violations([
        ("documents", "n_chars >= 0", d, F.col("n_chars") >= 0), ("documents", "text not empty", d, F.col("text") != ""), ("labels", "quality in 0, 1", labels, F.col("quality").isin(0, 1)),
        ("conversations", "known role", talk, F.col("role").isin("user", "assistant", "tool")), ("labels", "document exists", orphans, F.lit(False)), ("documents", "unique text", copies, F.lit(False)),
    ])


@query(with_sql("docs", then="SELECT title, count(*) AS n FROM docs WHERE status = 'active' GROUP BY title HAVING count(*) > 1"))
def duplicate_active_keys(spark, sf_dir):
    """Keys that several active rows share; here of rows that are stored under their title."""
    return lifecycle.duplicates(corpus.documents(spark, sf_dir).where("status = 'active'"), "title")


@query(with_sql("chunks", then="SELECT document_id, count(*) AS chunks FROM chunks GROUP BY document_id"))
def chunks_per_document(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(with_sql("chunks", "lines", then="""SELECT d.doc_id AS document_id, coalesce(c.chunks, 0) AS chunks, coalesce(l.lines, 0) AS lines, coalesce(c.chunks, 0) = (coalesce(l.lines, 0) + 7) // 8 AS as_declared FROM documents d
    LEFT JOIN (SELECT document_id, count(*) AS chunks FROM chunks GROUP BY 1) c ON c.document_id = d.doc_id LEFT JOIN (SELECT document_id, count(*) AS lines FROM lines GROUP BY 1) l ON l.document_id = d.doc_id"""))
def relationship_counts(spark, sf_dir):
    """Children of each document, counted and against what its lines call for."""
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    count = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    out = d.join(count(corpus.chunks(spark, sf_dir), "chunks"), "document_id", "left").join(count(corpus.lines(spark, sf_dir), "lines"), "document_id", "left").na.fill(0)
    return out.withColumn("as_declared", F.col("chunks") == F.floor((F.col("lines") + 7) / 8))


_LINKS = """links AS (SELECT source, doc_id AS url, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS target FROM documents UNION ALL SELECT source, doc_id, (doc_id * 3 + 1) % (SELECT count(*) FROM documents) FROM documents)"""


@query(f"""WITH RECURSIVE {_LINKS}, walk AS (SELECT source, doc_id AS url, 0 AS depth FROM documents WHERE doc_id % 50 = 0 UNION SELECT w.source, l.target, w.depth + 1 FROM walk w JOIN (SELECT url, target FROM links) l ON l.url = w.url WHERE w.depth < 3),
    seen AS (SELECT source, url, min(depth) AS depth FROM walk GROUP BY source, url) SELECT source, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY depth, url) AS r FROM seen) WHERE r <= 100""")
def link_frontier(spark, sf_dir):
    """Three levels of links from every fiftieth document, at most 100 pages a source (the crawl limit)."""
    d = corpus.table(spark, sf_dir, "documents")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    pairs = d.select(F.col("doc_id").alias("url")).crossJoin(F.broadcast(n)).select("url", F.explode(F.array((F.col("url") * 7 + 3) % F.col("n"), (F.col("url") * 3 + 1) % F.col("n"))).alias("target"))
    starts = d.where("doc_id % 50 = 0").select("source", F.col("doc_id").alias("url"))
    return lifecycle.link_frontier(pairs, starts, 3, 100)


_HREF = """SELECT page_id, url, unnest(range(len(h))) AS link_no, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages WHERE strlen(html) <= 2000000)"""
#: On the given pages all references start at the root of their host.
_TARGETS = f"""targets AS (SELECT page_id, link_no, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS target FROM ({_HREF}))"""


@query(f"WITH {_TARGETS} SELECT * FROM targets")
def page_links(spark, sf_dir):
    """Every link of every stored page, resolved against the page."""
    return P.page_links(P.extract_pages(P.screened(corpus.table(spark, sf_dir, "pages"))))


@query(f"""WITH {_TARGETS}, page AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, regexp_replace(url, '#.*$', '') AS url FROM pages),
    starts AS (SELECT DISTINCT source, url, 0 AS depth FROM page), next AS (SELECT DISTINCT source, target AS url, 1 AS depth FROM targets JOIN page USING (page_id)),
    seen AS (SELECT * FROM starts UNION ALL SELECT * FROM next WHERE (source, url) NOT IN (SELECT (source, url) FROM starts))
    SELECT source, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY depth, url) AS r FROM seen) WHERE r <= 100""")
def page_frontier(spark, sf_dir):
    """The pages of each host and what their links lead to, breadth first, at most 100 addresses a host (the crawl limit)."""
    pages = P.extract_pages(P.screened(corpus.table(spark, sf_dir, "pages")))
    at = pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("source"), urls.without_fragment(F.col("url")).alias("url"))
    links = P.page_links(pages).select("page_id", "target").join(at, "page_id").select("source", "url", "target").distinct()
    return lifecycle.link_frontier(links, at.select("source", "url"), 2, 100)
