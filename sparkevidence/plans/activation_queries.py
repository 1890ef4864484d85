"""Queries of source activation over the stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import activation, lifecycle
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query

#: Hosts are sources without these first labels; only such domains are allowed.
_SOURCE = "^(m|www|blog)[.]"
_ALLOWED = "[.]example[.](com|org)$"


def _inputs(spark, sf_dir):
    """Pages, their allowed sources, what of them is stored (every third as it is, every third in two older versions), and what was tried."""
    pages = corpus.table(spark, sf_dir, "pages")
    source = F.regexp_replace(T.url_domain(F.col("url")), _SOURCE, "")
    named = pages.withColumn("source", source)
    allowed = named.where(F.col("source").rlike(_ALLOWED)).select("source").distinct()
    arrived = activation.incoming(pages, source, allowed)
    third = F.pmod(F.conv(F.substring(F.sha2("document_key", 256), 1, 8), 16, 10).cast("long"), F.lit(3))
    same = arrived.where(third == 0).select("source", "document_key", F.lit(1).alias("version"), F.lit("active").alias("status"), "content_hash", "signature")
    older = arrived.where(third == 1).select("source", "document_key", F.explode(F.array(F.struct(F.lit(1).alias("version"), F.lit("archived").alias("status")), F.struct(F.lit(2).alias("version"), F.lit("active").alias("status")))).alias("v"), F.lit("other").alias("content_hash"), "signature")
    stored = same.unionByName(older.select("source", "document_key", "v.version", "v.status", "content_hash", "signature"))
    fetched = named.groupBy("source").agg(F.count_distinct(T.normalize_url(F.col("url"))).alias("pages"))
    return arrived, stored, allowed, fetched


@query(r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(m|www|blog)[.]', '') AS source, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS p FROM pages WHERE strlen(html) <= 2000000),
    k AS (SELECT source, source || '/' || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-zA-Z]+://[^/]*/?', '') AS document_key FROM p WHERE regexp_matches(source, '[.]example[.](com|org)$') AND regexp_matches(url, '^https?://') AND (h = source OR ends_with(h, '.' || source))
        AND NOT list_has_any(string_split(p, '/'), ['login', 'signin', 'admin', 'account', 'settings', 'logout']) AND NOT regexp_matches(p, '(?i)\.(png|jpe?g|gif|svg|pdf|zip|gz|tar|mp4|mp3|exe|css|js|woff2?)$')),
    t AS (SELECT DISTINCT source, document_key, ('0x' || substring(sha256(document_key), 1, 8))::BIGINT % 3 AS t FROM k)
    SELECT source, document_key, CASE t WHEN 0 THEN 'skip' WHEN 1 THEN 'new_version' ELSE 'new' END AS action, CASE t WHEN 1 THEN 3 ELSE 1 END AS version FROM t""")
def activation_plan(spark, sf_dir):
    """What activation would do with each page of each allowed source."""
    arrived, stored, _, _ = _inputs(spark, sf_dir)
    return arrived.select("source", "document_key").join(lifecycle.plan_ingest(arrived, stored), "document_key").select("source", "document_key", "action", "version")


@query()
def activate_sources(spark, sf_dir):
    """All allowed sources activated in one job: counts, gate and status of each; tests hold what changes against the report."""
    return activation.activate(*_inputs(spark, sf_dir)).report
