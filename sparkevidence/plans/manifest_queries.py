"""Queries of baseline manifests over two states of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.operators import manifests
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query

_DEPTH = 2
_STATES = """old AS (SELECT doc_id, source, lang, n_chars, text FROM documents WHERE doc_id % 97 <> 5), new AS (SELECT doc_id, source, CASE WHEN doc_id % 53 = 0 THEN NULL ELSE lang END AS lang, n_chars, CASE WHEN doc_id % 41 = 0 THEN text || ' ' ELSE text END AS text FROM documents WHERE doc_id % 89 <> 7)"""


def _states(spark, sf_dir):
    """The documents before and after some were added, removed and changed; an access token beside them has no say."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    old = d.where("doc_id % 97 <> 5").withColumn("access_token", F.lit("a"))
    text = F.when(F.col("doc_id") % 41 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    new = d.where("doc_id % 89 <> 7").withColumns({"lang": F.when(F.col("doc_id") % 53 != 0, F.col("lang")), "text": text, "access_token": F.lit("b")})
    return old, new


def _manifests(spark, sf_dir):
    return [manifests.manifest(df, "source", "doc_id", _DEPTH) for df in _states(spark, sf_dir)]


_DIGEST = "sha256(doc_id || chr(31) || coalesce(lang, chr(0)) || chr(31) || n_chars || chr(31) || source || chr(31) || text)"


@query(f"""WITH {_STATES}, r AS (SELECT source, substring(sha256(doc_id::VARCHAR), 1, 2) AS n2, {_DIGEST} AS digest FROM old),
    l2 AS (SELECT source, n2 AS node, count(*) AS rows, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM r GROUP BY ALL),
    l1 AS (SELECT source, substring(node, 1, 1) AS node, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(node || digest, '' ORDER BY node)) AS digest FROM l2 GROUP BY source, substring(node, 1, 1)),
    l0 AS (SELECT source, '' AS node, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(node || digest, '' ORDER BY node)) AS digest FROM l1 GROUP BY source)
    SELECT source, 2 AS level, node, rows, digest FROM l2 UNION ALL SELECT source, 1, node, rows, digest FROM l1 UNION ALL SELECT source, 0, node, rows, digest FROM l0""")
def manifest_tree(spark, sf_dir):
    """All nodes of the first state's Merkle trees, one for each source."""
    return _manifests(spark, sf_dir)[0][0]


@query(f"""WITH {_STATES} SELECT coalesce(o.source, n.source) AS source, doc_id, CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed' ELSE 'modified' END AS drift
    FROM old o FULL JOIN new n USING (doc_id) WHERE o.source IS NULL OR n.source IS NULL OR o.lang IS DISTINCT FROM n.lang OR o.text <> n.text""")
def manifest_drift(spark, sf_dir):
    """Rows that differ between both states, found by descending their trees; the SQL compares all rows."""
    old, new = _manifests(spark, sf_dir)
    return manifests.drift(old, new, "source", "doc_id", _DEPTH)


@query(f"""WITH {_STATES}, d AS (SELECT coalesce(o.source, n.source) AS source, count(*) AS moved FROM old o FULL JOIN new n USING (doc_id) WHERE o.source IS NULL OR n.source IS NULL OR o.lang IS DISTINCT FROM n.lang OR o.text <> n.text GROUP BY 1),
    p AS (SELECT source, count(*) FILTER (WHERE doc_id % 7 = 0) AS actions FROM old GROUP BY 1), e AS (SELECT source, count(*) AS n FROM old GROUP BY 1), x AS (SELECT source, actions, moved, n % 5 = 0 AS bad FROM p JOIN e USING (source) LEFT JOIN d USING (source)),
    y AS (SELECT source, actions, list_filter([CASE WHEN bad THEN 'manifest_invalid' END, CASE WHEN moved > 0 THEN 'drifted' END, CASE WHEN actions = 0 THEN 'nothing_to_do' END], lambda r: r IS NOT NULL) AS r FROM x)
    SELECT source, actions, array_to_string(r, ',') AS reasons, len(r) = 0 AS ready FROM y""")
def execution_gates(spark, sf_dir):
    """Which sources may be worked on: every seventh document is planned, the expected count of every source whose rows are divisible by
    five is off by one."""
    old, new = _manifests(spark, sf_dir)
    roots = old[0].where("level = 0")
    expected = roots.select("source", (F.col("rows") + (F.col("rows") % 5 == 0).cast("int")).alias("rows"), "digest")
    plan = _states(spark, sf_dir)[0].select("source", F.when(F.col("doc_id") % 7 == 0, "new_version").otherwise("skip").alias("action"))
    out = manifests.execution_gates(plan, manifests.verified(old[0], "source", expected), manifests.drift(old, new, "source", "doc_id", _DEPTH), "source")
    return out.withColumn("reasons", F.array_join("reasons", ","))
