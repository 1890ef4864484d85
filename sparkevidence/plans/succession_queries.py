"""Queries of successors and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import succession
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query

#: Keys by id, of which every third belongs to both sides, every third moved to another folder, the rest lost or new.
_SIDES = f"""old AS (SELECT source || '/p' || doc_id % 3 || '/' || doc_id // 2 AS document_key, split_part(text, chr(10), 1) AS title, sha256(text) AS content_hash FROM documents WHERE doc_id % 5 <> 0),
    new AS (SELECT source || '/' || CASE WHEN doc_id % 3 = 1 THEN 'moved' ELSE 'p' || doc_id % 3 END || '/' || doc_id // 2 AS document_key, split_part(text, chr(10), 1) AS title, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 7 <> 0)"""
_FEATURES = f"""SELECT DISTINCT document_key AS k, nullif(array_to_string(t, ' '), '') AS title, p[-1] AS last, CASE WHEN len(p) >= 2 THEN p[-2] || '/' || p[-1] END AS suffix, list_distinct(t) AS tokens FROM (SELECT document_key, regexp_extract_all(lower(title), '{T.TOKEN}') AS t, list_filter(string_split(lower(document_key), '/'), lambda x: x <> '') AS p FROM X)"""
_PAIRS = f"""gone AS (SELECT document_key, title FROM old WHERE document_key NOT IN (SELECT document_key FROM new)), came AS (SELECT document_key, title FROM new WHERE document_key NOT IN (SELECT document_key FROM old)),
    m AS ({_FEATURES.replace("FROM X", "FROM gone")}), f AS ({_FEATURES.replace("FROM X", "FROM came")}),
    s AS (SELECT m.k AS document_key, f.k AS successor, max(CASE WHEN m.title = f.title THEN 2 ELSE 0 END + CASE WHEN m.last = f.last THEN 1 ELSE 0 END + CASE WHEN m.suffix = f.suffix THEN 1 ELSE 0 END
        + CASE WHEN m.title IS DISTINCT FROM f.title AND len(m.tokens) > 0 AND len(list_intersect(m.tokens, f.tokens)) >= 0.67::DOUBLE * len(list_distinct(list_concat(m.tokens, f.tokens))) - 1e-9 THEN 1 ELSE 0 END) AS signals FROM m, f WHERE m.k <> f.k GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY signals DESC, successor) AS rank FROM s WHERE signals >= 2)"""


def _sides(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").withColumn("title", F.element_at(F.split("text", "\n"), 1))
    half, third = F.floor(F.col("doc_id") / 2).cast("string"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))
    old = d.where("doc_id % 5 <> 0").select(F.concat_ws("/", "source", third, half).alias("document_key"), "title", F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 7 <> 0").select(F.concat_ws("/", "source", F.when(F.col("doc_id") % 3 == 1, "moved").otherwise(third), half).alias("document_key"), "title", F.sha2(text, 256).alias("content_hash"))
    return old, new


@query(f"WITH {_SIDES}, {_PAIRS} SELECT document_key, successor, signals, rank FROM c WHERE rank <= 5")
def ranked_successors(spark, sf_dir):
    """The five best successors of each missing key, by blocks; the SQL tries all pairs."""
    old, new = _sides(spark, sf_dir)
    gone, came = old.join(new, "document_key", "left_anti"), new.join(old, "document_key", "left_anti")
    return succession.successor_candidates(gone, came)


@query(f"""WITH {_SIDES}, {_PAIRS}, o AS (SELECT document_key, count(*) AS n, max(content_hash) AS h FROM old GROUP BY 1), w AS (SELECT document_key, count(*) AS n, max(content_hash) AS h FROM new GROUP BY 1),
    b AS (SELECT document_key, o.n AS a, w.n AS b, o.h AS oh, w.h AS nh FROM o FULL JOIN w USING (document_key)), t AS (SELECT regexp_replace(lower(document_key), '/+$', '') AS p, count(*) AS twins FROM b GROUP BY 1),
    best AS (SELECT *, count(*) OVER (PARTITION BY successor) AS wanted FROM c WHERE rank = 1)
    SELECT b.document_key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL AND successor IS NOT NULL THEN 'replaced' WHEN b IS NULL THEN 'missing' WHEN oh = nh THEN 'unchanged' ELSE 'changed' END AS class, successor, signals,
    array_to_string(list_filter([CASE WHEN a > 1 THEN 'duplicate_active_key' END, CASE WHEN b > 1 THEN 'duplicate_discovered_key' END, CASE WHEN twins > 1 THEN 'key_collision' END, CASE WHEN wanted > 1 THEN 'successor_wanted_twice' END], lambda x: x IS NOT NULL), ',') AS blockers
    FROM b JOIN t ON p = regexp_replace(lower(b.document_key), '/+$', '') LEFT JOIN best USING (document_key)""")
def reconciliation(spark, sf_dir):
    """Five classes of keys with successors and blockers."""
    return succession.reconciliation(*_sides(spark, sf_dir)).withColumn("blockers", F.array_join("blockers", ","))
