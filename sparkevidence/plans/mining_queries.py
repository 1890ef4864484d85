"""Glossary candidates mined from documents, chunks, pages and the turns of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import mining
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql

#: Terms that the glossary has already, in the demonstration.
KNOWN = ("e.g", "and/or", "MAX_SIZE", "v1.0")
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_EXACT = T.EXACT.replace("++", "+")
_OBSERVED = [
    ("document", "source", "split_part(text, chr(10), 1)", "text", "0.55", False, "documents"), ("chunk", "source_name", "heading", "content", "0.5", False, "chunks"),
    ("page", _HOST, "regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]*)', 1)", "url", "0.52", False, "pages"), ("turn", "'conversations'", "array_to_string(string_split(text, ' ')[1:3], ' ')", "text", "0.48", True, "conversations WHERE role = 'user'"),
]
_SPACED = "trim(regexp_replace(X, '[ \\t\\n]+', ' ', 'g'))"
_OBS = " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce({s}, 'unknown') AS source, rtrim(substring({_SPACED.replace('X', f'lower({t})')}, 1, 80)) AS topic, {x} AS text, {b}::DOUBLE AS base, {f'substring({_SPACED.replace("X", x)}, 1, 80)' if p else 'NULL'} AS phrase FROM {table}" for k, s, t, x, b, p, table in _OBSERVED)
_LIST = lambda name, where, most: f"{name} AS (SELECT source, topic, list(term ORDER BY r) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY n DESC, term) AS r FROM (SELECT source, topic, term, count(*) AS n FROM {where} GROUP BY ALL)) WHERE r <= {most} GROUP BY ALL)"
_CONFIG = "regexp_matches(term, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$')"


def observations(spark, sf_dir):
    d, c, p, t = corpus.table(spark, sf_dir, "documents"), corpus.chunks(spark, sf_dir), corpus.table(spark, sf_dir, "pages"), corpus.table(spark, sf_dir, "conversations").where("role = 'user'")
    x = F.col
    return [
        mining.observation(d, "document", x("doc_id"), x("source"), F.element_at(F.split("text", "\n"), 1), x("text"), 0.55), mining.observation(c, "chunk", F.concat_ws("/", "document_id", "chunk_index"), x("source_name"), x("heading"), x("content"), 0.5),
        mining.observation(p, "page", x("page_id"), T.url_domain(x("url")), F.regexp_extract("url", "^[a-zA-Z]+://[^/]+/([^/?#]*)", 1), x("url"), 0.52), mining.observation(t, "turn", F.concat_ws("/", "conv_id", "turn"), F.lit("conversations"), F.array_join(F.slice(F.split("text", " "), 1, 3), " "), x("text"), 0.48, True),
    ]


@query(with_sql("chunks", then=f""", obs AS (SELECT * FROM ({_OBS}) WHERE topic <> ''), e0 AS (SELECT source, topic, unnest(list_distinct(regexp_extract_all(text, '{_EXACT}'))) AS term FROM obs),
    e AS (SELECT *, lower(term) IN ({", ".join(f"'{k.lower()}'" for k in KNOWN)}) AS known FROM e0), {_LIST("exact_terms", f"e WHERE NOT known AND NOT {_CONFIG}", 8)}, {_LIST("config_terms", f"e WHERE NOT known AND {_CONFIG}", 8)}, {_LIST("phrases", "(SELECT source, topic, phrase AS term FROM obs WHERE phrase <> '')", 6)},
    k AS (SELECT source, topic, count(DISTINCT lower(term)) AS known_terms FROM e WHERE known GROUP BY ALL), g AS (SELECT source, topic, count(*) AS observations, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(base) AS base FROM obs GROUP BY ALL),
    j AS (SELECT g.*, coalesce(exact_terms, []) AS xs, coalesce(config_terms, []) AS cs, coalesce(phrases, []) AS ps, coalesce(known_terms, 0) AS known_terms FROM g LEFT JOIN exact_terms USING (source, topic) LEFT JOIN config_terms USING (source, topic) LEFT JOIN phrases USING (source, topic) LEFT JOIN k USING (source, topic)),
    s AS (SELECT *, len(list_filter(list_concat(xs, cs), lambda t: regexp_matches(t, '{mining.SENSITIVE}'))) > 0 AS sensitive, regexp_matches(source, '{mining.UNREVIEWED}') OR len(list_filter(ps, lambda p: contains(p, chr(65533)) OR regexp_matches(p, '[ÃÂ][\\x{{80}}-\\x{{bf}}]'))) > 0 AS low FROM j WHERE len(xs) + len(cs) + len(ps) > 0)
    SELECT source, topic, observations, kinds, array_to_string(xs, ' ') AS exact_terms, array_to_string(cs, ' ') AS config_terms, array_to_string(ps, ' | ') AS phrases, known_terms, concat_ws(',', CASE WHEN sensitive THEN 'sensitive-review' END, CASE WHEN low THEN 'low-confidence' END) AS flags,
    CASE WHEN sensitive THEN 'sensitive-review' WHEN low THEN 'low-confidence' ELSE 'suggested' END AS status, round(least(base + least(0.025::DOUBLE * observations, 0.18::DOUBLE) + CASE WHEN len(xs) > 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN len(cs) > 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN len(ps) > 0 THEN 0.05::DOUBLE ELSE 0 END,
        CASE WHEN low THEN 0.58::DOUBLE WHEN sensitive THEN 0.88::DOUBLE ELSE 0.95::DOUBLE END), 4) AS confidence FROM s"""))
def mined_glossary(spark, sf_dir):
    """Candidates for the glossary from four kinds of observations."""
    known = spark.createDataFrame([(k,) for k in KNOWN], "term string")
    out = mining.candidates(observations(spark, sf_dir), known)
    return out.withColumns({"exact_terms": F.array_join("exact_terms", " "), "config_terms": F.array_join("config_terms", " "), "phrases": F.array_join("phrases", " | ")})
