"""Queries over text, chunks and terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import chunk_quality, markup, terms
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql

_Q = lambda xs: ", ".join("'" + x + "'" for x in xs)
_BOILER = _Q(T.BOILERPLATE)
_STOP = _Q(T.STOPWORDS)
_TOKENS = f"regexp_extract_all(lower(content), '{T.TOKEN}')"
_SIGNIFICANT = f"list_distinct(list_filter({_TOKENS}, lambda t: len(t) > 1 AND t NOT IN ({_STOP}) AND NOT regexp_matches(t, '^[0-9]+$')))"
_PROSE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, chr(160), ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_NORMAL = f"""trim(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '```'), lambda x, i: CASE WHEN i % 2 = 1 THEN {_PROSE} ELSE x END), '```'), ' ' || chr(10))"""


@query(f"""SELECT doc_id, {_NORMAL} AS normal, len(list_filter(string_split(text, chr(10)), lambda x: lower(trim(x)) IN ({_BOILER}))) AS boilerplate_lines,
    coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(substring(trim(regexp_replace(regexp_replace(x, '^[#*>\\- ]+', ''), '[ \\t]+', ' ', 'g')), 1, 160))), lambda x: len(x) >= 3)[1], '(untitled)') AS title FROM documents""")
def clean_corpus(spark, sf_dir):
    """Whole texts normalised, with their title and number of furniture lines."""
    d = corpus.table(spark, sf_dir, "documents")
    furniture = F.size(F.filter(F.split("text", "\n"), lambda x: F.lower(F.btrim(x)).isin(*T.BOILERPLATE)))
    return d.select("doc_id", T.normalize_text(F.col("text")).alias("normal"), furniture.alias("boilerplate_lines"), T.title_of(F.col("text"), F.lit("(untitled)")).alias("title"))


@query(f"""WITH d AS (SELECT doc_id, text AS content FROM documents)
    SELECT doc_id, len(regexp_extract_all(content, '{T.TOKEN}')) AS n_tokens, len({_SIGNIFICANT}) AS n_terms,
    array_to_string(list_sort(list_transform({_SIGNIFICANT}, lambda t: CASE WHEN len(t) >= 8 THEN substring(t, 1, 7) WHEN len(t) >= 6 THEN substring(t, 1, 5) ELSE t END)), ' ') AS roots FROM d""")
def tokenize_corpus(spark, sf_dir):
    """Token and term counts and the sorted stems of each document."""
    d = corpus.table(spark, sf_dir, "documents")
    significant = T.significant_terms(F.col("text"))
    return d.select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"), F.size(significant).alias("n_terms"), F.array_join(F.array_sort(F.transform(significant, T.root)), " ").alias("roots"))


@query("""SELECT doc_id, rtrim(substring(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), 1, 360)) AS section_summary, sha256(chr(0) || coalesce(lang, '') || chr(0) || coalesce(text, '')) AS content_hash,
    sha256(chr(0) || coalesce(source, '') || chr(0) || coalesce(lang, '') || chr(0) || 'v1' || chr(0) || coalesce(text, '')) AS ingestion_signature, substring(sha256(source || '/' || doc_id), 1, 16) AS identifier_hash FROM documents""")
def fingerprint_corpus(spark, sf_dir):
    """Summaries, content hashes and ingest signatures."""
    d = corpus.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", T.summarize(F.col("text"), 360).alias("section_summary"), T.content_hash(F.col("lang"), F.col("text")).alias("content_hash"),
        T.content_hash(F.col("source"), F.col("lang"), F.lit("v1"), F.col("text")).alias("ingestion_signature"), T.identifier_hash(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("identifier_hash"),
    )


def _redact_sql(x: str) -> str:
    for shape, instead in T.SECRETS:
        x = f"regexp_replace({x}, '{shape}', '{instead}', 'g')"
    return x


_SECRET_SQL = " OR ".join(f"regexp_matches(text, '{s}')" for s, _ in T.SECRETS)


@query(f"SELECT doc_id, {_redact_sql('text')} AS redacted, {_SECRET_SQL} AS has_secret FROM documents")
def redact_corpus(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.redact(F.col("text")).alias("redacted"), T.contains_secret(F.col("text")).alias("has_secret"))


@query("""SELECT doc_id, i - 1 AS sentence_no, s AS sentence FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(s) > 0) AS ss FROM documents),
    LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s)""")
def split_sentences(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query(with_sql("chunks", then=f"""SELECT document_id, chunk_index, heading, len(regexp_extract_all(content, '{T.TOKEN}')) AS n_tokens, md5(content) AS content_md5, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS part_index FROM chunks"""))
def number_chunks(spark, sf_dir):
    """Sections with headings, numbered over their document."""
    c = corpus.chunks(spark, sf_dir)
    part = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    return c.select("document_id", "chunk_index", "heading", T.count_tokens(F.col("content")).alias("n_tokens"), F.md5("content").alias("content_md5"), part.alias("part_index"))


_RAW = f"regexp_extract_all(content, '{T.TOKEN}')"
_SHAPED = ", ".join(f"list_transform(list_filter({_RAW}, lambda t: regexp_matches(t, '{s.replace('++', '+')}')), lambda t: lower(t)) AS raw{k}" for k, _, s in terms.RAW_SHAPES)
_TERMS_CTE = f"""terms0 AS (SELECT document_id, chunk_index, course, source_name, {_SHAPED}, unnest({_SIGNIFICANT}) AS term FROM chunks),
    terms AS (SELECT document_id, chunk_index, course, source_name, term, CASE {" ".join(f"WHEN list_contains(raw{k}, term) THEN {k}" for k, _, _ in terms.RAW_SHAPES)} ELSE 0 END AS shape FROM terms0)"""
_TYPE_SQL = r"""CASE WHEN regexp_matches(term, '^https?://') THEN 'url' WHEN regexp_matches(term, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') THEN 'config' WHEN regexp_matches(term, '^/[a-z0-9/_-]+$') THEN 'path'
    WHEN regexp_matches(term, '^[0-9]+([.][0-9]+)*$') THEN 'number' WHEN regexp_matches(term, '^[a-z0-9]+[.][a-z0-9.]+$') THEN 'file' WHEN regexp_matches(term, '^[A-Z]{2,6}$') THEN 'acronym' ELSE 'term' END"""
_STATS_CTE = f"""stats AS (SELECT term, count(DISTINCT document_id) AS document_frequency, count(*) AS chunk_frequency, count(DISTINCT nullif(course, '')) AS course_frequency,
    CASE {" ".join(f"WHEN max(shape) = {k} THEN '{n}'" for k, n, _ in terms.RAW_SHAPES)} ELSE {_TYPE_SQL} END AS term_type FROM terms GROUP BY term)"""
_ROOT_SQL = "CASE WHEN len(term) >= 8 THEN substring(term, 1, 7) WHEN len(term) >= 6 THEN substring(term, 1, 5) ELSE term END"


@query(with_sql("chunks", then=f", {_TERMS_CTE}, {_STATS_CTE} SELECT * FROM stats"))
def term_statistics(spark, sf_dir):
    return terms.term_statistics(corpus.chunks(spark, sf_dir))


@query(with_sql("chunks", then=f", {_TERMS_CTE} SELECT term, count(*) AS occurrences, count(DISTINCT source_name) AS sources FROM terms GROUP BY term"))
def explode_terms(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir).select(F.explode(T.significant_terms(F.col("content"))).alias("term"), "source_name")
    return rows.groupBy("term", "source_name").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("sources"))


@query(with_sql("chunks", then=f""", {_TERMS_CTE}, {_STATS_CTE} SELECT {_ROOT_SQL} AS root, arg_min(term, lpad(len(term)::VARCHAR, 9, '0') || term) AS term, count(*) AS terms, max(document_frequency) AS document_frequency,
    max(chunk_frequency) AS chunk_frequency, max(course_frequency) AS course_frequency, coalesce(min(CASE WHEN term_type <> 'term' THEN term_type END), 'term') AS term_type FROM stats GROUP BY 1"""))
def merge_terms_by_root(spark, sf_dir):
    return terms.merge_by_root(terms.term_statistics(corpus.chunks(spark, sf_dir)))


_WEIGHTS_CTE = """totals AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM chunks) AS m),
    shares AS (SELECT *, document_frequency / greatest(n, 1) AS ds, chunk_frequency / greatest(m, 1) AS cs FROM stats, totals),
    classed AS (SELECT *, CASE WHEN ds >= 0.35 OR cs >= 0.30 THEN 'common' WHEN ds >= 0.18 AND course_frequency <= 1 THEN 'course_common' WHEN document_frequency <= 1 OR ds <= 0.04 THEN 'rare_anchor'
        WHEN ds <= 0.12 THEN 'specific' ELSE 'medium' END AS frequency_class FROM shares),
    weights AS (SELECT term, document_frequency, chunk_frequency, course_frequency, term_type, round(ds, 6) AS doc_share, round(ln((n + 1)::DOUBLE / (document_frequency + 1)) + 1, 6) AS idf, frequency_class,
        round(least(CASE frequency_class WHEN 'common' THEN 0.24 WHEN 'course_common' THEN 0.38 WHEN 'medium' THEN 0.72 WHEN 'specific' THEN 1.05 ELSE 1.28 END::DOUBLE + CASE WHEN term_type <> 'term' THEN 0.16::DOUBLE ELSE 0 END, 1.6), 6) AS weight FROM classed)"""


def weighted_terms(spark, sf_dir, roots=None):
    c = corpus.chunks(spark, sf_dir)
    totals = corpus.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).crossJoin(c.agg(F.count(F.lit(1)).alias("m")))
    stats = terms.term_statistics(c, roots).crossJoin(F.broadcast(totals))  # one row
    return terms.with_weights(stats, F.col("n"), F.col("m")).drop("n", "m")


@query(with_sql("chunks", then=f", {_TERMS_CTE}, {_STATS_CTE}, {_WEIGHTS_CTE} SELECT * FROM weights"))
def term_weights(spark, sf_dir):
    return weighted_terms(spark, sf_dir)


@query(with_sql("chunks", then=f", {_TERMS_CTE}, {_STATS_CTE} SELECT term, document_frequency FROM stats ORDER BY document_frequency DESC, term LIMIT 200"))
def frequent_terms(spark, sf_dir):
    """The 200 terms in most documents, a top-k report."""
    return terms.term_statistics(corpus.chunks(spark, sf_dir)).select("term", "document_frequency").orderBy(F.desc("document_frequency"), "term").limit(200)


@query(f"""WITH t AS (SELECT doc_id AS document_id, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) AS term FROM documents),
    c AS (SELECT document_id, term, count(*) AS n FROM t WHERE term NOT IN ({_STOP}) AND len(term) > 1 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY ALL),
    r AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, term) AS rank, term, n FROM c) SELECT * FROM r WHERE rank <= 36""")
def top_keywords(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return terms.top_keywords(d)


@query(f"""WITH t AS (SELECT term, doc_id, lang, unnest([1]) AS one FROM (SELECT doc_id, lang, unnest({_SIGNIFICANT.replace("content", "text")}) AS term FROM documents))
    SELECT term, lang, doc_id AS document_id, rn FROM (SELECT term, lang, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id DESC) AS rn FROM t) WHERE rn <= 3""")
def ranked_examples(spark, sf_dir):
    """The three latest documents of each term."""
    d = corpus.table(spark, sf_dir, "documents").select(F.explode(T.significant_terms(F.col("text"))).alias("term"), "lang", F.col("doc_id").alias("document_id"))
    rn = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("document_id")))
    return d.withColumn("rn", rn).where("rn <= 3")


_TECH_SQL = "(" + " OR ".join(f"regexp_matches(content, '{s}')" for s in chunk_quality.TECHNICAL) + ")"
_WIDGET_SQL = "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in chunk_quality.WIDGETS) + ")"
_QUALITY_CTE = f"""q0 AS (SELECT *, {_TECH_SQL} AS technical, len(regexp_extract_all(content, '\\p{{L}}{{3,}}')) AS useful_words, len(list_filter(string_split(regexp_replace(content, '([.!?\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda p: right(p, 1) IN ('.', '!', '?') AND len(regexp_extract_all(p, '\\p{{L}}+')) >= 6)) > 0 AS descriptive,
    trim(content) = trim(heading) AS title_only, len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '#'))) * 2 > len(string_split(content, chr(10))) AS mostly_headings, {_WIDGET_SQL} AS widget,
    regexp_matches(content, '{markup.SIGNAL}') AS raw_html, len(regexp_extract_all(content, '[^ \\n]+')) < 8 AS very_short, len(content) > 12000 AS huge FROM chunks),
    q AS (SELECT *, useful_words < 5 AS no_useful_text, NOT technical AND (widget OR title_only OR mostly_headings OR (useful_words < 7 AND NOT descriptive)) AS low_value FROM q0)"""
_NOISE = "regexp_matches(content, '(?i)\\bprevious\\b[^\\n]+\\bnext\\b') OR " + " OR ".join(f"contains(lower(content), '{m}')" for m in chunk_quality.NAVIGATION)
_QUALITY_COLUMNS = "document_id, chunk_index, technical, useful_words, descriptive, title_only, mostly_headings, widget, raw_html, low_value, very_short, no_useful_text, huge"


@query(with_sql("chunks", then=f", {_QUALITY_CTE} SELECT {_QUALITY_COLUMNS} FROM q"))
def chunk_quality_flags(spark, sf_dir):
    return chunk_quality.with_quality(corpus.chunks(spark, sf_dir)).select(*_QUALITY_COLUMNS.split(", "))


@query(with_sql("chunks", then=f""", {_QUALITY_CTE}, k AS (SELECT *, max(NOT low_value) OVER (PARTITION BY document_id) AS any_kept FROM q)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS chunk_index, md5(content) AS content_md5 FROM k WHERE NOT low_value OR NOT any_kept"""))
def drop_low_value_chunks(spark, sf_dir):
    return chunk_quality.drop_low_value(corpus.chunks(spark, sf_dir)).select("document_id", "chunk_index", F.md5("content").alias("content_md5"))


@query(with_sql("chunks", then=f""", {_QUALITY_CTE}, a AS (SELECT source_name, count(*) AS chunks, count_if(raw_html) AS raw_html, count_if(trim(content) = '') AS empty, count_if(title_only) AS title_only, count_if(very_short) AS very_short,
    count_if(no_useful_text) AS no_useful_text, count_if(huge) AS huge, count_if(widget) AS widget, count_if(technical) AS technical, count_if(low_value) AS low_value FROM q GROUP BY source_name),
    s AS (SELECT *, round(title_only / chunks, 6) AS title_only_share, round(very_short / chunks, 6) AS very_short_share, round(no_useful_text / chunks, 6) AS useless_share FROM a)
    SELECT *, CASE WHEN raw_html > 0 OR empty > 0 THEN 'FAIL' WHEN title_only_share > 0.15 OR very_short_share > 0.25 OR useless_share > 0.15 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s"""))
def chunk_quality_report(spark, sf_dir):
    return chunk_quality.report(corpus.chunks(spark, sf_dir))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS bare, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS domain,
    lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^([a-zA-Z]+://[^/]*)', 1)) || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-zA-Z]+://[^/]*', '') AS normal_url FROM pages""")
def normalize_urls(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    return p.select("page_id", bare.alias("bare"), T.url_domain(F.col("url")).alias("domain"), T.normalize_url(F.col("url")).alias("normal_url"))


_ADDRESSED = "CASE WHEN document_id % 29 = 7 THEN NULL ELSE 'https://' || source_name || '.example/' || document_key END AS source_url"
_KINDS = ("raw_html", "nav_footer", "generator", "empty", "very_short", "title_only", "no_useful_text", "huge", "code")
_FAILS = {k: f"{k} > 0" for k in ("raw_html", "empty", "missing_url", "labels_without_url", "duplicate_active_keys")}
_WARNS = {"title_only": "title_only_share > 0.15", "very_short": "very_short_share > 0.25", "no_useful_text": "no_useful_text_share > 0.15", "archived": "archived_ratio > 3", "nav_footer": "nav_footer > 0", "generator": "generator > 0", "huge": "huge > 0", "no_code": "technical_source AND code = 0"}
_named = lambda tests: "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + ")"


@query(with_sql("docs", "chunks", then=f""", {_QUALITY_CTE}, d AS (SELECT *, {_ADDRESSED} FROM docs),
    qq AS (SELECT q.*, {_NOISE} AS nav_footer, {" OR ".join(f"contains(lower(content), '{g}')" for g in chunk_quality.GENERATORS)} AS generator, trim(content) = '' AS empty, contains(content, '```') AS code FROM q WHERE document_id IN (SELECT document_id FROM docs WHERE status = 'active')),
    a AS (SELECT source_name, count(*) FILTER (WHERE status = 'active') AS active_documents, count(*) FILTER (WHERE status = 'archived') AS archived_documents, count(*) FILTER (WHERE status = 'active' AND source_url IS NULL) AS missing_url,
        count(*) FILTER (WHERE status = 'active' AND source_url IS NULL AND trim(title) <> '') AS labels_without_url, coalesce(bool_or(status = 'active' AND ({" OR ".join(f"contains(lower(title), '{w}')" for w in chunk_quality.TECHNICAL_WORDS)})), false) AS titled FROM d GROUP BY 1),
    k AS (SELECT source_name, count(*) FILTER (WHERE n > 1) AS duplicate_active_keys FROM (SELECT source_name, document_key, count(*) AS n FROM d WHERE status = 'active' GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT source_name, count(*) AS chunks, {", ".join(f"count(*) FILTER (WHERE {x}) AS {x}" for x in _KINDS)}, bool_or(technical) AS shown FROM qq GROUP BY 1),
    f AS (SELECT source_name, document_id, chunk_index, unnest(list_filter([{", ".join(f"CASE WHEN {x} THEN '{x}' END" for x in _KINDS[:8])}], lambda x: x IS NOT NULL)) AS kind FROM qq),
    s AS (SELECT source_name, string_agg(x, '; ' ORDER BY x) AS samples FROM (SELECT source_name, kind || ' ' || lpad(document_id::VARCHAR, 12, '0') || '#' || lpad(chunk_index::VARCHAR, 6, '0') AS x, row_number() OVER (PARTITION BY source_name, kind ORDER BY document_id, chunk_index) AS r FROM f) WHERE r <= 10 GROUP BY 1),
    m AS (SELECT a.*, coalesce(duplicate_active_keys, 0) AS duplicate_active_keys, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("chunks", *_KINDS))}, titled OR coalesce(shown, false) AS technical_source, coalesce(samples, '') AS samples,
        {", ".join(f"round(coalesce({x} / chunks, 0), 4) AS {x}_share" for x in ("very_short", "title_only", "no_useful_text"))}, round(coalesce(archived_documents / nullif(active_documents, 0), 0), 4) AS archived_ratio FROM a LEFT JOIN k USING (source_name) LEFT JOIN c USING (source_name) LEFT JOIN s USING (source_name)),
    v AS (SELECT * EXCLUDE (titled), {_named(_FAILS)} AS failures, {_named(_WARNS)} AS warnings FROM m)
    SELECT *, CASE WHEN failures <> '' THEN 'FAIL' WHEN warnings <> '' THEN 'WARN' ELSE 'PASS' END AS verdict FROM v"""))
def validate_sources(spark, sf_dir):
    """The 20 metrics, failures, warnings, samples and verdict of each source."""
    d = corpus.documents(spark, sf_dir)
    url = F.when(F.col("document_id") % 29 != 7, F.concat(F.lit("https://"), "source_name", F.lit(".example/"), "document_key"))
    return chunk_quality.validation(d.withColumn("source_url", url), corpus.chunks(spark, sf_dir))
