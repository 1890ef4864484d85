"""Queries of text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import repair
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query

_CODE = " OR ".join(f"regexp_matches(x, '{c}')" for c in repair.CODE)
_APART = f"(x = '' OR {' OR '.join(f"regexp_matches(x, '{a}')" for a in repair.APART)} OR {_CODE})"
_TRIM = "trim(x, ' ' || chr(9) || chr(13))"


@query(f"""WITH part AS (SELECT doc_id, unnest(range(1, len(string_split(text, '```')) + 1)) AS p, unnest(string_split(text, '```')) AS t FROM documents),
    line AS (SELECT doc_id, p, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i, unnest(string_split(t, chr(10))) AS raw FROM part WHERE p % 2 = 1),
    told AS (SELECT doc_id, p, i, x, {_APART} AS apart, regexp_matches(x, '{repair.ENDS}') AS ends FROM (SELECT doc_id, p, i, {_TRIM.replace("(x", "(raw")} AS x FROM line)),
    near AS (SELECT *, lag(apart) OVER w AS a, lag(ends) OVER w AS e FROM told WINDOW w AS (PARTITION BY doc_id, p ORDER BY i)),
    prose AS (SELECT doc_id, p, string_agg(CASE WHEN i = 1 THEN '' WHEN NOT apart AND NOT a AND NOT e THEN ' ' ELSE chr(10) END || x, '' ORDER BY i) AS t, count(*) FILTER (WHERE i > 1 AND NOT apart AND NOT a AND NOT e) AS joins FROM near GROUP BY ALL),
    every AS (SELECT doc_id, p, t, joins FROM prose UNION ALL SELECT doc_id, p, t, 0 FROM part WHERE p % 2 = 0)
    SELECT doc_id, sha256(string_agg(t, '```' ORDER BY p)) AS joined_sha256, CAST(sum(joins) AS BIGINT) AS lines_joined FROM every GROUP BY 1""")
def joined_lines(spark, sf_dir):
    """Whole texts with their soft-wrapped lines joined."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", repair.join_wrapped_lines(F.col("text")).alias("joined"))
    breaks = lambda c: F.regexp_count(c, F.lit("\n")).cast("long")
    return d.select("doc_id", F.sha2("joined", 256).alias("joined_sha256"), (breaks("text") - breaks("joined")).alias("lines_joined"))


#: Documents whose first words are glued in the query's table: every so many. Words of the dictionary have to be in so many documents.
GLUE_EVERY, KNOWN_IN = 3, 3
_WORDS = r"regexp_extract_all(text, '\p{L}+')"


def _glued_documents(spark, sf_dir):
    """Documents, in every third of which the first five words stand at the end once more, glued together."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), 1, 5), "")
    return d.withColumn("text", F.when(F.col("doc_id") % GLUE_EVERY == 0, F.concat("text", F.lit("\n"), first)).otherwise(F.col("text")))


def _dictionary(spark, sf_dir):
    """Lower-cased words of 2 to 15 letters in at least so many documents."""
    d = corpus.table(spark, sf_dir, "documents")
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).where(F.length("word").between(2, repair.GLUED - 1))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= KNOWN_IN).select("word")


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id, CASE WHEN doc_id % {GLUE_EVERY} = 0 THEN text || chr(10) || array_to_string(({_WORDS})[1:5], '') ELSE text END AS text FROM documents),
    known AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct({_WORDS.replace("(text", "(lower(text)")})) AS word FROM documents) WHERE len(word) BETWEEN 2 AND {repair.GLUED - 1} GROUP BY 1 HAVING count(*) >= {KNOWN_IN}),
    part AS (SELECT doc_id, unnest(range(1, len(string_split(text, '```')) + 1)) AS p, unnest(string_split(text, '```')) AS t FROM docs),
    line AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM part WHERE p % 2 = 1) WHERE NOT ({_CODE})),
    seen AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(x, '\\p{{L}}{{{repair.GLUED},}}')) AS word FROM line)),
    words AS (SELECT DISTINCT word FROM seen),
    pieces AS (SELECT s.word, at0, n FROM (SELECT word, at0, unnest(range(2, least({repair.LONGEST}, len(word) - at0) + 1)) AS n FROM (SELECT word, unnest(range(len(word))) AS at0 FROM words)) s JOIN known ON known.word = substring(lower(s.word), at0 + 1, n)),
    fewest AS (SELECT word, len(word) AS at0, []::BIGINT[] AS parts FROM words UNION ALL
        SELECT word, at0, parts FROM (SELECT p.word, p.at0, list_prepend(p.n, f.parts) AS parts, row_number() OVER (PARTITION BY p.word, p.at0 ORDER BY p.n DESC) AS r FROM fewest f JOIN pieces p ON p.word = f.word AND p.at0 + p.n = f.at0) WHERE r = 1),
    best AS (SELECT word, first(parts ORDER BY len(parts), parts DESC) AS parts FROM fewest WHERE at0 = 0 GROUP BY 1)
    SELECT doc_id, seen.word, array_to_string(list_transform(parts, lambda n, i: substring(seen.word, CAST(1 + coalesce(list_sum(parts[1 : i - 1]), 0) AS BIGINT), n)), ' ') AS repaired FROM seen JOIN best USING (word) WHERE len(parts) >= 2""")
def glued_words(spark, sf_dir):
    """Glued words of each document and what they come apart into; dictionary: frequent words of the corpus."""
    rows = _glued_documents(spark, sf_dir)
    seen = rows.select("doc_id", F.explode(repair.long_words(F.col("text"))).alias("word"))
    return seen.join(repair.segmented(seen.select("word").distinct(), _dictionary(spark, sf_dir)), "word").select("doc_id", "word", "repaired")


@query()
def repair_glued_words(spark, sf_dir):
    """Whole texts with glued words taken apart; a test holds them against a loop."""
    fixed = repair.repair_glued_words(_glued_documents(spark, sf_dir), _dictionary(spark, sf_dir), "doc_id", "text")
    return fixed.select("doc_id", "n_glued", F.sha2("text", 256).alias("text_sha256"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: lower(trim(x)) NOT IN ({", ".join(f"'{b}'" for b in T.BOILERPLATE)})), chr(10))) AS text_sha256 FROM documents""")
def without_boilerplate(spark, sf_dir):
    """Whole texts without lines that are page furniture."""
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.drop_boilerplate_lines(F.col("text")), 256).alias("text_sha256"))
