"""Answers of conversations against what their users said."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import verification
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus_queries import _SIGNIFICANT

_STEMS = f"list_distinct(list_transform({_SIGNIFICANT.replace('content', 'X')}, lambda t: substring(t, 1, 7)))"
_LINE = verification.SOURCE_LINE


@query(f"""WITH t AS (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role, text), a AS (SELECT conv_id, turn, text FROM t WHERE role = 'assistant'),
    e AS (SELECT conv_id, turn AS item, text, array_to_string(string_split(text, ' ')[1:4], ' ') AS title, {_STEMS.replace("X", "text")} AS s FROM t WHERE role = 'user'),
    s0 AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM a),
    s1 AS (SELECT conv_id, turn, i, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(l, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS p FROM s0)),
    s AS (SELECT conv_id, turn, i * 100000 + j AS no, x, len(regexp_extract_all(x, '{T.TOKEN}')) >= 3 AND NOT ends_with(x, ':') AND NOT regexp_matches(x, '{_LINE}') AS claim, {_STEMS.replace("X", "x")} AS c FROM s1),
    h AS (SELECT s.conv_id, s.turn, no, max(len(list_intersect(c, e.s))) AS best FROM s LEFT JOIN e ON e.conv_id = s.conv_id WHERE claim GROUP BY ALL),
    b AS (SELECT s.*, claim AND len(c) > 0 AND NOT (coalesce(best, 0) >= least(3, len(c)) OR coalesce(best, 0) >= 0.55::DOUBLE * len(c)) AS bad FROM s LEFT JOIN h USING (conv_id, turn, no)),
    p AS (SELECT conv_id, turn, count(*) FILTER (WHERE claim) AS claims, count(*) FILTER (WHERE bad) AS unsupported, coalesce(string_agg(x, chr(10) ORDER BY no) FILTER (WHERE NOT bad AND NOT regexp_matches(x, '{_LINE}')), '') AS rest FROM b GROUP BY ALL),
    k AS (SELECT DISTINCT a.conv_id, a.turn FROM a JOIN e ON a.conv_id = e.conv_id AND len(title) >= 8 AND contains(lower(a.text), lower(title)) AND list_contains(regexp_extract_all(lower(a.text), '{T.TOKEN}'), regexp_extract_all(lower(title), '{T.TOKEN}')[1])
        UNION SELECT conv_id, turn FROM s0 WHERE regexp_matches(l, '{_LINE}')),
    v AS (SELECT a.conv_id, a.turn, text, coalesce(claims, 0) AS claims, coalesce(unsupported, 0) AS unsupported, k.turn IS NOT NULL AS leakage, coalesce(rest, '') AS rest FROM a LEFT JOIN p USING (conv_id, turn) LEFT JOIN k ON k.conv_id = a.conv_id AND k.turn = a.turn)
    SELECT conv_id, turn, claims, unsupported, leakage, CASE WHEN unsupported = 0 AND NOT leakage THEN 'pass' WHEN rest <> '' THEN 'rewrite' ELSE 'fail' END AS verdict, CASE WHEN unsupported = 0 AND NOT leakage THEN text ELSE rest END AS safe_answer FROM v""")
def verified_answers(spark, sf_dir):
    """Assistant turns against the user turns of their conversation: unsupported claims, leaked first words, and the safe answer."""
    t = corpus.table(spark, sf_dir, "conversations")
    t = t.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    answers = t.where("role = 'assistant'").select("conv_id", "turn", F.lit("answer_from_materials").alias("mode"), "text")
    evidence = t.where("role = 'user'").select("conv_id", F.col("turn").alias("item"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"), F.lit(None).cast("string").alias("url"), "text")
    return verification.verified_answers(answers, evidence, ["conv_id", "turn"], "conv_id", "item")
