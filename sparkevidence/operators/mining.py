"""Glossary candidates mined from observations of several kinds: groups by source and topic, lists of their most frequent terms, and a
confidence with bonuses and ceilings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T

# Fixed values of the confidence: what each observation adds and how much at most, what each kind of terms adds, and the ceilings.
EACH, MOST_EACH, EXACT_BONUS, CONFIG_BONUS, PHRASE_BONUS = 0.025, 0.18, 0.08, 0.08, 0.05
CEILING, SENSITIVE_CEILING, LOW_CEILING = 0.95, 0.88, 0.58
TOPIC_CHARS, TERMS, PHRASES = 80, 8, 6
#: Marks of terms that an owner has to look at, and of sources that are nobody's. Fixed values.
SENSITIVE = r"(?i)(secret|token|password|api_?key|[0-9]{6,})"
UNREVIEWED = r"(?i)^(local|unknown|smoke|upload|test|tmp)"


def observation(df: DataFrame, kind: str, key: Column, source: Column, topic: Column, text: Column, base: float, phrase: bool = False) -> DataFrame:
    """(kind, key, source, topic, text, base, phrase) of one table; topic is single-spaced, lower-cased and cut at TOPIC_CHARS."""
    t = F.rtrim(F.substring(F.btrim(F.regexp_replace(F.lower(topic), "[ \t\n]+", " ")), 1, TOPIC_CHARS))
    phrases = F.substring(F.btrim(F.regexp_replace(text, "[ \t\n]+", " ")), 1, TOPIC_CHARS) if phrase else F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.coalesce(source, F.lit("unknown")).alias("source"), t.alias("topic"), text.alias("text"), F.lit(base).alias("base"), phrases.alias("phrase"))


def most_frequent(terms: DataFrame, by: list[str], name: str, most: int) -> DataFrame:
    """(by, name): each group's most frequent terms (by, term), by count then term. Counts combine before their shuffle, ranks of one group
    are taken from its counts only, and what is put into a list is bounded."""
    counts = terms.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "term"))).where(F.col("r") <= most)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias(name))


def candidates(observations: list[DataFrame], existing: DataFrame, terms: int = TERMS, phrases: int = PHRASES) -> DataFrame:
    """(source, topic, observations, kinds, exact_terms, config_terms, phrases, known_terms, flags, status, confidence) of each source and topic.

    existing: terms (term) that the glossary has; they are left out of the lists and counted. A group without any term or phrase is no
    candidate, nor one without a topic. sensitive-review: one of its terms looks like a secret or a number; low-confidence: its source is nobody's, or one
    of its phrases is broken. Null texts say nothing.
    """
    by = ["source", "topic"]
    rows = reduce(DataFrame.unionByName, observations).where("topic <> ''")
    shaped = rows.select(*by, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.EXACT), F.lit(0)))).alias("term"))
    known = existing.select(F.lower("term").alias("_k")).distinct().withColumn("_known", F.lit(True))
    shaped = shaped.withColumn("_k", F.lower("term")).join(known, "_k", "left").drop("_k")
    new = shaped.where("_known is null")
    is_config = F.col("term").rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)++$")
    lists = [
        most_frequent(new.where(~is_config), by, "exact_terms", terms), most_frequent(new.where(is_config), by, "config_terms", terms),
        most_frequent(rows.where("phrase <> ''").select(*by, F.col("phrase").alias("term")), by, "phrases", phrases), shaped.where("_known").groupBy(*by).agg(F.count_distinct(F.lower("term")).alias("known_terms")),
    ]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("base").alias("base"))
    for part in lists:
        out = out.join(part, by, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("exact_terms", "config_terms", "phrases")} | {"known_terms": F.coalesce("known_terms", F.lit(0).cast("long"))})
    out = out.where((F.size("exact_terms") > 0) | (F.size("config_terms") > 0) | (F.size("phrases") > 0))
    sensitive = F.exists(F.concat("exact_terms", "config_terms"), lambda t: t.rlike(SENSITIVE))
    low = F.col("source").rlike(UNREVIEWED) | F.exists("phrases", lambda p: F.contains(p, F.lit("�")) | p.rlike("[ÃÂ][\u0080-¿]"))
    out = out.withColumn("flags", F.concat_ws(",", F.when(sensitive, "sensitive-review"), F.when(low, "low-confidence")))
    bonus = lambda c, x: F.when(F.size(c) > 0, x).otherwise(0.0)
    base = F.col("base") + F.least(F.col("observations") * F.lit(EACH), F.lit(MOST_EACH)) + bonus("exact_terms", EXACT_BONUS) + bonus("config_terms", CONFIG_BONUS) + bonus("phrases", PHRASE_BONUS)
    ceiling = F.when(low, LOW_CEILING).when(sensitive, SENSITIVE_CEILING).otherwise(CEILING)
    status = F.when(sensitive, "sensitive-review").when(low, "low-confidence").otherwise("suggested")
    return out.select(*by, "observations", "kinds", "exact_terms", "config_terms", "phrases", "known_terms", "flags", status.alias("status"), F.round(F.least(base, ceiling), 4).alias("confidence"))
