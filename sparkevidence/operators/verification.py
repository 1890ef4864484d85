"""Supplied answers held against evidence: claims without support, leaked sources, and what may safely be said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.functions import text as T

# Common stems that support a claim, the share of its stems that does, letters of a stem, tokens of a claim, and modes of
# answers that claim nothing.
SHARED, SHARE, STEM, LEAST_TOKENS, LEAST_NAME = 3, 0.55, 7, 3, 8
NO_CLAIMS = ("ask_for_missing_data", "general_answer_without_sources", "out_of_base")
SOURCE_LINE = r"(?i)^[-* ]*(sources?|quellen?|fuentes?|источники?)[ ]*:"


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(T.significant_terms(text), lambda t: F.substring(t, 1, STEM)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.transform(F.split(text, "\n"), T.split_sentences)), lambda s: F.btrim(s)), lambda s: s != "")


def claims(answers: DataFrame, key: list[str]) -> DataFrame:
    """(key, no, sentence, claim): the sentences of answers (key, mode, text) in order; claim tells which claim something."""
    rows = answers.select(*key, "mode", F.posexplode(sentences(F.col("text"))).alias("no", "sentence"))
    says = (T.count_tokens(F.col("sentence")) >= LEAST_TOKENS) & ~F.col("sentence").endswith(":") & ~F.col("sentence").rlike(SOURCE_LINE) & ~F.coalesce(F.col("mode").isin(*NO_CLAIMS), F.lit(False))
    return rows.select(*key, "no", "sentence", says.alias("claim"))


def supported(told: DataFrame, evidence: DataFrame, key: list[str], within: str, item: str) -> DataFrame:
    """(key, no, best, n): the most stems that a claim shares with one item of evidence (within, item, text) of its group, and how many
    it has. Claims and items meet by their stems, and what they share is counted before it is shuffled by pair."""
    a = told.where("claim").select(*key, "no", F.explode(stems(F.col("sentence"))).alias("stem"))
    b = evidence.select(within, item, F.explode(stems(F.col("text"))).alias("stem"))
    per = a.join(b, [within, "stem"]).groupBy(*key, "no", item).agg(F.count(F.lit(1)).alias("shared")).groupBy(*key, "no").agg(F.max("shared").alias("best"))
    return a.groupBy(*key, "no").agg(F.count(F.lit(1)).alias("n")).join(per, [*key, "no"], "left").select(*key, "no", F.coalesce("best", F.lit(0)).alias("best"), "n")


def leaked(answers: DataFrame, evidence: DataFrame, key: list[str], within: str) -> DataFrame:
    """(key): answers that name a source: a line of sources, or a title or address of their group's evidence (within, title, url) of some
    letters. Names meet answers by their first word."""
    names = evidence.select(within, F.explode(F.array("title", "url")).alias("name")).where(F.length("name") >= LEAST_NAME).distinct()
    first = lambda c: F.try_element_at(T.tokens(c), F.lit(1))
    words = answers.select(*key, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    named = words.join(names.withColumn("word", first(F.col("name"))), [within, "word"]).join(answers.select(*key, "text"), key).where(F.contains(F.lower("text"), F.lower("name"))).select(*key)
    lines = answers.where(F.exists(F.split("text", "\n"), lambda x: x.rlike(SOURCE_LINE))).select(*key)
    return named.unionByName(lines).distinct()


def verified_answers(answers: DataFrame, evidence: DataFrame, key: list[str], within: str, item: str) -> DataFrame:
    """(key, claims, unsupported, leakage, verdict, safe_answer) of answers (key, mode, text) against evidence (within, item, title, url,
    text); within is one of the key's columns.

    A claim is supported by SHARED stems in one item, all of them if it has fewer, or by SHARE of them; one without stems needs no
    support. pass: nothing is unsupported and no source leaks, safe_answer is the text; rewrite: the sentences that are left are the safe
    answer, without lines of sources; fail: nothing is left, safe_answer is empty. Answers without evidence fail where they claim
    something. A null text claims nothing. key and (within, item) have to be unique.
    """
    told = claims(answers, key)
    held = supported(told, evidence, key, within, item)
    enough = (F.col("best") >= F.least(F.lit(SHARED), F.col("n"))) | (F.col("best") >= F.lit(SHARE) * F.col("n"))
    judged = told.join(held, [*key, "no"], "left").withColumn("bad", F.col("claim") & F.col("n").isNotNull() & ~F.coalesce(enough, F.lit(False)))
    kept = F.when(~F.col("bad") & ~F.col("sentence").rlike(SOURCE_LINE), F.struct("no", "sentence"))
    per = judged.groupBy(*key).agg(F.count_if("claim").alias("claims"), F.count_if("bad").alias("unsupported"), F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["sentence"]), "\n").alias("rest"))
    out = answers.join(per, key, "left").join(leaked(answers, evidence, key, within).withColumn("leakage", F.lit(True)), key, "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"claims": F.coalesce("claims", zero), "unsupported": F.coalesce("unsupported", zero), "leakage": F.coalesce("leakage", F.lit(False)), "rest": F.coalesce("rest", F.lit(""))})
    fine = (F.col("unsupported") == 0) & ~F.col("leakage")
    verdict = F.when(fine, "pass").when(F.col("rest") != "", "rewrite").otherwise("fail")
    return out.select(*key, "claims", "unsupported", "leakage", verdict.alias("verdict"), F.when(fine, F.coalesce("text", F.lit(""))).otherwise(F.col("rest")).alias("safe_answer"))
