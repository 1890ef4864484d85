"""Catalogs of services and glossary rules: checks, merging, enrichment of questions, and joined metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.functions import text as T

#: Risks that a catalog may name. Fixed values.
RISKS = ("low", "medium", "high")
#: Shapes of anchor terms beyond code-like ones, and the class of what they find. Fixed values.
ANCHOR_SHAPES = (("config", r"[A-Z][A-Z0-9]+_[A-Z0-9_]+"), ("function", r"[a-z]+[A-Z][A-Za-z]+"), ("version", r"v[0-9]+[.][0-9]+"), ("endpoint", r"/[a-z]+/[a-z0-9/_-]+"), ("option", r"--[a-z][a-z-]+"), ("identifier", r"[a-z]+_[a-z_]+"), ("acronym", r"[A-Z]{2,6}"))


def glossary_text(text: Column) -> Column:
    """Lower case, any run of dashes or spaces as one space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{Pd}\x{2212}]+", " "), "[ \\t\\n]+", " "))


def expectation_matches(term: Column, text: Column) -> Column:
    """Whether a text has a term between marks that are no part of words, hyphens included; dashes of any kind count as hyphens."""
    plain = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\p{Pd}\x{2212}]", "-"), "[ \\t\\n]+", " "))
    quoted = F.regexp_replace(plain(term), r"([^\p{L}\p{N} ])", r"\\$1")
    return F.when(plain(term) == "", False).otherwise(F.regexp_like(plain(text), F.concat(F.lit(r"(^|[^\p{L}\p{N}_-])"), quoted, F.lit(r"($|[^\p{L}\p{N}_-])"))))


def service_of(source: Column, declared: Column) -> Column:
    """A source's service: the declared one, else its name without _docs or _documentation."""
    return F.coalesce(F.nullif(T.normalize_service_id(declared), F.lit("")), T.normalize_service_id(source))


def scope(rows: DataFrame, workspace: str, course: str | None = None, by: str = "workspace_id") -> DataFrame:
    """Rows of one workspace, and of one course if it is named; both are plain filters, so partitions by them are pruned."""
    rows = rows.where(F.col(by) == workspace)
    return rows if course is None else rows.where(F.col("course") == course)


def catalog_issues(services: DataFrame) -> DataFrame:
    """(service_id, issue) of a table (service_id, domain, risk): ids that occur twice, domains that are no public host, unknown risks."""
    rows = services.groupBy("service_id").agg(F.count(F.lit(1)).alias("n"), F.max((~F.col("domain").rlike(r"^[a-z0-9-]+([.][a-z0-9-]+)+$") | F.col("domain").rlike("^[0-9.]+$")).cast("int")).alias("d"), F.max((~F.coalesce("risk", F.lit("")).isin(*RISKS)).cast("int")).alias("r"))
    issues = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate_id"), F.when(F.col("d") == 1, "bad_domain"), F.when(F.col("r") == 1, "bad_risk")))
    return rows.select("service_id", F.explode(issues).alias("issue"))


def merge_catalogs(parts: list[DataFrame], key: str = "service_id") -> DataFrame:
    """One row for each key, of every other column the first value that is there, in order of the parts."""
    columns = [c for c in dict.fromkeys(c for p in parts for c in p.columns) if c != key]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_part", c)))[c].alias(c)
    return rows.groupBy(key).agg(*[first(c) for c in columns], F.countDistinct("_part").alias("catalogs"))


def _phrases(rows: DataFrame, key: str, text: str, phrases: DataFrame, longest: int | None) -> DataFrame:
    """(key, columns of phrases): phrases (phrase, ...) whose words stand in a row's text, by an equi join on word n-grams, up to the length
    of the longest phrase of the table where none is given."""
    if longest is None:
        longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    words = rows.select(key, F.filter(F.split(glossary_text(F.col(text)), "[^\\p{L}\\p{N}_]+"), lambda x: x != "").alias("w"))
    spans = [F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")) for n in range(1, longest + 1)]  # noqa: B023
    grams = F.concat(*[F.when(F.size("w") >= n, s).otherwise(F.array().cast("array<string>")) for n, s in enumerate(spans, 1)])
    return words.select(key, F.explode(F.array_distinct(grams)).alias("phrase")).join(phrases.where("phrase <> ''"), "phrase")


def enrich_questions(questions: DataFrame, aliases: DataFrame, rules: DataFrame, key: str = "question_id", text: str = "question", longest: int | None = None) -> DataFrame:
    """(key, services, exact_terms, config_terms, anchors): what a glossary adds to each question; none without a match.

    aliases: (service_id, phrase); rules: (service_id, rule_id, ordinal, phrase, kind, term), kind exact, config or anchor, phrases of up to
    `longest` words, or of any number. A service is confirmed where an alias and a rule's phrase both stand in the question; of a rule's phrases the
    first by ordinal counts.
    """
    named = _phrases(questions, key, text, aliases.select("service_id", glossary_text(F.col("phrase")).alias("phrase")), longest).select(key, "service_id").distinct()
    hits = _phrases(questions, key, text, rules.withColumn("phrase", glossary_text(F.col("phrase"))), longest)
    hits = hits.groupBy(key, "service_id", "rule_id", "kind", "term").agg(F.min(F.struct("ordinal", "phrase"))["phrase"].alias("variant")).join(named, [key, "service_id"])
    terms = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("term"))))
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("service_id")).alias("services"), terms("exact").alias("exact_terms"), terms("config").alias("config_terms"), terms("anchor").alias("anchors"))


def scoped_queries(enriched: DataFrame, analyzed: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """(key, variant, query): up to two searches narrowed to confirmed services, of their anchors, exact and config terms, and of these
    with what the question is about; none that equals the question."""
    rows = enriched.join(analyzed, key)
    primary = F.slice(F.array_distinct(F.concat("anchors", "exact_terms")), 1, 8)
    about = F.slice(F.array_distinct(F.filter(F.concat(F.array("action", "attribute"), F.slice("objects", 1, 4)), lambda x: x != "")), 1, 6)
    first = F.slice(F.array_distinct(F.concat(primary, F.slice("config_terms", 1, 8))), 1, 12)
    second = F.slice(F.array_distinct(F.concat(primary, about, F.slice("config_terms", 1, 8))), 1, 14)
    texts = F.array_distinct(F.filter(F.array(F.array_join(first, " "), F.array_join(second, " ")), lambda x: (x != "") & (glossary_text(x) != glossary_text(F.col(question)))))
    return rows.where(F.size(primary) > 0).select(key, F.posexplode(texts).alias("variant", "query"))


def unknown_services(found: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Rows of found whose name is in none of the known ones (name), raw or normalised."""
    ids = known.select(T.normalize_service_id(F.col("name")).alias("_id")).distinct()
    return found.withColumn("_n", T.normalize_service_id(F.col(name))).join(ids, F.col("_n") == F.col("_id"), "left_anti").drop("_n")


def merged_metadata(rows: DataFrame, other: DataFrame, on: str, first: str, second: str, out: str = "metadata") -> DataFrame:
    """rows with out: the map `first` with the other side's map `second` laid over it, whose keys win."""
    empty = F.create_map().cast("map<string,string>")
    both = rows.join(other.select(on, F.col(second).alias("_over")), on, "left")
    base, over = F.coalesce(F.col(first), empty), F.coalesce("_over", empty)
    return both.withColumn(out, F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)).drop("_over")


def higher_scored(base: DataFrame, extra: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Rows of both by key, each with its higher score; the base's row on ties."""
    rows = base.withColumn("_extra", F.lit(0)).unionByName(extra.withColumn("_extra", F.lit(1)))
    rest = [c for c in base.columns if c not in keys and c != score]
    best = rows.groupBy(*keys).agg(F.max(F.struct(score, (-F.col("_extra")).alias("o"), *rest)).alias("b"))
    return best.select(*keys, f"b.{score}", *[f"b.{c}" for c in rest], (F.col("b.o") == -1).alias("from_extra"))


def anchor_terms(text: Column, most: int = 30) -> Column:
    """array<struct<class, term>>: shaped and code-like terms, each once under the first shape that finds it."""
    found = F.array(*[F.regexp_extract_all(text, F.lit(s), F.lit(0)) for _, s in ANCHOR_SHAPES], T.exact_terms(text))
    kinds = F.array(*[F.lit(k) for k, _ in ANCHOR_SHAPES], F.lit("exact"))

    def first(each: Column) -> Column:
        names = F.slice(F.array_distinct(F.flatten(each)), 1, most)
        return F.transform(names, lambda t: F.struct(t.alias("term"), F.element_at(kinds, F.array_position(F.transform(each, lambda x: F.array_contains(x, t)), True).cast("int")).alias("class")))

    # One list of one value, so that the text is searched once and not for each term found.
    return F.get(F.transform(F.array(found), first), F.lit(0))


def with_embedding(rows: DataFrame, vectors: DataFrame, size: int, text: str = "text") -> DataFrame:
    """rows with content_hash and the vector (content_hash, v) of equal content; a vector of another size fails the run."""
    good = vectors.select("content_hash", F.when(F.size("v") == size, F.col("v")).otherwise(F.raise_error(F.lit("a vector has another size"))).alias("v"))
    return rows.withColumn("content_hash", F.sha2(text, 256)).join(good, "content_hash", "left")
