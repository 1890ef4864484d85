"""Corpus term statistics and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T

#: Multipliers of a term's weight by its role in a question. Fixed values.
ROLES = {"platform": 0.72, "exact": 1.24, "config": 1.24, "symptom": 1.08, "source": 0.96}


#: Shapes that a term has before it is lower-cased, by rank. Fixed values.
RAW_SHAPES = ((2, "config", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)++$"), (1, "acronym", r"^[A-Z]{2,6}$"))


def term_occurrences(chunks: DataFrame) -> DataFrame:
    """One row for each distinct term of a chunk: (term, document_id, chunk_index, course, shape); shape is the rank of the term's
    shape as it is written there, 0 for a plain word."""
    # Whole tokens of a shape are looked for in the text itself: they are few, so no pattern has to be tried on every token.
    # They begin with a capital, so what stands before is looked at only where one is.
    whole = lambda s: r"(?=[A-Z])(?<![\p{L}\p{N}_])(?:" + s.strip("^$") + r")(?![\p{L}\p{N}_])"
    found = [F.transform(F.regexp_extract_all("content", F.lit(whole(s)), F.lit(0)), F.lower).alias(f"raw{k}") for k, _, s in RAW_SHAPES]
    rows = chunks.select("document_id", "chunk_index", "course", T.significant_terms(F.col("content")).alias("terms"), *found)

    def shape(term: Column) -> Column:
        out = F.lit(0)
        for k, _, _ in reversed(RAW_SHAPES):
            out = F.when(F.array_contains(F.col(f"raw{k}"), term), k).otherwise(out)
        return out

    # The shape is told inside the array, and only where a chunk has a shaped token at all, so the arrays of these go no further.
    plain = F.size(F.concat(*[F.col(f"raw{k}") for k, _, _ in RAW_SHAPES])) == 0
    told = F.when(plain, F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("shape")))).otherwise(F.transform("terms", lambda t: F.struct(t.alias("term"), shape(t).alias("shape"))))
    return rows.select("document_id", "chunk_index", "course", F.explode(told).alias("t")).select("t.term", "document_id", "chunk_index", "course", "t.shape")


def term_statistics(chunks: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(term, document_frequency, chunk_frequency, course_frequency, term_type); with roots (root) only of terms with these stems.

    Occurrences are distinct by chunk already, so documents and courses are counted from (term, document) rows: two plain grouped
    counts instead of an expansion by each distinct count, and both combine before their shuffles.
    """
    rows = term_occurrences(chunks)
    if roots is not None:
        rows = rows.join(roots.select(F.col("root").alias("_root")), T.root(F.col("term")) == F.col("_root"), "left_semi")
    per_document = rows.groupBy("term", "document_id", "course").agg(F.count(F.lit(1)).alias("n"), F.max("shape").alias("shape"))
    per_course = per_document.groupBy("term", "course").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("c"), F.max("shape").alias("shape"))
    out = per_course.groupBy("term").agg(F.sum("d").alias("document_frequency"), F.sum("c").alias("chunk_frequency"), F.count_if(F.coalesce("course", F.lit("")) != "").alias("course_frequency"), F.max("shape").alias("shape"))
    kind = T.guess_term_type(F.col("term"))
    for k, name, _ in reversed(RAW_SHAPES):
        kind = F.when(F.col("shape") == k, name).otherwise(kind)
    return out.withColumn("term_type", kind).drop("shape")


def corpus_statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, document_frequency, chunk_frequency): documents (text) and chunks (content) that hold a term, counted apart."""
    count = lambda df, c, name: df.select(F.explode(T.significant_terms(F.col(c))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(name))
    both = count(documents, "text", "document_frequency").join(count(chunks, "content", "chunk_frequency"), "term", "full_outer")
    zero = F.lit(0).cast("long")
    return both.select("term", F.coalesce("document_frequency", zero).alias("document_frequency"), F.coalesce("chunk_frequency", zero).alias("chunk_frequency"))


def with_examples(stats: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """stats with examples, the latest documents (by id) of each term; terms without chunks stay."""
    # Shapes are not asked for here, so no text is searched for them.
    rows = chunks.select(F.explode(T.significant_terms(F.col("content"))).alias("term"), "document_id").distinct()
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("document_id")))
    top = rows.withColumn("r", rank).where(F.col("r") <= most).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "document_id"))), lambda x: x["document_id"].cast("string")).alias("examples"))
    return stats.join(top, "term", "left")


def merge_by_root(stats: DataFrame) -> DataFrame:
    """Statistics by stem: the shortest term (first on ties), the greatest counts, the first type other than "term"."""
    rows = stats.withColumn("root", T.root(F.col("term")))
    return rows.groupBy("root").agg(
        F.min(F.struct(F.length("term").alias("n"), "term"))["term"].alias("term"), F.count(F.lit(1)).alias("terms"),
        F.max("document_frequency").alias("document_frequency"), F.max("chunk_frequency").alias("chunk_frequency"), F.max("course_frequency").alias("course_frequency"),
        F.coalesce(F.min(F.when(F.col("term_type") != "term", F.col("term_type"))), F.lit("term")).alias("term_type"),
    )


def frequency_class(df: Column, courses: Column, doc_share: Column, chunk_share: Column) -> Column:
    return (
        F.when((doc_share >= 0.35) | (chunk_share >= 0.30), "common")
        .when((doc_share >= 0.18) & (courses <= 1), "course_common")
        .when((df <= 1) | (doc_share <= 0.04), "rare_anchor")
        .when(doc_share <= 0.12, "specific")
        .otherwise("medium")
    )


def with_weights(stats: DataFrame, documents: int | Column, chunks: int | Column, role: str = "object") -> DataFrame:
    """Adds doc_share, idf, frequency_class and weight: a base by class times the role's factor, shaped terms a little more, at most
    1.6. idf is reported and does not enter the weight."""
    n, m = (F.lit(x) if isinstance(x, int) else x for x in (documents, chunks))
    doc_share, chunk_share = F.col("document_frequency") / F.greatest(n, F.lit(1)), F.col("chunk_frequency") / F.greatest(m, F.lit(1))
    rows = stats.withColumn("doc_share", F.round(doc_share, 6)).withColumn("idf", F.round(F.ln((n + 1) / (F.col("document_frequency") + 1)) + 1, 6))
    rows = rows.withColumn("frequency_class", frequency_class(F.col("document_frequency"), F.col("course_frequency"), doc_share, chunk_share))
    base = F.when(F.col("frequency_class") == "common", 0.24).when(F.col("frequency_class") == "course_common", 0.38).when(F.col("frequency_class") == "medium", 0.72).when(F.col("frequency_class") == "specific", 1.05).otherwise(1.28)
    shaped = F.when(F.col("term_type") != "term", 0.16).otherwise(0.0)
    return rows.withColumn("weight", F.round(F.least(base * F.lit(ROLES.get(role, 1.0)) + shaped, F.lit(1.6)), 6))


def top_keywords(chunks: DataFrame, most: int = 36) -> DataFrame:
    """(document_id, rank, term, n): each document's most frequent terms, by count then term."""
    counts = chunks.select("document_id", F.explode(T.tokens(F.col("content"))).alias("term")).where(~F.col("term").isin(*T.STOPWORDS) & (F.length("term") > 1) & ~F.col("term").rlike("^[0-9]+$"))
    counts = counts.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "term")))
    return ranked.where(F.col("rank") <= most).select("document_id", "rank", "term", "n")
