"""Predicates that tell useful chunks from page furniture, and the report over a source's chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.operators.markup import raw_html

#: Shapes that mark technical content worth keeping however short. Fixed values.
TECHNICAL = (
    r"```",
    r"https?://[^ ]+",
    r"(^|\n)[A-Z][A-Z0-9_]{2,}=",
    r"(^|\n)\$ [a-z]+",
    r"(^|[ \n])(GET|POST|PUT|PATCH|DELETE) /",
    r"/api/[a-z0-9/_-]+",
    r"(?i)(select|insert|update|delete) .+ (from|into|set) ",
    r"\{[^{}\n]*:[^{}\n]*\}",
    r"[a-z0-9_-]+\.(py|js|json|yaml|yml|toml|sh|sql)([^a-z0-9]|$)",
)
#: Labels of page navigation, and sentences that generators of documentation leave. Fixed values.
NAVIGATION = ("skip to content", "on this page", "table of contents", "was this helpful", "edit this page", "last updated", "cookie banner", "cookie settings", "accept all cookies", "navigation menu", "sidebar")
GENERATORS = ("for the complete documentation index", "this page is also available as markdown", "llms.txt")
#: Words of titles and texts that make a source a technical one; shares above which a source is warned of. Fixed values.
TECHNICAL_WORDS = ("api", "cli", "code", "developer", "install", "integration", "node", "sdk", "workflow")
TITLE_ONLY_SHARE, VERY_SHORT_SHARE, USELESS_SHARE, ARCHIVED_RATIO = 0.15, 0.25, 0.15, 3.0
WIDGETS = ("was this page helpful", "edit this page", "on this page", "skip to content")
VERY_SHORT_WORDS, USEFUL_WORDS, HUGE_CHARS = 8, 5, 12_000


def protected_technical(content: Column) -> Column:
    out = F.lit(False)
    for shape in TECHNICAL:
        out = out | content.rlike(shape)
    return out


def useful_word_count(content: Column) -> Column:
    """Words of at least three letters."""
    return F.regexp_count(content, F.lit(r"\p{L}{3,}"))


def has_descriptive_sentence(content: Column) -> Column:
    """A sentence mark after at least six words of its line. Pieces are split off first: one pattern over all of it would look again from
    every word of a long text without marks."""
    pieces = F.split(content, r"(?<=[.!?\n])")
    return F.exists(pieces, lambda p: F.substring(p, -1, 1).isin(".", "!", "?") & (F.regexp_count(p, F.lit(r"\p{L}+")) >= 6))


def title_only(content: Column, heading: Column) -> Column:
    return F.btrim(content) == F.btrim(heading)


def mostly_headings(content: Column) -> Column:
    """More lines that start with a heading mark than not."""
    ls = F.split(content, "\n")
    return F.size(F.filter(ls, lambda x: x.startswith("#"))) * 2 > F.size(ls)


def generated_widget(content: Column) -> Column:
    out = F.lit(False)
    for mark in WIDGETS:
        out = out | F.contains(F.lower(content), F.lit(mark))
    return out


def nav_footer_noise(content: Column) -> Column:
    """Labels of page navigation anywhere, or a line that leads to the previous and then to the next page."""
    low, out = F.lower(content), content.rlike(r"(?i)\bprevious\b[^\n]+\bnext\b")
    for mark in NAVIGATION:
        out = out | F.contains(low, F.lit(mark))
    return out


def generator_boilerplate(content: Column) -> Column:
    out = F.lit(False)
    for mark in GENERATORS:
        out = out | F.contains(F.lower(content), F.lit(mark))
    return out


def low_value(content: Column, heading: Column) -> Column:
    weak = generated_widget(content) | title_only(content, heading) | mostly_headings(content) | ((useful_word_count(content) < 7) & ~has_descriptive_sentence(content))
    return ~protected_technical(content) & weak


def with_quality(chunks: DataFrame) -> DataFrame:
    """Adds the predicates as columns to rows with heading and content; low_value follows from the others and looks at no text again."""
    c, h = F.col("content"), F.col("heading")
    told = chunks.withColumns(
        {
            "technical": protected_technical(c), "useful_words": useful_word_count(c), "descriptive": has_descriptive_sentence(c), "title_only": title_only(c, h),
            "mostly_headings": mostly_headings(c), "widget": generated_widget(c), "raw_html": raw_html(c), "nav_footer": nav_footer_noise(c), "generator": generator_boilerplate(c),
            "very_short": F.regexp_count(c, F.lit(r"[^ \n]+")) < VERY_SHORT_WORDS, "huge": F.length(c) > HUGE_CHARS,
        }
    )
    weak = F.col("widget") | F.col("title_only") | F.col("mostly_headings") | ((F.col("useful_words") < 7) & ~F.col("descriptive"))
    return told.withColumns({"no_useful_text": F.col("useful_words") < USEFUL_WORDS, "low_value": ~F.col("technical") & weak})


def drop_low_value(chunks: DataFrame, document: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """Low-value chunks go and the rest are numbered anew; a document of which none would stay keeps all."""
    rows = chunks.withColumn("_keep", ~low_value(F.col("content"), F.col("heading")))
    rows = rows.withColumn("_any", F.max("_keep").over(Window.partitionBy(document))).where("_keep or not _any")
    return rows.withColumn(index, F.row_number().over(Window.partitionBy(document).orderBy(index)) - 1).drop("_keep", "_any")


def report(chunks: DataFrame, by: str = "source_name") -> DataFrame:
    """Counts and shares of the predicates for each source, and its verdict: FAIL for raw HTML or empty chunks, WARN above the
    shares of title-only, very short and useless chunks, else PASS."""
    rows = with_quality(chunks)
    count = lambda c: F.count_if(F.col(c)).alias(c)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), count("raw_html"), F.count_if(F.btrim("content") == "").alias("empty"), count("title_only"), count("very_short"), count("no_useful_text"), count("huge"), count("widget"), count("technical"), count("low_value"))
    share = lambda c: F.round(F.col(c) / F.col("chunks"), 6)
    out = out.withColumns({"title_only_share": share("title_only"), "very_short_share": share("very_short"), "useless_share": share("no_useful_text")})
    fails, warns = (F.col("raw_html") > 0) | (F.col("empty") > 0), (F.col("title_only_share") > 0.15) | (F.col("very_short_share") > 0.25) | (F.col("useless_share") > 0.15)
    return out.withColumn("verdict", F.when(fails, "FAIL").when(warns, "WARN").otherwise("PASS"))


def validation(documents: DataFrame, chunks: DataFrame, by: str = "source_name", samples: int = 10) -> DataFrame:
    """One row for each source: 20 metrics of its active documents and their chunks, what failed, what is warned of, and samples.

    documents: (source, document_id, document_key, status, title, source_url); chunks: (document_id, chunk_index, heading, content).
    A source fails for raw HTML, empty chunks, active documents without address, titles of such, and keys that are active twice; it is
    warned of for its shares of title-only, very short and useless chunks, for navigation or generator noise, huge chunks, and more than
    three archived documents for each active one, and, if it is a technical one, for having no code. Samples are the least chunk names
    of each kind, so nothing larger than them is gathered.
    """
    active = documents.where("status = 'active'")
    keys = active.groupBy(by, "document_key").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.count_if(F.col("n") > 1).alias("duplicate_active_keys"))
    no_url = F.coalesce(F.btrim("source_url"), F.lit("")) == ""
    is_active = F.col("status") == "active"
    titled = F.exists(F.array(*[F.lit(w) for w in TECHNICAL_WORDS]), lambda w: F.contains(F.lower("title"), w))
    docs = documents.groupBy(by).agg(
        F.count_if(is_active).alias("active_documents"), F.count_if(F.col("status") == "archived").alias("archived_documents"), F.count_if(is_active & no_url).alias("missing_url"),
        F.count_if(is_active & no_url & (F.btrim("title") != "")).alias("labels_without_url"), F.coalesce(F.bool_or(is_active & titled), F.lit(False)).alias("titled"),
    )
    rows = with_quality(chunks.join(active.select(by, "document_id"), "document_id") if by not in chunks.columns else chunks.join(active.select("document_id"), "document_id", "left_semi"))
    name = F.concat(F.lpad(F.col("document_id").cast("string"), 12, "0"), F.lit("#"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))
    kinds = ("raw_html", "nav_footer", "generator", "empty", "very_short", "title_only", "no_useful_text", "huge", "code")
    rows = rows.withColumns({"empty": F.btrim("content") == "", "code": F.contains("content", F.lit("```"))})
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), *[F.count_if(F.col(k)).alias(k) for k in kinds], F.bool_or("technical").alias("shown"))
    # The least names of each kind: per kind and document first, so that only a few rows of a source meet.
    faults = rows.select(by, "document_id", "chunk_index", F.explode(F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds[:8]]), lambda x: x.isNotNull())).alias("kind"))
    spread = F.pmod(F.xxhash64("document_id"), F.lit(64))
    first = lambda df, *group: df.withColumn("_r", F.row_number().over(Window.partitionBy(by, "kind", *group).orderBy("document_id", "chunk_index"))).where(F.col("_r") <= samples).drop("_r")
    sampled = first(first(faults.withColumn("_s", spread), "_s")).groupBy(by).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", name))).alias("samples"))
    out = docs.join(keys, by, "left").join(counted, by, "left").join(sampled, by, "left")
    out = out.na.fill(0).withColumns({"titled": F.coalesce("titled", F.lit(False)), "shown": F.coalesce("shown", F.lit(False))})
    share = lambda k: F.round(F.coalesce(F.try_divide(k, "chunks"), F.lit(0.0)), 4)
    out = out.withColumns({f"{k}_share": share(k) for k in ("very_short", "title_only", "no_useful_text")} | {"archived_ratio": F.round(F.coalesce(F.try_divide("archived_documents", "active_documents"), F.lit(0.0)), 4), "technical_source": F.col("titled") | F.col("shown")})
    fails = {k: F.col(k) > 0 for k in ("raw_html", "empty", "missing_url", "labels_without_url", "duplicate_active_keys")}
    warns = {"title_only": F.col("title_only_share") > TITLE_ONLY_SHARE, "very_short": F.col("very_short_share") > VERY_SHORT_SHARE, "no_useful_text": F.col("no_useful_text_share") > USELESS_SHARE, "archived": F.col("archived_ratio") > ARCHIVED_RATIO, "nav_footer": F.col("nav_footer") > 0, "generator": F.col("generator") > 0, "huge": F.col("huge") > 0, "no_code": F.col("technical_source") & (F.col("code") == 0)}
    named = lambda tests: F.concat_ws(",", *[F.when(t, F.lit(k)) for k, t in tests.items()])
    out = out.withColumns({"failures": named(fails), "warnings": named(warns)})
    verdict = F.when(F.col("failures") != "", "FAIL").when(F.col("warnings") != "", "WARN").otherwise("PASS")
    return out.select(
        by, "active_documents", "archived_documents", "chunks", "missing_url", "duplicate_active_keys", *kinds[:4], "very_short", "very_short_share", "title_only", "title_only_share", "no_useful_text", "no_useful_text_share",
        "labels_without_url", "code", "huge", "archived_ratio", "technical_source", "failures", "warnings", F.concat_ws("; ", "samples").alias("samples"), verdict.alias("verdict"),
    )
