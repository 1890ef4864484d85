"""Sections and chunks of Markdown-like documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T


def split_sections(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, section_index, heading, content, page): a section starts at each heading line; [page n] lines set the page.

    Lines are exploded and a running count of headings numbers the sections; the window is partitioned by document.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    along = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("line").rlike("^#{1,6} ")
    page = F.last(F.when(F.col("line").rlike(r"^\[page [0-9]+\]$"), F.regexp_extract("line", "([0-9]+)", 1).cast("int")), ignorenulls=True).over(along)
    lines = lines.withColumns({"s": F.sum(is_heading.cast("int")).over(along), "page": page, "h": is_heading}).where(~F.col("line").rlike(r"^\[page [0-9]+\]$"))
    rows = lines.groupBy(key, "s").agg(F.min(F.when(F.col("h"), T.clean_heading(F.col("line")))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"), F.min("page").alias("page"))
    rows = rows.where(F.btrim("content", F.lit(" \n")) != "")
    number = F.row_number().over(Window.partitionBy(key).orderBy("s")) - 1
    return rows.select(key, number.alias("section_index"), "heading", "content", "page")


def cut_long(paragraph: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, ended after a sentence or at a space past the middle where there is one."""
    out = []
    while len(paragraph) > most:
        at = paragraph.rfind(". ", most // 2, most)
        at = at + 1 if at > 0 else paragraph.rfind(" ", most // 2, most)
        at = at if at > 0 else most
        out.append(paragraph[:at].strip())
        paragraph = paragraph[at:].strip()
    return [*out, paragraph] if paragraph else out


def tail_overlap(text: str, most: int) -> str:
    """The end of a text, from a word's start."""
    if len(text) <= most:
        return text
    tail = text[-most:]
    return tail[tail.find(" ") + 1 :] if " " in tail else tail


def pack(text: str | None, most: int, overlap: int, separator: str) -> list[str]:
    """Paragraphs packed greedily up to `most` characters; each chunk but the first starts with the end of the one before."""
    chunks, current = [], ""
    for paragraph in (p.strip() for p in (text or "").split(separator)):
        for part in cut_long(paragraph, most):
            if current and len(current) + len(separator) + len(part) > most:
                chunks.append(current)
                current = tail_overlap(current, overlap) + separator + part
            else:
                current = current + separator + part if current else part
    return [*chunks, current] if current else chunks


def split_chunks(sections: DataFrame, keys: list[str], content: str = "content", most: int = 1200, overlap: int = 180, separator: str = "\n\n") -> DataFrame:
    """(keys, part_index, chunk): an order-dependent fold over a section's paragraphs, in Arrow batches."""

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(lambda x: pack(x, most, overlap, separator))

    packed = F.pandas_udf(run, "array<string>")
    return sections.select(*keys, F.posexplode(packed(content)).alias("part_index", "chunk"))


def strip_page_chrome(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): outside code fences, without generator lines and prev/next labels, and without all that follows a footer's start.

    Lines are exploded; fences are a running parity and the footer a running maximum over the lines before.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    along = Window.partitionBy(key).orderBy("n")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```")
    code = (F.coalesce(F.sum(fence.cast("int")).over(upto), F.lit(0)) % 2 == 1) | fence
    lines = lines.withColumn("code", code)
    low = F.lower(F.btrim("line"))
    footer = ~F.col("code") & low.rlike(r"^(copyright|©|all rights reserved|footer)")
    lines = lines.withColumn("foot", F.coalesce(F.max(footer.cast("int")).over(upto), F.lit(0)) == 1)
    noise = ~F.col("code") & (low.isin(*T.BOILERPLATE) | low.rlike(r"^(generated by|built with|powered by|edit this page|previous|next)( |:|$)"))
    kept = lines.where(~F.col("foot") & ~noise)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias(text))


def card(docs: DataFrame, sections: DataFrame, key: str = "document_id") -> DataFrame:
    """Routing cards: summary, topics (headings, 30 at most), entities, number of sections and quality, from .35 up to 1."""
    s = sections.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"), F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNotNull(), F.struct("section_index", "heading")))), lambda x: x["heading"]), 1, 30).alias("topics"))
    rows = docs.join(s, key, "left").withColumns({"n_sections": F.coalesce("n_sections", F.lit(0)), "topics": F.coalesce("topics", F.array().cast("array<string>"))})
    quality = F.least(F.lit(1.0), F.lit(0.35) + F.when(F.length("text") > 500, 0.20).otherwise(0.0) + F.lit(0.04) * F.least(F.col("n_sections"), F.lit(6)) + F.when(F.size("topics") > 0, 0.10).otherwise(0.0))
    return rows.select(key, T.summarize(F.col("text"), 700).alias("summary"), "topics", F.slice(T.exact_terms(F.col("text")), 1, 12).alias("entities"), "n_sections", F.round(quality, 4).alias("quality"))


def split_code_spans(text: Column) -> Column:
    """Without fenced and inline code."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"(`+)[^`]+?\1", "")
