"""Activation of sources as one job: stored pages are read, planned, cut into sections and chunks and judged by source, and only sources
that pass the gate get their new versions. A source that fails keeps what it had, whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import chunk_quality, chunking, lifecycle
from sparkevidence.operators.reviews import reasons
from sparkevidence.sources import pages as P
from sparkevidence.sources.cuts import cut

SIGNATURE = "sections-1/chunks-1200-180"


@dataclass
class Activated:
    """What a run leaves: documents of all sources, children of new versions that were let in, and a row for each source."""

    documents: DataFrame
    sections: DataFrame
    chunks: DataFrame
    report: DataFrame


def incoming(pages: DataFrame, source: Column, allowed: DataFrame, signature: str = SIGNATURE) -> DataFrame:
    """(source, document_key, content_hash, signature, title, text) of stored pages (page_id, url, html) of allowed sources (source), one
    for each address: of several pages the last. Pages that can't be read, and addresses of the screen, are left out."""
    rows = P.screened(pages.withColumn("source", source).join(allowed.select("source").distinct(), "source", "left_semi"))
    rows = rows.where(P.url_allowed(F.col("url"), F.array("source")))
    key = F.concat("source", F.lit("/"), F.regexp_replace(T.normalize_url(F.col("url")), "^[a-zA-Z]+://[^/]*/?", ""))
    last = rows.withColumn("document_key", key).groupBy("document_key").agg(F.max("page_id").alias("page_id"))
    read = P.extract_pages(rows.join(last, "page_id", "left_semi")).join(last, "page_id")
    return read.select("source", "document_key", F.sha2("structured_text", 256).alias("content_hash"), F.lit(signature).alias("signature"), "title", F.col("structured_text").alias("text"))


def children(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and chunks of rows (source, document_key, version, text); chunk_index counts through a document, part_index restarts with
    each section."""
    named = rows.withColumn("_id", F.concat_ws("\x1f", "document_key", "version"))
    keys = named.select("_id", "source", "document_key", "version")
    sections = chunking.split_sections(named, "_id")
    parts = chunking.split_chunks(sections, ["_id", "section_index", "heading"])
    index = F.row_number().over(chunking.Window.partitionBy("_id").orderBy("section_index", "part_index")) - 1
    chunks = parts.withColumn("chunk_index", index).join(keys, "_id").withColumnRenamed("chunk", "content")
    child = ["source", "document_key", "version", "section_index"]
    return sections.join(keys, "_id").select(*child, "heading", "content", "page"), chunks.select(*child, "part_index", "chunk_index", "heading", "content")


def gate(chunks: DataFrame, most_short: float = 0.5) -> DataFrame:
    """(source, chunks, reasons) of the chunks of new versions: why a source may not go ahead. Raw HTML, empty chunks, and more than this
    share of very short or useless ones."""
    told = chunk_quality.with_quality(chunks.withColumn("heading", F.coalesce("heading", F.lit(""))))
    n = told.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("raw_html").alias("raw"), F.count_if(F.btrim("content") == "").alias("empty"), F.count_if(F.col("very_short") | F.col("no_useful_text")).alias("weak"))
    why = reasons((F.col("raw") > 0, "raw_html"), (F.col("empty") > 0, "empty_chunks"), (F.col("weak") > most_short * F.col("chunks"), "little_text"))
    return n.select("source", "chunks", why.alias("reasons"))


def activate(arrived: DataFrame, stored: DataFrame, allowed: DataFrame, fetched: DataFrame, least: int = 1, most_short: float = 0.5) -> Activated:
    """Carries out the plan of arrived rows (as incoming gives them) against stored ones (source, document_key, version, status,
    content_hash, signature) for allowed sources (source); fetched: (source, pages), what was tried.

    A source with fewer than `least` readable pages fails; one whose new versions fail the gate is blocked; without changes it is
    unchanged, else active. Only active ones change in documents, and only their children are kept, so the swap is the table of documents
    alone. Run again on its own result, everything is unchanged. A null text has no children and counts as failed.
    """
    rows = cut(arrived, "arrived")
    plan = cut(rows.select("source", "document_key", "content_hash", "signature").join(lifecycle.plan_ingest(rows, stored), "document_key"), "plan")
    new = rows.join(plan.where("action <> 'skip'").select("document_key", "version"), "document_key")
    sections, chunks = (cut(df, name) for df, name in zip(children(new), ("sections", "chunks")))
    told = gate(chunks, most_short)
    per = plan.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("new", "new"), ("new_version", "changed"), ("skip", "unchanged"))])
    report = allowed.select("source").distinct().join(fetched.groupBy("source").agg(F.sum("pages").alias("fetched")), "source", "left").join(per, "source", "left").join(told, "source", "left")
    report = report.na.fill(0).withColumn("failed", F.greatest(F.col("fetched") - F.col("pages"), F.lit(0)))
    none = F.array().cast("array<string>")
    why = F.concat(F.coalesce("reasons", none), reasons((F.col("pages") < least, "no_pages"), ((F.col("new") + F.col("changed") > 0) & (F.col("chunks") == 0), "no_chunks")))
    status = F.when(F.col("pages") < least, "failed").when(F.size("why") > 0, "blocked").when(F.col("new") + F.col("changed") == 0, "unchanged").otherwise("active")
    report = cut(report.withColumn("why", why).withColumn("status", status).select("source", "fetched", "failed", "new", "changed", "unchanged", "chunks", F.concat_ws(",", "why").alias("reasons"), "status"), "report")
    passed = report.where("status = 'active'").select("source")
    let_in = rows.join(passed, "source", "left_semi").select("document_key", "content_hash", "signature", "source")
    documents = lifecycle.apply_ingest(stored.drop("source"), let_in.drop("source"))
    names = stored.select("document_key", "source").union(let_in.select("document_key", "source")).distinct()
    return Activated(documents.join(names, "document_key"), sections.join(passed, "source", "left_semi"), chunks.join(passed, "source", "left_semi"), report)


def written(result: Activated, path: str) -> None:
    """Writes a run's tables: children first, by source, documents last. Until these are written, readers that join children with active
    documents see the versions before; a run that is repeated overwrites its own partitions."""
    for name in ("sections", "chunks"):
        getattr(result, name).withColumn("v", F.col("version")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "v").parquet(f"{path}/{name}")
    result.documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/documents")
