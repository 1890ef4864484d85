"""Corpus tables that the given tables lack (versions, sections, chunks, questions), derived by formula in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_PER_SECTION = 8
#: Neighbouring ids that share a key if their source is the same.
IDS_PER_KEY = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned documents: a few neighbouring ids of a source share a key, so keys grow with the table; versions by doc_id, every 17th a
    draft, the highest other version active."""
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / IDS_PER_KEY).cast("string"))
    rows = d.select(
        F.col("doc_id").alias("document_id"), key.alias("document_key"), F.col("source").alias("source_name"), F.col("lang").alias("course"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), "text", (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_s"),
    )
    rows = rows.withColumn("version", F.row_number().over(Window.partitionBy("document_key").orderBy("document_id")))
    settled = F.max(F.when(F.col("document_id") % 17 != 0, F.col("version"))).over(Window.partitionBy("document_key"))
    status = F.when(F.col("document_id") % 17 == 0, "draft").when(F.col("version") == settled, "active").otherwise("archived")
    return rows.withColumn("status", status)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def chunks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One chunk for each run of LINES_PER_SECTION lines: (document_id, chunk_index, heading, content, course, source_name). of: the
    document_id of those that are wanted; others are not cut at all."""
    d = table(spark, sf_dir, "documents")
    if of is not None:
        d = d.join(of, d["doc_id"] == of["document_id"], "left_semi")
    all_lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(all_lines) - 1) / LINES_PER_SECTION).cast("int"))
    rows = d.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("course"), F.col("source").alias("source_name"), all_lines.alias("ls"), F.explode(starts).alias("chunk_index"))
    part = F.slice("ls", F.col("chunk_index") * LINES_PER_SECTION + 1, LINES_PER_SECTION)
    return rows.select("document_id", "chunk_index", F.element_at(part, 1).alias("heading"), F.array_join(part, "\n").alias("content"), "course", "source_name")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


SQL = {
    "docs": f"""docs0 AS (SELECT doc_id AS document_id, source || '/' || (doc_id // {IDS_PER_KEY}) AS document_key, source AS source_name, lang AS course,
        split_part(text, chr(10), 1) AS title, text, 1704067200 + doc_id * 60 AS created_s,
        row_number() OVER (PARTITION BY source || '/' || (doc_id // {IDS_PER_KEY}) ORDER BY doc_id) AS version FROM documents),
    docs AS (SELECT *, CASE WHEN document_id % 17 = 0 THEN 'draft' WHEN version = max(CASE WHEN document_id % 17 <> 0 THEN version END) OVER (PARTITION BY document_key)
        THEN 'active' ELSE 'archived' END AS status FROM docs0)""",
    "lines": """lines AS (SELECT doc_id AS document_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)""",
    "chunks": """chunks0 AS (SELECT doc_id AS document_id, lang AS course, source AS source_name, string_split(text, chr(10)) AS ls,
        unnest(range((len(string_split(text, chr(10))) - 1) // 8 + 1)) AS chunk_index FROM documents),
    chunks AS (SELECT document_id, chunk_index, ls[chunk_index * 8 + 1] AS heading, array_to_string(ls[chunk_index * 8 + 1 : chunk_index * 8 + 8], chr(10)) AS content, course, source_name FROM chunks0)""",
    "questions": "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)",
}


def with_sql(*names: str, then: str) -> str:
    """A DuckDB statement over the derived tables named."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + then
