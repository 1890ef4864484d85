"""Files: text and JSON corpora in, versioned tables, logs and reports out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkevidence.functions.text import clean_heading, title_of

EVAL_CASE = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.StringType()), ("category", T.StringType()), ("question", T.StringType()), ("expected_documents", T.ArrayType(T.StringType())), ("forbidden_documents", T.ArrayType(T.StringType())), ("expected_answer_terms", T.ArrayType(T.StringType())), ("forbidden_answer_terms", T.ArrayType(T.StringType())), ("expected_answer_mode", T.StringType()), ("expected_source_count_max", T.IntegerType()), ("must_not_use_discarded_candidates", T.BooleanType()), ("expected_supported_points", T.ArrayType(T.StringType())), ("requires_sources", T.BooleanType()))]
)


def document_key(spark: SparkSession, path: Column, root: str) -> Column:
    """A file's path below root, as the stable key. path: its address, with escapes, as Spark's readers give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri().getPath().rstrip("/")
    plain = F.url_decode(F.replace(F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return F.substring(plain, F.lit(len(full) + 2), F.length(plain))


def scan_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(document_key, title, text) of every .txt, .md and .markdown file below root; the title leads the text."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").text(root, wholetext=True)
    rows = raw.select(document_key(spark, F.col("_metadata.file_path"), root).alias("document_key"), "value")
    title = title_of(F.col("value"), F.regexp_replace(F.regexp_extract("document_key", "([^/]+)$", 1), r"\.[a-z]+$", ""))
    return rows.select("document_key", title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n"), "value").alias("text"))


def _flat(x: object) -> list[str]:
    """Leaves with their paths, in order, without recursion."""
    out, todo = [], [("", x)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            out.append(f"- {path}: {value}")
    return out


def _flattened(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in values:
        rows = []
        for v in batch:
            try:
                x = json.loads(v)
            except (TypeError, ValueError, RecursionError):  # the last: nested deeper than the parser goes
                rows.append(([], None, False))
                continue
            title = next((str(x[k]) for k in ("title", "name", "filename") if isinstance(x, dict) and x.get(k)), None)
            rows.append((_flat(x), title, True))
        yield pd.DataFrame(rows, columns=["lines", "title", "valid"])


def scan_json_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(document_key, title, text, valid): JSON files as lines "- path: value"; invalid JSON is kept raw."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rows = raw.select(document_key(spark, F.col("_metadata.file_path"), root).alias("document_key"), "value")
    rows = rows.withColumn("x", F.pandas_udf(_flattened, "lines array<string>, title string, valid boolean")("value"))
    text = F.when(F.col("x.valid"), F.array_join("x.lines", "\n")).otherwise(F.col("value"))
    return rows.select("document_key", clean_heading(F.coalesce("x.title", "document_key")).alias("title"), text.alias("text"), "x.valid")


def scan_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a strict schema; a malformed file fails."""
    return spark.read.schema(EVAL_CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, answer, answer_mode, documents, sources): loosely named fields joined under one name each."""
    fields = "case_id string, id string, answer string, final_answer string, answer_mode string, mode string, documents array<string>, selected_documents array<string>, sources array<string>, final_sources array<string>"
    raw = spark.read.schema(fields).option("multiLine", True).json(path)
    lists = lambda a, b: F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    return raw.select(F.coalesce("case_id", "id").alias("case_id"), F.coalesce("answer", "final_answer").alias("answer"), F.coalesce("answer_mode", "mode").alias("answer_mode"), lists(F.col("documents"), F.col("selected_documents")).alias("documents"), lists(F.col("sources"), F.col("final_sources")).alias("sources"))


def write_versioned(df: DataFrame, path: str, by: tuple[str, ...] = ("workspace_id", "source_name")) -> None:
    """Overwrites only the partitions that df touches."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str, day: str = "dt") -> None:
    df.write.mode("append").partitionBy(day).parquet(path)


def export_baseline(df: DataFrame, path: str, secret: tuple[str, ...] = ("password", "token", "secret", "api_key")) -> None:
    """Rows without columns of secret names, as a snapshot."""
    df.drop(*[c for c in df.columns if any(s in c.lower() for s in secret)]).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, run: str = "run_id") -> None:
    df.write.mode("append").partitionBy(run).json(path)
