"""The corpus pipeline: quality, near duplicates, repeated substrings, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkevidence.llm.cotraining import quality_stage
from sparkevidence.llm.merge_dropout import encode_stage
from sparkevidence.llm.minhash import dedup_stage
from sparkevidence.llm.mixing import mix_stage
from sparkevidence.llm.shared import saved
from sparkevidence.llm.suffix_dedup import dedup_stage as substring_stage

STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("repeated_substrings", substring_stage),
    ("mixture", mix_stage),
    ("token_ids", encode_stage),
]

#: The quality classifier and the tokenizer have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
