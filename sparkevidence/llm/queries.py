"""Queries of the training-data operators over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkevidence.llm import chroma, cotraining, kdtree, licenses, merge_dropout, minhash, mixing, multiset_hash, orc_tokens, ppm, spelling, suffix_dedup, whitening


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(chroma.recordings(_table(spark, sf_dir)))


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.tokenized(_table(spark, sf_dir))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trip(_table(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir))


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(_table(spark, sf_dir))


def op10_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shards(_table(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_chroma, op2_orc_tokens, op3_merge_dropout, op4_mixing, op5_suffix_dedup, op6_cotraining, op7_minhash, op8_licenses, op9_multiset_hash, op10_kd_tree, op11_whitening, op12_ppm, op13_spelling)}

ORACLES = {"op4_mixing": mixing.ORACLE_SQL, "op7_minhash": minhash.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
