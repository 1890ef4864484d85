"""All registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkevidence.plans import activation_queries, answer_queries, catalog_queries, containment_queries, corpus_queries, evaluation_queries, evidence_queries, governance_queries, ingest_queries, manifest_queries, mining_queries, repair_queries, retrieval_queries, review_queries, search_queries, streaming_queries, structure_queries, succession_queries, verification_queries  # noqa: F401
from sparkevidence.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to their five best documents."""
    return QUERIES["top_documents"](spark, sf_dir)
