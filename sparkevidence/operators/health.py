"""States of sources: freshness against thresholds, and which state comes first where several fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.operators.retrieval import small

DEFAULT_DAYS = 30


def age_days(latest_s: Column, now_s: int) -> Column:
    """Whole days that have passed, not below 0; null without a time."""
    return F.when(latest_s.isNotNull(), F.greatest(F.floor((F.lit(now_s) - latest_s) / 86400), F.lit(0).cast("long")))


def source_health(status: DataFrame, policy: DataFrame, now_s: int, default: int | None = DEFAULT_DAYS, services: DataFrame | None = None) -> DataFrame:
    """status with threshold, age_days and health. status: (source_name, total, active, latest_s, quality), one row a source; policy:
    (source_name, days), for sources with a threshold of their own. Next counts that of a source's service, from services (service_id,
    days) where status has a service_id; then the column refresh_days, how often it is to be fetched anew, where status has one; then the
    default. Thresholds below one day are none.

    The first that fits: unknown (nothing is known of the source, or no threshold), inactive, failed (quality FAIL), warning
    (quality WARN), stale (older than the threshold), healthy; an active source without a time is unknown.
    """
    given = lambda c: F.when(F.col(c) >= 1, F.col(c))
    rows = status.join(small(policy), "source_name", "left")
    levels = [given("days")]
    if services is not None and "service_id" in status.columns:
        rows = rows.join(small(services.select("service_id", F.col("days").alias("_service_days"))), "service_id", "left")
        levels.append(given("_service_days"))
    if "refresh_days" in status.columns:
        levels.append(given("refresh_days"))
    rows = rows.withColumn("threshold", F.coalesce(*levels, F.lit(default).cast("int"))).drop("days", "_service_days")
    rows = rows.withColumn("age_days", age_days(F.col("latest_s"), now_s))
    state = (
        F.when((F.coalesce("total", F.lit(0)) == 0) | F.col("threshold").isNull(), "unknown")
        .when(F.col("active") == 0, "inactive")
        .when(F.col("quality") == "FAIL", "failed")
        .when(F.col("quality") == "WARN", "warning")
        .when(F.col("age_days").isNull(), "unknown")
        .when(F.col("age_days") > F.col("threshold"), "stale")
        .otherwise("healthy")
    )
    return rows.withColumn("health", state)
