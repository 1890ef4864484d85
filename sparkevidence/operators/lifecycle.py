"""Versions, ingest plans, reconciliation, constraints and fingerprints of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.sources.cuts import cut


def latest_versions(docs: DataFrame, key: str = "document_key") -> DataFrame:
    """Each key's highest version: (key, version, document_id, status). A grouped maximum, which combines before its shuffle."""
    return docs.groupBy(key).agg(F.max(F.struct("version", "document_id", "status")).alias("m")).select(key, "m.version", "m.document_id", "m.status")


def active_versions(docs: DataFrame, key: str = "document_key") -> DataFrame:
    return latest_versions(docs.where(F.col("status") == "active"), key)


def plan_ingest(incoming: DataFrame, stored: DataFrame, key: str = "document_key") -> DataFrame:
    """(key, action, version) for incoming rows (key, content_hash, signature): skip where the active version has the same hash and
    signature, new where there is none, else new_version one above the latest."""
    latest = stored.groupBy(key).agg(F.max("version").alias("last"))
    active = stored.where("status = 'active'").groupBy(key).agg(F.max(F.struct("version", "content_hash", "signature")).alias("a"))
    rows = incoming.join(latest, key, "left").join(active, key, "left")
    same = (F.col("a.content_hash") == F.col("content_hash")) & (F.col("a.signature") == F.col("signature"))
    action = F.when(F.coalesce(same, F.lit(False)), "skip").when(F.col("last").isNull(), "new").otherwise("new_version")
    return rows.select(key, action.alias("action"), F.when(F.coalesce(same, F.lit(False)), F.col("a.version")).otherwise(F.coalesce("last", F.lit(0)) + 1).alias("version"))


def apply_ingest(stored: DataFrame, incoming: DataFrame, key: str = "document_key") -> DataFrame:
    """stored with the plan carried out: touched keys' active rows archived, the new versions active. Applying it again changes nothing."""
    # A union that claims its children's partitioning fails once adaptive execution has merged partitions of only one of them.
    stored.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    plan = plan_ingest(incoming, stored, key).where("action <> 'skip'")
    touched = plan.select(F.col(key).alias("_key"))
    kept = stored.join(touched, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_key").isNotNull() & (F.col("status") == "active"), "archived").otherwise(F.col("status"))
    kept = kept.withColumn("status", status).drop("_key")
    new = incoming.join(plan.select(key, "version"), key).withColumn("status", F.lit("active"))
    return kept.select(key, "version", "status", "content_hash", "signature").unionByName(new.select(key, "version", "status", "content_hash", "signature"))


def archive_exact(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Compare and set: a request (document_id, document_key, version) archives the active row that agrees in all three; done tells which did."""
    guards = ["document_id", "document_key", "version"]
    hit = docs.where("status = 'active'").select(*guards, F.lit(True).alias("done"))
    return requests.select(*guards).join(hit, guards, "left").withColumn("done", F.coalesce("done", F.lit(False)))


def snapshot_classes(active: DataFrame, discovered: DataFrame, key: str = "document_key") -> DataFrame:
    """(key, class): both sides' keys as unchanged, changed, missing (no longer discovered) or added."""
    a = active.select(F.col(key), F.col("content_hash").alias("old"))
    d = discovered.select(F.col(key), F.col("content_hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(d, key, "full_outer").select(key, kind.alias("class"))


def row_drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, drift): rows added, removed or modified between two tables of equal columns, by a hash of the whole row."""
    digest = lambda df, out: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(out))
    both = digest(before, "b").join(digest(after, "a"), key, "full_outer")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified")
    return both.where("a is null or b is null or a <> b").select(key, kind.alias("drift"))


def table_fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, digest): an order-free digest of each group: counts and sums of 32-bit row digests, which combine before the shuffle."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]), 256), 1, 8), 16, 10).cast("long")
    return df.withColumn("_h", h).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("_h").alias("digest"))


def violations(rules: list[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """(table, rule, n) for each rule (table, rule, rows, condition that must hold or be unknown)."""
    parts = [df.agg(F.count_if(~F.coalesce(holds, F.lit(True))).alias("n")).select(F.lit(t).alias("table"), F.lit(r).alias("rule"), "n") for t, r, df, holds in rules]
    return reduce(DataFrame.unionByName, parts)


def hydrated(rows: DataFrame, documents: DataFrame, on: str) -> DataFrame:
    """rows with the documents' columns; lost tells where there is no such document (any more)."""
    return rows.join(documents.withColumn("_there", F.lit(True)), on, "left").withColumn("lost", F.col("_there").isNull()).drop("_there")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def link_frontier(links: DataFrame, starts: DataFrame, depth: int, most: int) -> DataFrame:
    """(source, url, depth): breadth-first over links (url, target), or (source, url, target), from starts (source, url), to a depth and
    a number of pages a source. One join for each level; pages already seen are taken out by an anti join. Each level is written, so
    that none is worked out again for the next."""
    on = ["source", "url"] if "source" in links.columns else ["url"]
    level = cut(starts.select("source", "url", F.lit(0).alias("depth")).dropDuplicates(["source", "url"]))
    seen = level
    for d in range(1, depth + 1):
        step = level.join(links, on).select("source", F.col("target").alias("url")).distinct()
        level = cut(step.join(seen, ["source", "url"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(level)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("depth", "url"))
    return seen.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
