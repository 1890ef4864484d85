"""Structured Streaming jobs: intake assembly, page ingest, suggestion dedupe, log and staleness monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkevidence.sources.cuts import cut


def _seconds(column: str) -> Column:
    """Wall-clock seconds since 1970, for time stamps with or without a zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def assemble_intake(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's messages (user_id, event_id, ts, part) within a gap make one request; repeated ids count once. Works on streams and tables."""
    rows = messages.withWatermark("ts", late) if messages.isStreaming else messages
    rows = rows.dropDuplicates(["user_id", "event_id", "ts"])
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "part"))), lambda x: x["part"]), " ").alias("request"))
    return out.select("user_id", _seconds("w.start").alias("start_s"), _seconds("w.end").alias("end_s"), "parts", "request")


def monitor(logs: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of (ts, kind, value) rows by tumbling window and kind."""
    rows = logs.withWatermark("ts", late) if logs.isStreaming else logs
    out = rows.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return out.select(_seconds("w.start").alias("start_s"), "kind", "n", "mean")


def distinct_suggestions(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """(service, url, ts): the first of each (service, url) within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["service", "url"]) if rows.isStreaming else rows.dropDuplicates(["service", "url"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drives a stream over all that is there into Parquet."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: Parts of a stored table by hash of the key, unless a job is told otherwise; a micro-batch reads and writes those that its keys fall into.
PARTS = 64
_STORED = "document_key string, version int, status string, content_hash string, signature string"


def _part(parts: int, key: str = "document_key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def stored_versions(spark: SparkSession, target: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """What ingest_stream has stored in target: of each part its last generation, or the last one before a batch's number."""
    rows = spark.read.schema(f"{_STORED}, part int, g int").parquet(target)
    if parts is not None:
        rows = rows.where(F.col("part").isin(parts))
    if before is not None:
        rows = rows.where(F.col("g") < before)
    last = rows.groupBy("part").agg(F.max("g").alias("g"))
    return rows.join(F.broadcast(last), ["part", "g"], "left_semi").drop("part", "g")  # one row a part


def _drop_superseded(spark: SparkSession, target: str, number: int, parts: list[int]) -> None:
    """Deletes, of the parts that a batch wrote, the generations before the one that it was planned against, which stays in case it runs again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for part in parts:
        at = path(f"{target}/part={part}")
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = sorted(int(x.getPath().getName()[2:]) for x in files.listStatus(at) if x.getPath().getName().startswith("g="))
        earlier = [g for g in found if g < number]
        for g in earlier[:-1]:
            files.delete(path(f"{target}/part={part}/g={g}"), True)


def ingest_stream(pages: DataFrame, target: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Pages (document_key, content_hash, signature) arrive; each micro-batch is planned against the stored versions of the parts that
    its keys fall into, and these parts are written as a new generation, numbered by batch. A batch that runs twice writes the same
    generation again; parts without pages are neither read nor written, and of each part two generations are kept at most.

    parts: of the table, the same for all its life; some hundred thousand keys a part keep a batch of few keys small.
    """
    from sparkevidence.operators.lifecycle import apply_ingest

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        incoming = cut(batch.dropDuplicates(["document_key"]), "incoming")
        touched = [r[0] for r in incoming.select(_part(parts)).distinct().collect()]  # numbers of parts
        if touched:
            at = spark._jvm.org.apache.hadoop.fs.Path(target)
            known = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
            stored = stored_versions(spark, target, number, touched) if known else spark.createDataFrame([], _STORED)
            out = apply_ingest(stored, incoming).withColumns({"part": _part(parts), "g": F.lit(number)})
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "g").parquet(target)
            _drop_superseded(spark, target, number, touched)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staleness_monitor(spark: SparkSession, docs: DataFrame, now_s: int, days: int = 30) -> DataFrame:
    """(source_name, age_days, stale) of the latest document of each source; for use on each micro-batch."""
    age = F.greatest(F.floor((F.lit(now_s) - F.max("created_s")) / 86400), F.lit(0))
    return docs.groupBy("source_name").agg(age.alias("age_days")).withColumn("stale", F.col("age_days") > days)
