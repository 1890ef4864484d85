"""Streaming operators in their batch form over the events table; tests hold the streams against these."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkevidence.plans import corpus
from sparkevidence.plans.base import query
from sparkevidence.plans.corpus import with_sql
from sparkevidence.streaming import jobs
from sparkevidence.streaming import sessions as S


def messages(events):
    return events.select("user_id", "event_id", "ts", F.col("event_type").alias("part"))


@query("""WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS end_s, count(*) AS parts, string_agg(event_type, ' ' ORDER BY ts, event_id) AS request FROM s GROUP BY user_id, k""")
def assemble_intake(spark, sf_dir):
    return jobs.assemble_intake(messages(corpus.table(spark, sf_dir, "events")))


@query("SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS start_s, event_type AS kind, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def evidence_log_monitor(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    return jobs.monitor(e.select("ts", F.col("event_type").alias("kind"), "value"))


@query(with_sql("docs", then="SELECT source_name, greatest((1707523200 - max(created_s)) // 86400, 0) AS age_days, greatest((1707523200 - max(created_s)) // 86400, 0) > 30 AS stale FROM docs GROUP BY 1"))
def staleness_monitor(spark, sf_dir):
    return jobs.staleness_monitor(spark, corpus.documents(spark, sf_dir), 1707523200)


@query("SELECT DISTINCT user_id AS service, event_type AS url FROM events")
def suggestion_dedupe_stream(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.col("event_type").alias("url"), "ts")
    return jobs.distinct_suggestions(e).select("service", "url")


#: Kinds of messages that the kinds of events stand for.
KINDS = {"signup": "topic", "purchase": "flush", "click": "text", "view": "image", "error": "file"}
_GAP = 12 * 60
_REQUESTS = f"""m AS (SELECT user_id, event_id AS message_id, epoch_us(ts) // 1000 AS ms, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS body FROM events),
    l AS (SELECT *, lag(CASE WHEN kind <> 'flush' THEN ms END) OVER w AS before, lag(kind) OVER w AS k FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ms, message_id)),
    g AS (SELECT *, sum(CASE WHEN coalesce(ms - before > {_GAP * 60000}, false) OR coalesce(k = 'flush', false) OR kind = 'topic' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, message_id) AS g FROM l),
    p AS (SELECT *, kind NOT IN ('flush', 'topic') AND trim(body) <> '' AS part FROM g),
    d AS (SELECT user_id, g, coalesce(string_agg(body, chr(10) ORDER BY ms, message_id) FILTER (WHERE part AND kind = 'text'), '') AS text, count(*) FILTER (WHERE part AND kind = 'image') AS images, count(*) FILTER (WHERE part AND kind = 'file') AS files,
        string_agg(message_id, ' ' ORDER BY ms, message_id) FILTER (WHERE part) AS ids, count(*) FILTER (WHERE part) AS parts, min(ms) FILTER (WHERE kind <> 'flush') AS opened_ms, max(ms) FILTER (WHERE kind <> 'flush') AS last_ms, min(ms) FILTER (WHERE kind = 'flush') AS flushed, min(ms) AS first_ms,
        max(body) FILTER (WHERE kind = 'topic') AS topic, first(kind ORDER BY ms, message_id) AS first_kind FROM p GROUP BY ALL),
    n AS (SELECT *, lead(first_ms) OVER w AS next_ms, lead(first_kind) OVER w AS next_kind FROM d WINDOW w AS (PARTITION BY user_id ORDER BY g)),
    r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY g) - 1 AS request_no, topic, text, images, files, ids, parts, opened_ms, CASE WHEN flushed IS NOT NULL THEN 'flush' WHEN next_ms - last_ms > {_GAP * 60000} THEN 'silence' WHEN next_kind = 'topic' THEN 'topic' ELSE 'open' END AS closed_by,
        CASE WHEN flushed IS NOT NULL THEN flushed WHEN next_ms - last_ms > {_GAP * 60000} THEN last_ms + {_GAP * 60000} WHEN next_kind = 'topic' THEN next_ms END AS closed_ms FROM n WHERE parts > 0)"""


def user_messages(events):
    """Events as messages: kinds by KINDS, every eleventh blank."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return events.select("user_id", F.col("event_id").alias("message_id"), "ts", kind.alias("kind"), F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("props")).alias("body"))


@query(f"WITH {_REQUESTS} SELECT * FROM r")
def intake_requests(spark, sf_dir):
    """Requests put together from parts of three kinds, ended by a flush, a new topic or twelve hours of silence; tests hold the stream
    against this."""
    out = S.requests(user_messages(corpus.table(spark, sf_dir, "events")), _GAP)
    return out.withColumns({"images": F.size("images"), "files": F.size("files"), "ids": F.array_join(F.transform("message_ids", lambda x: x.cast("string")), " ")}).drop("message_ids")


@query(f"""WITH {_REQUESTS}, s AS (SELECT *, sum(CASE WHEN topic IS NOT NULL AND request_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY request_no) AS session_no FROM r),
    a AS (SELECT user_id, session_no, max(topic) AS topic, count(*) AS requests, min(opened_ms) AS opened_ms FROM s GROUP BY 1, 2) SELECT *, lead(opened_ms) OVER (PARTITION BY user_id ORDER BY session_no) AS closed_ms FROM a""")
def topic_sessions(spark, sf_dir):
    """A user's sessions: a new topic closes the open one."""
    return S.sessions(S.requests(user_messages(corpus.table(spark, sf_dir, "events")), _GAP))
