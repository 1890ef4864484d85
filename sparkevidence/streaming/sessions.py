"""Requests and sessions of users by keyed state: parts of several messages are put together until a flush, a new topic or a silence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of parts; "flush" ends a request, "topic" ends what is open and begins anew.
PARTS = ("text", "image", "file")
REQUEST = "user_id long, request_no long, topic string, text string, images array<string>, files array<string>, message_ids array<long>, parts int, opened_ms long, closed_ms long, closed_by string"
_BLANK = " \t\r\n\f\v"
#: Rows of a state of one user.
_DRAFT, _PART, _ID, _AT = "request_no long, topic string, opened_ms long, last_ms long", "message_id long, kind string, body string", "message_id long", "ms long"


class Requests(StatefulProcessor):
    """Keyed state of a user: the open draft, its parts one by one, and the ids that were seen. Late repeats count once while their ids
    are kept: `keep_ms` after they came, at least. An event-time timer ends drafts after `gap_ms` of silence."""

    def __init__(self, gap_ms: int, keep_ms: int) -> None:
        self.gap_ms, self.keep_ms = gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft, self.parts = handle.getValueState("draft", _DRAFT), handle.getListState("parts", _PART)
        self.seen = handle.getMapState("seen", _ID, _AT)

    def _close(self, user: int, by: str, at_ms: int, out: list[tuple]) -> None:
        number, topic, opened, last = self.draft.get()
        parts = list(self.parts.get())
        if parts:
            body = lambda kind: [p[2] for p in parts if p[1] == kind]
            out.append((user, number, topic, "\n".join(body("text")), body("image"), body("file"), [p[0] for p in parts], len(parts), opened, at_ms, by))
        self.parts.clear()
        self.draft.update((number + bool(parts), None, None, None))

    def _silent(self, user: int, now_ms: int, out: list[tuple]) -> None:
        if self.draft.exists() and self.draft.get()[3] is not None and now_ms - self.draft.get()[3] > self.gap_ms:
            self._close(user, "silence", self.draft.get()[3] + self.gap_ms, out)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        user, out, last = key[0], [], None
        if not self.draft.exists():
            self.draft.update((0, None, None, None))
        batch = pd.concat(list(rows)).sort_values(["ms", "message_id"])
        for ms, number, kind, body in zip(batch["ms"].tolist(), batch["message_id"].tolist(), batch["kind"].tolist(), batch["body"].tolist()):
            if self.seen.containsKey((number,)):
                continue
            self.seen.updateValue((number,), (ms,))
            self._silent(user, ms, out)
            if kind == "flush":
                self._close(user, "flush", ms, out)
                continue
            request, topic, opened, _ = self.draft.get()
            if kind == "topic":
                self._close(user, "topic", ms, out)
                request, topic, opened = self.draft.get()[0], body, ms
            elif body is not None and body.strip(_BLANK):
                self.parts.appendValue((number, kind, body.strip(_BLANK)))
            self.draft.update((request, topic, ms if opened is None else opened, ms))
            last = ms
        if last is not None:
            self.handle.registerTimer(last + self.gap_ms + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REQUEST.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.draft.exists():
            self._silent(key[0], now, out)
        for number, ms in [(k, v[0]) for k, v in self.seen.iterator()]:
            if ms + self.keep_ms < now:
                self.seen.removeKey(number)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REQUEST.split(", ")])

    def close(self) -> None:
        pass


def _rows(messages: DataFrame) -> DataFrame:
    return messages.select("user_id", "message_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "kind", "body").where(F.col("user_id").isNotNull() & F.col("message_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*PARTS, "flush", "topic"))


def requests_stream(messages: DataFrame, gap_minutes: int = 30, late: str = "1 hour", keep_hours: int = 24) -> DataFrame:
    """Requests of a stream of messages (user_id, message_id, ts, kind, body), as they close: REQUEST.

    A request is what a user sent since the last flush, topic or silence of more than the gap. Blank parts say nothing; a request without
    parts is none. Ids that repeat count once, the first in time. Rows later than the watermark are dropped; rows without user, id or
    time, and other kinds, are no messages. Needs the RocksDB state store.
    """
    rows = _rows(messages.withWatermark("ts", late))
    return rows.groupBy("user_id").transformWithStateInPandas(Requests(gap_minutes * 60_000, keep_hours * 3_600_000), REQUEST, "Append", "EventTime")


def requests(messages: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """The same of a table; what is still open at its end is closed_by "open" (closed_ms null)."""
    gap = gap_minutes * 60_000
    first = F.row_number().over(Window.partitionBy("user_id", "message_id").orderBy("ms", "kind", "body"))
    rows = _rows(messages).withColumn("_r", first).where("_r = 1")
    along = Window.partitionBy("user_id").orderBy("ms", "message_id")
    # A silence counts from the last message that opened or went on with a draft; a flush leaves none.
    before = F.lag(F.when(F.col("kind") != "flush", F.col("ms"))).over(along)
    silent = F.col("ms") - before > gap
    ended = F.lag("kind").over(along) == "flush"
    begins = F.coalesce(silent, F.lit(False)) | F.coalesce(ended, F.lit(False)) | (F.col("kind") == "topic")
    rows = rows.withColumn("g", F.sum(begins.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    part = (F.col("kind").isin(*PARTS)) & (F.btrim("body", F.lit(_BLANK)) != "")
    put = F.collect_list(F.when(part, F.struct("ms", "message_id", "kind", F.btrim("body", F.lit(_BLANK)).alias("body"))))
    drafts = rows.groupBy("user_id", "g").agg(
        F.array_sort(put).alias("p"), F.min(F.when(F.col("kind") != "flush", F.col("ms"))).alias("opened_ms"), F.max(F.when(F.col("kind") != "flush", F.col("ms"))).alias("last_ms"),
        F.min(F.when(F.col("kind") == "flush", F.col("ms"))).alias("flushed"), F.min("ms").alias("first_ms"), F.max(F.when(F.col("kind") == "topic", F.col("body"))).alias("topic"), F.min_by("kind", F.struct("ms", "message_id")).alias("first_kind"),
    )
    next_ = Window.partitionBy("user_id").orderBy("g")
    drafts = drafts.withColumns({"next_ms": F.lead("first_ms").over(next_), "next_kind": F.lead("first_kind").over(next_)}).where(F.size("p") > 0)
    quiet = F.col("next_ms") - F.col("last_ms") > gap
    by = F.when(F.col("flushed").isNotNull(), "flush").when(quiet, "silence").when(F.col("next_kind") == "topic", "topic").otherwise("open")
    at = F.when(F.col("flushed").isNotNull(), F.col("flushed")).when(quiet, F.col("last_ms") + gap).when(F.col("next_kind") == "topic", F.col("next_ms"))
    body = lambda kind: F.transform(F.filter("p", lambda x: x["kind"] == kind), lambda x: x["body"])
    number = F.row_number().over(next_) - 1
    return drafts.select(
        "user_id", number.cast("long").alias("request_no"), "topic", F.array_join(body("text"), "\n").alias("text"), body("image").alias("images"), body("file").alias("files"), F.transform("p", lambda x: x["message_id"]).alias("message_ids"),
        F.size("p").alias("parts"), "opened_ms", at.alias("closed_ms"), by.alias("closed_by"),
    )


def sessions(closed: DataFrame) -> DataFrame:
    """(user_id, session_no, topic, requests, opened_ms, closed_ms): a user's sessions, of which a new topic ends the one before; the last
    is open (closed_ms null). closed: requests as above. A topic under which nothing was asked is none."""
    along = Window.partitionBy("user_id").orderBy("request_no")
    fresh = (F.col("topic").isNotNull() & (F.col("request_no") > 0)).cast("long")
    numbered = closed.withColumn("session_no", F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("user_id", "session_no").agg(F.max("topic").alias("topic"), F.count(F.lit(1)).alias("requests"), F.min("opened_ms").alias("opened_ms"))
    return out.withColumn("closed_ms", F.lead("opened_ms").over(Window.partitionBy("user_id").orderBy("session_no")))
