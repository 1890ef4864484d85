import datetime

import pytest
from pyspark.sql import functions as F

from sparkevidence.streaming import sessions

KIND = "user_id long, message_id long, ts timestamp, kind string, body string"
AT = datetime.datetime(2024, 5, 1, 8)


def message(user, number, minute, kind, body="x"):
    return user, number, AT + datetime.timedelta(minutes=minute), kind, body


MESSAGES = [
    message(1, 1, 0, "text", " first "), message(1, 2, 1, "image", "a.png"), message(1, 2, 1, "image", "a.png"), message(1, 3, 2, "file", "b.pdf"), message(1, 4, 3, "text", "second"), message(1, 5, 4, "flush", None),
    message(1, 6, 5, "text", "after"), message(1, 7, 50, "text", "later"), message(1, 8, 51, "topic", "new topic"), message(1, 9, 52, "text", "on topic"), message(1, 10, 53, "flush", ""), message(1, 11, 54, "text", "left open"),
    message(2, 1, 0, "topic", "t"), message(2, 2, 1, "text", "  "), message(2, 3, 2, "flush"), message(2, 4, 3, "flush"), message(2, 5, 60, "text", "alone"), message(2, 6, 120, "flush"),
    message(3, 1, 10, "topic", "nothing asked"), message(3, 2, 100, "text", "asked"), message(3, 3, 101, "topic", "other"), message(3, 4, 102, "text", "more"), message(3, 5, 103, "flush"),
    message(4, 1, 1, "voice", "no kind of ours"), message(None, 1, 1, "text"), message(4, None, 1, "text"), (5, 1, None, "text", "x"), message(9, 1, 600, "text", "moves the watermark"), message(9, 2, 601, "flush"),
]


def plain(messages, gap=30):
    """One loop over each user's messages."""
    out = []
    for user in sorted({m[0] for m in messages if m[0] is not None}):
        seen, draft, number = set(), None, 0

        def close(by):
            nonlocal draft, number
            if draft and draft["parts"]:
                out.append((user, number, draft["topic"], [b for _, k, b in draft["parts"] if k == "text"], [i for i, _, _ in draft["parts"]], by))
                number += 1
            draft = None

        for _, i, ts, kind, body in sorted((m for m in messages if m[0] == user and m[1] is not None and m[2] is not None and m[3] in (*sessions.PARTS, "flush", "topic")), key=lambda m: (m[2], m[1])):
            if i in seen:
                continue
            seen.add(i)
            if draft and ts - draft["last"] > datetime.timedelta(minutes=gap):
                close("silence")
            if kind in ("flush", "topic"):
                close(kind)
            if kind != "flush":
                draft = draft or {"topic": body if kind == "topic" else None, "parts": []}
                draft["last"] = ts
                if kind != "topic" and (body or "").strip():
                    draft["parts"].append((i, kind, body.strip()))
        close("open")
    return out


def told(rows):
    return sorted((r["user_id"], r["request_no"], r["topic"] or "", r["text"], tuple(r["message_ids"]), r["closed_by"]) for r in rows)


def wanted(messages):
    return sorted((u, n, t or "", "\n".join(x), tuple(i), by) for u, n, t, x, i, by in plain(messages))


def test_requests_of_a_table(spark):
    got = sessions.requests(spark.createDataFrame(MESSAGES, KIND).repartition(3)).collect()
    assert told(got) == wanted(MESSAGES)
    assert {r["closed_by"] for r in got} == {"flush", "silence", "topic", "open"}
    one = next(r for r in got if (r["user_id"], r["request_no"]) == (1, 0))
    assert (one["images"], one["files"], one["parts"]) == (["a.png"], ["b.pdf"], 4)
    assert sessions.requests(spark.createDataFrame([], KIND)).count() == 0


def test_sessions_close_on_a_new_topic(spark):
    closed = sessions.requests(spark.createDataFrame(MESSAGES, KIND))
    got = {(r["user_id"], r["session_no"]): (r["topic"], r["requests"], r["closed_ms"] is None) for r in sessions.sessions(closed).collect()}
    assert got[1, 0] == (None, 3, False) and got[1, 1] == ("new topic", 2, True) and got[3, 0] == (None, 1, False) and got[3, 1] == ("other", 1, True)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_stream_gives_the_same_over_a_restart(rocks, tmp_path):
    """Messages arrive in files; the stream stops between them and goes on from its checkpoint with drafts and seen ids."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ordered = sorted((m for m in MESSAGES if m[2] is not None), key=lambda m: m[2])
    for part in (ordered[:9], ordered[9:20], ordered[20:]):
        rocks.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = sessions.requests_stream(rocks.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = told(rocks.read.parquet(out).collect())
    # What the table form leaves open ended by silence once the watermark had passed it.
    assert got == sorted((*w[:5], "silence") if w[5] == "open" else w for w in wanted(MESSAGES))
