"""Suggested sources: taken up once by service and address, with a cooldown by service; reviews and previews move them on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.functions import text as T

#: What a preview's state makes of a pending suggestion, and what an owner may decide from each status. Fixed values.
BY_PREVIEW = {"ready": "preview_ready", "failed": "preview_failed", "needs_review": "pending", "already_connected": "already_connected"}
DECISIONS = {"pending": ("approved", "rejected"), "preview_ready": ("approved", "rejected"), "preview_failed": ("rejected",), "approved": ("activated", "activation_failed"), "activation_failed": ("approved", "rejected")}


def key_columns(service: Column, url: Column) -> tuple[Column, Column]:
    """A suggestion's key: normalised service and address."""
    return T.normalize_service_id(service), F.lower(T.normalize_url(url))


def upserted(stored: DataFrame, incoming: DataFrame, cooldown_s: int) -> DataFrame:
    """(service_id, url, suggestions, first_s, outcome) of incoming suggestions (service_id, url, ts) by key.

    reused: the key is stored (service_id, url, ts, status), whatever its status; cooling: a suggestion of the same service, of any
    status, is no older than the cooldown, or comes first in this run; else pending, a new one. Counts of services combine before
    their shuffle; of a service's new keys only the first in time (then by address) is looked for. Rows without service or address are
    no suggestions.
    """
    keyed = lambda df, *more: df.select(*[c.alias(n) for c, n in zip(key_columns(F.col("service_id"), F.col("url")), ("service_id", "url"))], *more).where("service_id <> '' and url <> ''")
    new = keyed(incoming, "ts").groupBy("service_id", "url").agg(F.count(F.lit(1)).alias("suggestions"), F.min("ts").alias("first_s"))
    old = keyed(stored, "ts")
    held = old.groupBy("service_id", "url").agg(F.lit(True).alias("_held"))
    last = old.groupBy("service_id").agg(F.max("ts").alias("_last"))
    rows = new.join(held, ["service_id", "url"], "left").join(last, "service_id", "left")
    first = rows.where("_held is null").groupBy("service_id").agg(F.min(F.struct("first_s", "url")).alias("_first"))
    rows = rows.join(first, "service_id", "left")
    warm = F.coalesce(F.col("first_s") - F.col("_last") < cooldown_s, F.lit(False))
    outcome = F.when(F.col("_held"), "reused").when(warm | (F.col("_first.url") != F.col("url")), "cooling").otherwise("pending")
    return rows.select("service_id", "url", "suggestions", "first_s", outcome.alias("outcome"))


def transitions(events: DataFrame) -> DataFrame:
    """(suggestion_id, status, preview_status, reviewed_at, refused) after events (suggestion_id, no, kind, value, ts): kind preview sets the
    preview's state and moves a pending or previewed suggestion by it, kind decision moves it where its status allows that.

    Each suggestion starts pending. An owner's decisions stamp reviewed_at, the last one counts; refused counts events that were not
    allowed. A fold in order of no, over the few events that one suggestion has.
    """
    text = lambda v: F.lit(v).cast("string")
    state = lambda status, preview, at, refused: F.struct(status.alias("status"), preview.alias("preview"), at.alias("at"), refused.alias("refused"))
    start = state(text("pending"), text(None), F.lit(None).cast("long"), F.lit(0).cast("long"))

    def moved(s: Column) -> Column:
        out = F.array().cast("array<string>")
        for status, allowed in DECISIONS.items():
            out = F.when(s["status"] == status, F.array(*[F.lit(a) for a in allowed])).otherwise(out)
        return out

    def by_preview(value: Column) -> Column:
        out = text(None)
        for preview, status in BY_PREVIEW.items():
            out = F.when(value == preview, text(status)).otherwise(out)
        return out

    def step(s: Column, e: Column) -> Column:
        previewed = by_preview(e["value"])
        open_ = s["status"].isin("pending", "preview_ready", "preview_failed")
        allowed = F.coalesce(F.array_contains(moved(s), e["value"]), F.lit(False))
        preview = F.when(previewed.isNotNull() & open_, state(previewed, e["value"], s["at"], s["refused"])).when(previewed.isNotNull(), state(s["status"], e["value"], s["at"], s["refused"])).otherwise(state(s["status"], s["preview"], s["at"], s["refused"] + 1))
        decision = F.when(allowed, state(e["value"], s["preview"], e["ts"], s["refused"])).otherwise(state(s["status"], s["preview"], s["at"], s["refused"] + 1))
        return F.when(e["kind"] == "preview", preview).otherwise(decision)

    ordered = events.groupBy("suggestion_id").agg(F.array_sort(F.collect_list(F.struct("no", "kind", "value", F.col("ts").cast("long").alias("ts")))).alias("e"))
    s = ordered.select("suggestion_id", F.aggregate("e", start, step).alias("s"))
    return s.select("suggestion_id", "s.status", F.col("s.preview").alias("preview_status"), F.col("s.at").alias("reviewed_at"), "s.refused")
