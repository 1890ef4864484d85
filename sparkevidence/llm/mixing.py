"""Mixing sources to target weights by weighted fair queueing (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.llm.shared import WORD, bucket_count, saved, text_or_empty, unit_interval, with_prefix

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share the total of all sizes; no target exceeds epochs
    times its source's size, and the excess is shared again by weight. That is a water level: sources are ordered by limit per unit
    of weight, and those under the level of the rest keep their limit. The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", w).withColumn("limit", F.col("source_size") * epochs)
    everything = Window.partitionBy()
    below = Window.orderBy(F.col("limit") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0))).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    kept = level.withColumn("capped", F.col("limit") / F.col("w") <= F.col("level"))
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("w"), "n", "level"))).over(everything)["level"]
    return kept.select("source", "source_size", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(water * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of docs.

    Each source's documents are shuffled by a keyed hash. A copy's virtual finish time is the words that its source has sent up to
    it, divided by the source's target; copies of a source follow each other in up to epochs passes. All copies are put in order
    of finish time (then hash and doc_id) and taken while their sizes fit the total budget, the sum of all sizes.
    Nulls: no text counts 0 words, a null source is a source of its own, a null doc_id is a row like any other. The hash is of
    doc_id, text and source, so rows without or with the same id are shuffled by themselves. Rows that are equal in all three columns
    are interchangeable. Empty documents take nothing, documents of any length are taken whole. Other columns of docs, whatever their
    names, are not looked at. An empty table gives an empty result.
    """
    rows = saved(docs.select("doc_id", "source", _words().alias("size"), _shuffled(seed).alias("h")), "mix")
    return _mixed(rows, weights, epochs).select("doc_id", "size", "source", "source_size", "target", "taken")


def _words() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _shuffled(seed: str) -> Column:
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(text_or_empty(), "utf-8")), source))


def _mixed(rows: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """mix() of written rows (doc_id, source, size, h), with h."""
    buckets = bucket_count(rows.count())
    targets = source_targets(rows, weights, epochs)
    order = [F.col("h"), F.col("doc_id"), F.col("size")]
    sent = with_prefix(rows.withColumn("bucket", F.floor(unit_interval(F.col("h")) * buckets)), ["source"], "bucket", order, "size", "sent")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    sent = saved(sent.drop("bucket").join(F.broadcast(t) if targets.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "sent")
    copies = sent.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    finish = (F.col("epoch") * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")
    copies = copies.select("doc_id", "source", "h", "size", finish.alias("finish")).withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(4.0)) * buckets))
    budget = sent.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("total")).withColumn("upto", F.sum("total").over(Window.orderBy("slot")))
    last = slots.crossJoin(F.broadcast(budget)).where("upto > budget").agg(F.min("slot").alias("slot"), F.min("upto").alias("upto"), F.min_by("total", "slot").alias("total"), F.first("budget").alias("budget")).first()
    if last["slot"] is None:
        taken = copies.select("doc_id", "source", "h", "size")
    else:
        room = last["budget"] - (last["upto"] - last["total"])
        within = Window.partitionBy("slot").orderBy("finish", "h", "doc_id", "size", "source").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.where(F.col("slot") == last["slot"]).withColumn("used", F.sum("size").over(within)).where(F.col("used") <= room)
        taken = copies.where(F.col("slot") < last["slot"]).select("doc_id", "source", "h", "size").union(edge.select("doc_id", "source", "h", "size"))
    # Rows equal in every column stand for each other, so their copies are dealt evenly.
    same = sent.groupBy("h", "doc_id", "source", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("rows"))
    got = taken.groupBy(F.col("h").alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    both = same.join(got, F.col("h") == F.col("k"), "left")
    each = both.withColumn("copies", F.coalesce("copies", F.lit(0))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    share = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("i") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return each.select("doc_id", "size", "source", "source_size", "target", (share * F.col("size")).alias("taken"), "h", share.cast("int").alias("copies"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it, whole; n copies are n equal rows.

    Nulls, ties, repeated and empty rows as in mix: a document without words is taken by no mix and goes. Columns and their order stay;
    an empty table gives an empty result.
    """
    rows = saved(docs.select("doc_id", "source", _words().alias("size"), _shuffled(SEED).alias("h")), "mix")
    out = _mixed(rows, WEIGHTS, EPOCHS).where("copies > 0")
    # Rows that are equal in id, text and source share their copies.
    out = out.groupBy(F.col("h").alias("__h")).agg(F.sum(F.col("copies").cast("long")).alias("__n"))
    alike = Window.partitionBy("__h")
    both = docs.withColumn("__k", _shuffled(SEED)).join(out.hint("merge"), F.col("__k") == F.col("__h"))
    both = both.select("*", F.row_number().over(alike.orderBy("__h")).alias("__i"), F.count(F.lit(1)).over(alike).alias("__rows"))
    own = F.floor(F.col("__n") / F.col("__rows")) + F.when(F.col("__i") <= F.col("__n") % F.col("__rows"), 1).otherwise(0)
    both = both.withColumn("__copies", own.cast("int")).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_CORE = """
    per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS n FROM per),
    weighed AS (SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM ranked),
    level AS (SELECT *, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER b, 0))::DOUBLE
                      / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lam
              FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (SELECT source, source_size, CASE WHEN cap::DOUBLE / w <= lam THEN cap::DOUBLE
                    ELSE w * (SELECT arg_min(lam, cap::DOUBLE / w * 1000000 + n) FROM level WHERE cap::DOUBLE / w > lam) END AS target FROM level),
    sent AS (SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
             FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    copies AS (SELECT *, (e.e * source_size + sent)::DOUBLE / target AS finish FROM sent, (SELECT unnest([0, 1, 2]) AS e) e WHERE size > 0),
    queued AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, size, source ROWS UNBOUNDED PRECEDING) AS used FROM copies),
    got AS (SELECT doc_id, sum(size) AS taken FROM queued WHERE used <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
"""
ORACLE_SQL = f"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS size,
                 md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || coalesce('s' || source, 'none')) AS h FROM documents),
    {ORACLE_CORE}
    SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, s.source_size, s.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
    FROM sent s LEFT JOIN got g ON g.doc_id = s.doc_id
"""
