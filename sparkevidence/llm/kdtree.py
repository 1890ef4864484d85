"""Sharding by k-d tree partitioning of document metadata (operator 10, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.llm.shared import bucket_count, saved, text_or_empty, unit_interval, with_prefix

SHARDS = 24
#: Bits of a dimension's value, then of a tie-breaker; equal texts stay together where the split allows it.
VALUE_BITS, TIE_BITS = 20, 34
#: Bits of the key that one pass of the distributed weighted median fixes.
PASS_BITS = 18
DIMENSIONS = ("length", "source", "lang")


def _keyed(docs: DataFrame) -> DataFrame:
    size = (F.octet_length(text_or_empty()) + 8).cast("long")
    top = F.lit(float(1 << VALUE_BITS))
    name = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(unit_interval(F.md5(F.col(c))))
    value = {"length": F.log2(size.cast("double")) / 64, "source": name("source"), "lang": name("lang")}
    crc = F.crc32(F.encode(text_or_empty(), "utf-8"))
    own = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc))
    tie = F.pmod(crc, F.lit(1 << 17)) * (1 << 17) + F.floor(unit_interval(own) * (1 << 17))
    keys = [(F.least(F.floor(value[d] * top), top - 1).cast("long") * (1 << TIE_BITS) + tie).alias(f"k{i}") for i, d in enumerate(DIMENSIONS)]
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), own.alias("h"), *keys)


def _medians(rows: DataFrame, goals: dict[int, tuple[int, int]]) -> dict[int, int]:
    """For each node the least key up to which its rows weigh at least its goal; goals: node to (dimension, bytes).

    Passes over key bits from the top: sizes are summed by node and leading bits where the rows are, only the bucket in which the
    goal falls goes on, and the driver sees one row for each node.
    """
    nodes = list(goals)
    bits, prefix, left = VALUE_BITS + TIE_BITS, {n: 0 for n in nodes}, {n: goals[n][1] for n in nodes}
    table = lambda f, kind: F.element_at(F.create_map(*[F.lit(x).cast(kind) if i % 2 else F.lit(x) for n in nodes for i, x in enumerate((n, f(n)))]), F.col("node"))
    key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(len(DIMENSIONS))]), table(lambda n: goals[n][0] + 1, "int"))
    own = rows.where(F.col("node").isin(nodes)).select("node", "size", key.alias("key"))
    while bits:
        step = min(PASS_BITS, bits)
        bits -= step
        inside = own.where(F.shiftright("key", bits + step) == table(lambda n: prefix[n], "long"))
        sums = inside.groupBy("node", F.shiftright("key", bits).alias("b")).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        cut = sums.withColumn("upto", upto).where(F.col("upto") >= table(lambda n: left[n], "long"))
        for r in cut.groupBy("node").agg(F.min("b").alias("b"), F.min_by("s", "b").alias("s"), F.min("upto").alias("upto")).collect():
            prefix[r["node"]], left[r["node"]] = r["b"], left[r["node"]] - (r["upto"] - r["s"])
    return prefix


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text, source, lang).

    The root holds all rows and is to give count leaves. A node of m leaves is split at the weighted median, the key up to which its
    rows weigh floor(m / 2) / m of its bytes, along its widest dimension (relative to the root's extent), until a node is one leaf;
    leaves then hold the target bytes, near equal. Values are ordered with a tie-breaker of text and doc_id, so one source with a
    third of all rows, or many copies of one text, is split like any other range. slot numbers a shard's rows without gaps.
    Nulls: no text has 0 bytes (size 8), null source and lang are values of their own, a null doc_id is a row like others. Rows
    equal in everything go to one shard. Empty tables give an empty result.
    """
    rows = saved(_keyed(docs).withColumn("node", F.lit(1)), "kd")
    n = rows.count()
    leaves, shard_of, extent = {1: (0, count)}, {}, None
    while leaves:
        for node in [x for x, (a, b) in leaves.items() if b - a == 1]:
            shard_of[node] = leaves.pop(node)[0]
        if not leaves or not n:
            break
        wide = [F.shiftright(F.max(f"k{i}"), TIE_BITS) - F.shiftright(F.min(f"k{i}"), TIE_BITS) for i in range(len(DIMENSIONS))]
        found = {r["node"]: r for r in rows.where(F.col("node").isin(list(leaves))).groupBy("node").agg(F.sum("size").alias("size"), F.array(*wide).alias("wide")).collect()}
        leaves = {node: r for node, r in leaves.items() if node in found}
        if not leaves:
            break
        extent = extent or [max(1, x) for x in found[1]["wide"]]
        goals = {}
        for node, (a, b) in leaves.items():
            r = found[node]
            widest = max(range(len(DIMENSIONS)), key=lambda i: r["wide"][i] / extent[i])
            goals[node] = (widest, max(1, r["size"] * ((b - a) // 2) // (b - a)))
        split = _medians(rows, goals)
        to = {node: (2 * node, 2 * node + 1) for node in leaves}
        go = F.col("node")
        for node, (d, _) in goals.items():
            go = F.when(F.col("node") == node, F.when(F.col(f"k{d}") <= F.lit(split[node]).cast("long"), to[node][0]).otherwise(to[node][1])).otherwise(go)
        rows = saved(rows.withColumn("node", go.cast("int")), "kd")
        leaves = {child: r for node, (a, b) in leaves.items() for child, r in zip(to[node], ((a, a + (b - a) // 2), (a + (b - a) // 2, b)))}
    final = F.lit(0)
    for node, shard in shard_of.items():
        final = F.when(F.col("node") == node, shard).otherwise(final)
    placed = rows.select("doc_id", "size", "text_crc32", "h", final.cast("int").alias("shard"), F.lit(1).cast("long").alias("one"))
    placed = placed.withColumn("bucket", F.floor(unit_interval(F.col("h")) * max(16, bucket_count(n) // count)))
    numbered = with_prefix(placed, ["shard"], "bucket", [F.col("h"), F.col("doc_id")], "one", "upto")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("upto") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
