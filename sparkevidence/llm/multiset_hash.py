"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 9, DataFrame functions only).

A paragraph hashes to a wide vector: WIDTH values of 48 bits, all of them set, and SKETCH small ones, of which one is 1 or -1. A
fingerprint is the sum of its paragraphs' vectors, wide entries modulo 2 ** 48, small ones modulo 2 ** 32. The order of paragraphs does
not matter, and inserting or deleting one is adding or subtracting its vector. The wide entries tell whether two texts have the same
paragraphs; the small ones are a linear sketch, whose inner products estimate how many paragraphs texts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.llm.shared import bucket_count, saved, text_or_empty, unit_interval

WIDTH = 32
BITS = 48
#: Small entries. An estimated likeness is off by about one over the square root of their number.
SKETCH = 256
#: Most ranges of doc_id, a power of two; their bounds are one array.
RANGES = 1 << 13
_MASK = (1 << BITS) - 1


def paragraphs(text: Column) -> Column:
    """Lines, cut further after sentence marks; blank ones do not count."""
    return F.filter(F.split(text, r"\n+|(?<=[.!?])[ \t]+"), lambda x: x != "")


def _wide(text: Column) -> Column:
    """array<bigint> of WIDTH entries below 2 ** BITS; all zero for a text without paragraphs."""
    two = F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(F.lit("place"), p).alias("a"), F.xxhash64(F.lit("value"), p).alias("b")))
    zero = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    entry = lambda p, i: F.coalesce(F.nullif(F.xxhash64(i, p["a"], p["b"]).bitwiseAND(F.lit(_MASK)), F.lit(0).cast("long")), F.lit(1).cast("long"))
    return F.aggregate(two, zero, lambda acc, p: F.transform(acc, lambda x, i: (x + entry(p, i)).bitwiseAND(F.lit(_MASK))))


def _entries(codes: Column) -> Column:
    """Sums of codes (place * 2 ** 33 + value, each value between -2 ** 32 and 2 ** 32), place by place, in order; zeros are left out."""
    long = lambda x: F.lit(x).cast("long")
    value = lambda c, at: c - F.shiftleft(at, 33)
    at = lambda c: F.shiftright(c + F.lit(1 << 32), 33)
    put = lambda s: F.when(s["v"] == 0, s["out"]).otherwise(F.concat(s["out"], F.array(F.shiftleft(s["at"], 33) + s["v"])))
    state = lambda out, place, v: F.struct(out.alias("out"), place.alias("at"), v.alias("v"))
    start = state(F.array().cast("array<bigint>"), long(-1), long(0))
    step = lambda s, c: F.when(at(c) == s["at"], state(s["out"], s["at"], s["v"] + value(c, at(c)))).otherwise(state(put(s), at(c), value(c, at(c))))
    return F.aggregate(F.array_sort(codes), start, step, put)


def _sketch(text: Column) -> Column:
    """array<bigint>: the small entries that are not zero, as place * 2 ** 33 + value."""
    hashed = F.transform(paragraphs(text), lambda p: F.xxhash64(F.lit("mark"), p))
    return _entries(F.transform(hashed, lambda h: F.shiftleft(F.pmod(h, F.lit(SKETCH)).cast("long"), 33) + F.when(h > 0, 1).otherwise(-1)))


def fingerprint(text: Column) -> Column:
    """struct<wide: array<bigint>, small: array<bigint>>: the WIDTH wide entries, and the small entries that are not zero."""
    return F.struct(_wide(text).alias("wide"), _sketch(text).alias("small"))


def _negated(small: Column) -> Column:
    """The same places with their values negated."""
    return F.transform(small, lambda c: F.shiftleft(F.shiftright(c + F.lit(1 << 32), 33), 34) - c)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))
    return F.struct(wide.alias("wide"), _entries(F.concat(a["small"], b["small"])).alias("small"))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs after those of b are deleted."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: (x - y + F.lit(1 << BITS)).bitwiseAND(F.lit(_MASK)))
    return F.struct(wide.alias("wide"), _entries(F.concat(a["small"], _negated(b["small"]))).alias("small"))


def as_text(a: Column) -> Column:
    """Hexadecimal digits: 12 for each wide entry, then, after a hyphen, 16 for each small entry with its place."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(a["wide"], lambda x: digits(x, BITS // 4)), ""), F.lit("-"), F.array_join(F.transform(a["small"], lambda x: digits(x, 16)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, between 0 and 1: their sketches' inner product by the sum of their squares without it (Tanimoto), an estimate
    of the common paragraphs' share of all where none is repeated; 1 for equal fingerprints."""
    square = lambda small: F.aggregate(small, F.lit(0.0), lambda s, c: s + F.pow((c - F.shiftleft(F.shiftright(c + F.lit(1 << 32), 33), 33)).cast("double"), 2))
    every = square(a["small"]) + square(b["small"])
    apart = square(_entries(F.concat(a["small"], _negated(b["small"]))))
    return F.when(a["wide"] == b["wide"], 1.0).when(every == 0, 0.0).otherwise(F.greatest((every - apart) / (every + apart), F.lit(0.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next row's text, in ascending
    order of doc_id; after the last comes the first. Rows are put into ranges of doc_id between quantiles, of some thousand rows each
    (at most RANGES of them), and the first row of the next range is added to each range, so no task orders more than its range.
    Nulls: a null text is empty; null doc_ids come last, in order and ranges of their text's SHA-256. Rows that repeat a doc_id follow
    in order of their text's SHA-256. A single row is its own next. Long texts are fingerprinted whole; other columns of docs are not
    looked at. Empty tables give an empty result.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.encode("text", "utf-8"), 256))
    n = rows.count()
    steps = min(RANGES, 1 << (bucket_count(n) - 1).bit_length())
    # Bounds that leave about as many rows in each range, however ids are spread; a binary search finds a row's range.
    at = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    bounds = saved(rows.agg(F.coalesce(F.percentile_approx("doc_id", at, 4 * steps), F.array().cast("array<bigint>")).alias("bounds")), "bounds")
    widths = F.array(*[F.lit(steps >> i) for i in range(1, steps.bit_length())])
    beyond = lambda lo, w: F.coalesce(F.get("bounds", lo + w - 1) < F.col("doc_id"), F.lit(False))
    place = F.aggregate(widths, F.lit(0), lambda lo, w: F.when(beyond(lo, w), lo + w).otherwise(lo))
    unnamed = F.lit(steps) + F.floor(unit_interval(F.col("sha")) * steps)
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.when(F.col("doc_id").isNull(), unnamed).otherwise(place).cast("long")).drop("bounds")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "sha")
    firsts = saved(rows.groupBy("bucket").agg(F.min(key).alias("k")), "firsts")
    order = Window.orderBy("bucket")
    first = firsts.agg(F.min_by("k", "bucket").alias("k0"))
    following = firsts.select("bucket", F.lead("k").over(order).alias("k")).crossJoin(F.broadcast(first)).select(F.col("bucket").alias("before"), F.coalesce("k", "k0").alias("k"))
    wanted = following.select("before", F.col("k.doc_id").alias("w_id"), F.col("k.sha").alias("w_sha"))
    heads = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("sha") == F.col("w_sha"))).select("before", "doc_id", "text").dropDuplicates(["before"])
    tail = heads.select(F.col("before").alias("bucket"), F.lit(1).alias("tail"), F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("sha"), "text")
    both = rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "sha", "text").union(tail).withColumn("fp", fingerprint(F.col("text")))
    along = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_last(), "sha")
    both = both.select("*", F.lead("text").over(along).alias("next_text"), F.lead("fp").over(along).alias("next_fp")).where("tail = 0")
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)).alias("edited"))
    both = both.select("doc_id", "n_chars", "fp", "next_fp", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
