"""MinHash near-duplicate removal with fast similarity sketches (operator 7).

Sketch: in round i every shingle is hashed to one of t bins with a value in [i, i + 1); a bin keeps its least value. From round t on
the bin is fixed (i - t), so after 2t rounds every coordinate is filled, and each is a fair min-hash with Chernoff-type concentration
(fast similarity sketching). Bands of r coordinates give candidate buckets; every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkevidence.llm.hashing import BASE, BASE2, U, mix, shingle_hashes, word_hashes
from sparkevidence.llm.shared import arrow_bytes, components, saved, slices, small_batches, unused

#: A pair with similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 40 = 6e-6.
ROWS, BANDS = 6, 40
#: Members of a bucket that one task compares, and shingles that they have; larger buckets are dealt out as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Bytes of text that are hashed at once (or one longer text); working arrays take some fifty times as much.
SLICE = 1 << 20
_SEEDS = mix(np.arange(1, 4097, dtype=U) * U(BASE2))


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes: t coordinates, all filled; of an empty set all are the greatest value."""
    out = np.full(t, ~U(0), U)
    n, i = len(shingles), 0
    if not n:
        return out
    while i < 2 * t:
        block = min(2 * t, i + max(1, 4096 // n)) - i
        block = min(block, t - i) if i < t else block
        rounds = np.arange(i, i + block, dtype=U)
        x = mix((shingles[None, :] ^ _SEEDS[i : i + block, None]).ravel())
        bins = (x >> U(32)) % U(t) if i < t else np.repeat(rounds - U(t), n)
        np.minimum.at(out, bins.astype(np.int64), (np.repeat(rounds, n) << U(32)) | (x & U(0xFFFFFFFF)))
        i += block
        if i <= t and (out != ~U(0)).all():
            break
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = coordinates.reshape(-1, rows)
        h = np.arange(1, len(x) + 1, dtype=U) * U(BASE)
        for j in range(rows):
            h = mix(h + x[:, j])
    return h.view(np.int64)


def _described(k: int, rows: int, bands: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            for a, b in slices(offsets, SLICE):
                words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, s1, s2, keys = [], [], [], []
                for i in range(b - a):
                    h = shingle_hashes(words[at[i] : at[i + 1]], k)
                    n.append(len(h))
                    with np.errstate(over="ignore"):
                        s1.append(int(np.add.reduce(mix(h ^ U(BASE))).view(np.int64)) if len(h) else 0)
                        s2.append(int(np.add.reduce(mix(h ^ U(BASE2))).view(np.int64)) if len(h) else 0)
                    keys.append(band_keys(sketch(h, rows * bands), rows) if len(h) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32), np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], schema=kind)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            for a, b in slices(offsets, SLICE):
                words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets = [shingle_hashes(words[at[i] : at[i + 1]], k).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def links(ids: np.ndarray, blobs: list[bytes], percent: int = 80) -> list[tuple[int, int]]:
    """Links that connect the same sets as all pairs with 100 * |intersection| >= percent * |union| do.

    A set is compared with all others it could reach, until what it could reach is in its own component. What a set shares with
    any other is at most its shingles that occur twice here; sets that this bound keeps from every partner are not compared.
    """
    g = len(ids)
    sets = [np.frombuffer(x, U) for x in blobs]
    size = np.array([len(x) for x in sets], np.int64)
    flat, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), size)
    twice = count[inverse] > 1
    shared = np.bincount(owner[twice], minlength=g)
    # |I| * (100 + percent) >= percent * (n_x + n_y) with |I| at most what either shares
    reach = shared * (100 + percent) // percent - size
    code, own = inverse[twice], owner[twice]
    by_code = np.argsort(code, kind="stable")
    posting = own[by_code]
    first = np.searchsorted(code[by_code], np.arange(len(flat) + 1))
    starts = np.searchsorted(own, np.arange(g + 1))
    parent = np.arange(g)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    top = np.arange(g)
    out: list[tuple[int, int]] = []
    done = np.zeros(g, bool)
    for x in np.argsort(size - shared, kind="stable"):
        could = (reach[x] >= size) & (reach >= size[x]) & ~done
        done[x] = True
        could[x] = False
        if not (could & (top != top[x])).any():
            continue
        codes = code[starts[x] : starts[x + 1]]
        lengths = first[codes + 1] - first[codes]
        at = np.repeat(first[codes] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[at], minlength=g)
        hit = np.flatnonzero(could & (both * 100 >= percent * (size + size[x] - both)))
        joined = False
        for y in hit:
            a, b = root(int(x)), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
                joined = True
        if joined:
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            top = parent.copy()
    return out


def _verified(percent: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = links(rows["doc_id"].to_numpy(), rows["shingles"].to_pylist(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Documents with equal shingle sets are one class, known by its smallest doc_id; only classes are banded and compared. Buckets
    with the same smallest member are one. Within a bucket a task emits a spanning set of confirmed links, never all pairs; a bucket of
    over BLOCK members or BLOCK_SHINGLES shingles is dealt out as pairs of blocks, so no task holds more than two blocks (or two sets
    that are larger). Components follow from the links. Other columns of docs, whatever their names, are not looked at.
    Nulls: a null or wordless text has an empty set, links with nothing and is its own component; rows with a null doc_id are
    their own component too (component_id null, kept true). Rows that repeat a doc_id belong to the component of that id. Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    kind = "doc_id long, n long, s1 long, s2 long, bands array<long>"
    described = saved(texts.mapInArrow(_described(k, rows, bands), kind), "sketches")
    full = described.where("n > 0 and doc_id is not null")
    member = full.select("doc_id", "n", "s1", "s2").distinct()
    classes = full.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("n", "s1", "s2", F.col("m.doc_id").alias("rep"), "m.bands")
    classes = saved(classes, "classes")
    pairs = classes.select("rep", "n", F.posexplode("bands").alias("band", "key")).select("rep", "n", "key")
    mates = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min("rep").alias("least")).where("g > 1").select("key", "least")
    members = pairs.join(mates.hint("merge"), "key").select("least", "rep", "n").distinct()
    members = saved(members, "buckets")
    sizes = members.groupBy("least").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    members = members.join(sizes, "least").select(F.col("least").alias("key"), "rep", "blocks")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, shingles binary")
    dealt = members.withColumnRenamed("blocks", "m").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("rep", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    compared = dealt.join(sets.hint("merge"), F.col("rep") == F.col("doc_id")).select("key", "i", "j", "doc_id", "shingles")
    found = compared.groupBy("key", "i", "j").applyInArrow(_verified(percent), "a long, b long")
    same = member.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(found.union(same))
    out = described.select("doc_id", F.col("n").alias("n_shingles")).join(roots, F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each near-duplicate component stays (five-word shingles), that of the smallest doc_id (nulls last).

    Every row is a document of its own, whatever its doc_id: of rows with equal texts one stays, also where their doc_ids are equal or
    null, and different texts of one doc_id stay unless something else is like them. Rows are numbered in a written table, which the
    search and its result share. Null, empty and wordless texts are no one's copies and stay. Columns and their order stay, whatever
    their names; an empty table gives an empty result.
    """
    row = unused("__row", docs)
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), k=5).select(F.col("doc_id").alias("__r"), "component_id")
    ids = rows.select(F.col(row).alias("__r"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    kept = groups.join(ids, "__r").groupBy("component_id").agg(F.min(F.struct("unnamed", "doc_id", "__r")).alias("m")).select(F.col("m.__r").alias(row))
    return rows.join(kept.hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT ways.b, reach.root FROM reach JOIN ways ON reach.node = ways.a),
    top AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN top ON node = doc_id
"""
