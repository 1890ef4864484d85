"""Helpers shared by the training-data operators: written cuts in the lineage, ordered prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a session that runs on one machine may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkevidence-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later jobs neither recompute it nor depend on lost executors."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once by bytes, however long the texts are. Unions don't claim their children's
    partitioning, which fails once adaptive execution has merged partitions of only one of them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(name: str, df: DataFrame) -> str:
    """name, or name with underscores before it, such that df has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_count(rows: int) -> int:
    """Buckets of some thousand rows, so that no ordered step holds more than one bucket in a task."""
    return max(16, -(-rows // ROWS_PER_BUCKET))


def unit_interval(hex_digest: Column) -> Column:
    """The first 13 hexadecimal digits of a digest as a double in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group up to and including each row, in (bucket, *order).

    bucket has to grow with order. Only bucket totals are ordered group by group; rows are ordered within one bucket, so a group
    that holds most rows is spread over many tasks. df is read twice: pass a written table.
    """
    named = {f"__g{i}": g for i, g in enumerate(group)}
    keyed = df.withColumns({k: F.col(g) for k, g in named.items()} | {"__bucket": F.col(bucket)})
    totals = keyed.groupBy(*named, "__bucket").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*named).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"{k}r") for k in named], F.col("__bucket").alias("__bucketr"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in named], F.col("__bucket") == F.col("__bucketr"))
    within = Window.partitionBy(*named, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(offsets, same)
    return joined.withColumn(out, F.col("__before") + F.sum(value).over(within)).drop(*named, *[f"{k}r" for k in named], "__bucket", "__bucketr", "__before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges, for each node that has one.

    Alternates large-star and small-star steps: every step is a grouped minimum over edges, which combines before the shuffle, so a
    node with very many edges is never gathered in a task. Each step is written to the shared folder.
    """
    now = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = saved(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.countDistinct("u")).first()
        if tuple(state) == before and state[0] == state[2]:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def arrow_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each row starts (one more for the end); nulls are empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most so many bytes each, a longer row alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out
