"""Embedding whitening by weighted multiplicity covariance (operator 11).

Vectors are put on a grid of 1/64 and identical ones are grouped. Each distinct vector is a fit row, weighted by one or by its count.
Tasks multiply their centred rows into one d x d matrix each; only sums of such matrices reach the driver, whose size depends on the
dimension alone. Each distinct vector is whitened once, and rows get the result by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.llm.shared import dropped, saved, small_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Matrices of tasks are added up in so many groups, so no task or driver gets those of all tasks.
GROUPS = 32
#: Rows that one multiplication takes.
ROWS = 4096


def grid(embedding: Column) -> Column:
    """array<bigint>: floor(64 * c) + 1000000 of each entry, as double."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT))


def usable(embedding: Column) -> Column:
    """Whether a vector has entries, and all of them are finite numbers on the grid of longs."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= float(1 << 53) / SCALE)
    return F.coalesce(F.size(embedding) > 0, F.lit(False)) & ~F.exists(embedding, bad)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch], column: str, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield _matrix(part[column], kind), part["weight"].to_numpy()


def _added(partial: DataFrame) -> list:
    """The sum of the arrays that tasks made: [number of fit rows, total weight, entries]."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = _matrix(rows["entries"].combine_chunks(), kind).sum(axis=0)
        return pa.table({"n": [sum(rows["n"].to_pylist())], "weight": [sum(rows["weight"].to_pylist())], "entries": pa.array([total.tolist()], rows["entries"].type)}).cast(rows.select(["n", "weight", "entries"]).schema)

    kind = np.int64 if "array<bigint>" in dict(partial.dtypes)["entries"] else np.float64
    dealt = partial.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    parts = dealt.groupBy("group").applyInArrow(add, partial.schema).collect()
    if not parts:
        return [0, 0, None]
    return [sum(p["n"] for p in parts), sum(p["weight"] for p in parts), np.sum([np.array(p["entries"], kind) for p in parts], axis=0)]


def _sums(fit: DataFrame, column: str, kind: str) -> list:
    """Sums of a vector column, each row as often as its weight; exact for longs."""
    number = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, total = 0, 0, None
        for x, weight in _chunks(batches, column, number):
            n, w = n + len(x), w + int(weight.sum())
            s = (x * weight[:, None]).sum(axis=0)
            total = s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["n", "weight", "entries"])

    return _added(fit.select(column, "weight").mapInArrow(run, f"n long, weight long, entries array<{kind}>"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: the difference is taken in integers."""
    return (n * x - sums) / n


def _covariance(fit: DataFrame, column: str, centre, kind) -> np.ndarray:
    """The covariance of a vector column, centred before it is multiplied; divisor: the total weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, total = 0, 0, 0
        for x, weight in _chunks(batches, column, kind):
            n, w, y = n + len(x), w + int(weight.sum()), centre(x)
            total = total + (y * weight[:, None]).T @ y
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "weight", "entries"])

    _, w, total = _added(fit.select(column, "weight").mapInArrow(run, "n long, weight long, entries array<double>"))
    d = int(round(len(total) ** 0.5))
    out = total.reshape(d, d) / w
    return (out + out.T) / 2


def _whitened(n: int, sums: np.ndarray, projection: np.ndarray):
    """Rows of (h1, h2, x) become (h1, h2, deviation, white); projection has a column for each component, nulls where there is no spread."""
    spread = ~np.isnan(projection).any(axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = _matrix(part["x"], np.int64)
                far = n * x - sums
                fits = (far.astype(np.float64) ** 2).sum(axis=1) < 9e18
                deviation = pa.array(np.where(fits, (far * far).sum(axis=1), 0), pa.int64(), mask=~fits)
                white = (far / n) @ np.where(spread, projection, 0.0)
                values = pa.array(white.ravel(), pa.float64(), mask=np.tile(~spread, len(x)))
                at = pa.array(np.arange(len(x) + 1) * projection.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part["h1"], part["h2"], part["weight"], deviation, pa.ListArray.from_arrays(at, values)], names=["h1", "h2", "weight", "deviation", "white"])

    return run


def whiten(table: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of table (vec_id, embedding) and each
    component up to so many.

    The fit list holds each distinct grid vector once (weights="one"), or as often as rows have it (weights="count"); n is its length.
    A row's grid vector meets its group by 128 bits of hashes, which are checked to tell all distinct vectors apart. A vector that a
    third of all rows share is one fit row; the join back is a plain shuffle join, whose hot partition adaptive execution splits.
    Nulls: rows whose vector is null, empty, or holds null, non-finite or huge entries (2 ** 47 and more) are dropped, as are those of another
    length than most rows have (ties: the longest). A null vec_id stays null; rows that repeat a vec_id or a vector are kept as they are.
    A component without spread (constant vectors, fewer distinct vectors than components) has a null whitened value and counts neither
    in identity_error. A deviation beyond a long is null. Texts and other columns are not looked at. Empty tables give an empty result.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = table.where(usable(F.col("embedding"))).select("vec_id", grid(F.col("embedding")).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 1
    rows = rows.where(F.size("x") == d)
    hashes = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2")]
    count = F.count(F.lit(1)).alias("weight") if weights == "count" else F.lit(1).cast("long").alias("weight")
    distinct = saved(rows.groupBy("x").agg(count).select(*hashes, "x", "weight"), "distinct")
    if distinct.groupBy("h1", "h2").count().where("count > 1").limit(1).count():
        raise ValueError("two grid vectors have the same 128 bits of hashes")
    rank = min(components, d)
    _, n, sums = _sums(distinct, "x", "long")
    if not n:
        n, sums, values, vectors, trace = 1, np.zeros(d, np.int64), np.zeros(d), np.eye(d), 0.0
    else:
        cov = _covariance(distinct, "x", lambda x: centred(x, n, sums), np.int64)
        values, vectors = np.linalg.eigh(cov)
        values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(cov))
    values, vectors = values[:rank], vectors[:, :rank]
    spread = values > trace * d * np.finfo(float).eps * 16
    projection = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), np.nan)
    white = saved(distinct.mapInArrow(_whitened(n, sums, projection), "h1 long, h2 long, weight long, deviation long, white array<double>"), "white")
    error = None
    if spread.any():
        kept = white.select(F.expr("filter(white, c -> c is not null)").alias("white"), "weight")
        _, w, total = _sums(kept, "white", "double")
        mean = total / w
        error = float(np.abs(_covariance(kept, "white", lambda y: y - mean, np.float64) - np.eye(int(spread.sum()))).max())
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    out = rows.select("vec_id", *hashes).join(white.hint("merge"), ["h1", "h2"])
    out = out.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    out = out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    dropped(distinct)
    return out
