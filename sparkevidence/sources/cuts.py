"""Written cuts in the lineage, in the folder that the cluster names for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet to the folder in spark.checkpoint.dir and reads it back: later jobs neither work it out again nor depend on
    executors that were lost. Only a session that runs on one machine may name no folder.

    Spark estimates a table by the bytes of its files, which compression can make hundreds of times smaller than its rows, so such a
    table would pass whole through the driver. From here on tables are broadcast where a query says so, or where their shuffled rows turn
    out to be few.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-cuts-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
