import datetime as dt

from sparkevidence.streaming import jobs


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, "hello"), (1, 2, t0 + dt.timedelta(minutes=5), "there"), (1, 2, t0 + dt.timedelta(minutes=5), "there"), (1, 3, t0 + dt.timedelta(minutes=60), "again"), (2, 4, t0, "x"), (9, 9, t0 + dt.timedelta(days=9), "end")]
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, part string")


def streamed(spark, df, path):
    df.repartition(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_intake_stream_equals_batch(spark, tmp_path):
    batch = sorted(tuple(r) for r in jobs.assemble_intake(events(spark)).collect())
    assert [r[4] for r in batch] == ["hello there", "again", "x", "end"]
    stream = jobs.assemble_intake(streamed(spark, events(spark), str(tmp_path / "in")))
    jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == batch[:-1]  # the last session stays open until the watermark passes it


def test_suggestions_once(spark, tmp_path):
    d = events(spark).selectExpr("user_id as service", "string(user_id % 2) as url", "ts")
    jobs.run_to_table(jobs.distinct_suggestions(streamed(spark, d, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 == jobs.distinct_suggestions(d).count()


def test_ingest_stream(spark, tmp_path):
    kind = "document_key string, content_hash string, signature string"
    path = str(tmp_path / "in")
    source = lambda: spark.readStream.schema(kind).parquet(path)
    run = lambda: jobs.ingest_stream(source(), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("a", "h1", "p"), ("b", "h1", "p")], kind).coalesce(1).write.parquet(path)
    run()
    spark.createDataFrame([("a", "h2", "p"), ("b", "h1", "p")], kind).coalesce(1).write.mode("append").parquet(path)
    run()
    got = sorted((r["document_key"], r["version"], r["status"]) for r in jobs.stored_versions(spark, str(tmp_path / "t")).collect())
    assert got == [("a", 1, "archived"), ("a", 2, "active"), ("b", 1, "active")]
    spark.createDataFrame([("c", "h1", "p")], kind).coalesce(1).write.mode("append").parquet(path)
    run()
    parts = {r["part"] for r in spark.read.parquet(str(tmp_path / "t")).where("g = 2").select("part").distinct().collect()}
    assert len(parts) == 1  # the others are neither read nor written
    assert len(jobs.stored_versions(spark, str(tmp_path / "t")).collect()) == 4


def test_superseded_generations_go(spark, tmp_path):
    kind = "document_key string, content_hash string, signature string"
    source, target = str(tmp_path / "in"), tmp_path / "table"
    for i in range(4):
        spark.createDataFrame([("a", f"h{i}", "s"), (f"k{i}", "h", "s")], kind).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest_stream(spark.readStream.schema(kind).parquet(source), str(target), str(tmp_path / "checkpoint"), parts=3).awaitTermination()
    assert all(len(list(p.glob("g=*"))) <= 2 for p in target.glob("part=*"))
    got = {(r["document_key"], r["version"], r["status"]) for r in jobs.stored_versions(spark, str(target)).collect()}
    assert got == {("a", 1, "archived"), ("a", 2, "archived"), ("a", 3, "archived"), ("a", 4, "active")} | {(f"k{i}", 1, "active") for i in range(4)}
