from pyspark.sql import functions as F

from sparkevidence.operators import mining


def observed(spark, rows, kind="chunk", base=0.5, phrase=False):
    d = spark.createDataFrame(rows, "key long, source string, topic string, text string")
    return mining.observation(d, kind, F.col("key"), F.col("source"), F.col("topic"), F.col("text"), base, phrase)


def test_groups_lists_and_confidence(spark):
    chunks = observed(spark, [(i, "docs", "Set  UP\n", f"use MAX_SIZE and conf.yaml v1.2.{i % 2}") for i in range(10)] + [(20, "docs", "other", "API_TOKEN here"), (21, "tmp-x", "t", "a.b"), (22, "docs", "", "a.b"), (23, None, "nothing", "plain words"), (24, "docs", "null text", None)])
    turns = observed(spark, [(1, "docs", "set up", "how do I  set it up"), (2, "docs", "set up", "how do I set it up"), (3, "docs", "set up", "why")], "turn", 0.48, True)
    known = spark.createDataFrame([("max_size",)], "term string")
    got = {(r["source"], r["topic"]): r for r in mining.candidates([chunks, turns], known).collect()}
    assert set(got) == {("docs", "set up"), ("docs", "other"), ("tmp-x", "t")}
    r = got["docs", "set up"]
    assert (r["observations"], r["kinds"], r["exact_terms"], r["config_terms"], r["phrases"], r["known_terms"]) == (13, "chunk,turn", ["conf.yaml", "v1.2.0", "v1.2.1"], [], ["how do I set it up", "why"], 1)
    assert r["confidence"] == 0.81 and r["status"] == "suggested"  # 0.5 + 0.18 + 0.08 + 0.05
    assert got["docs", "other"]["status"] == "sensitive-review" and got["docs", "other"]["confidence"] == 0.61
    assert got["tmp-x", "t"]["flags"] == "low-confidence" and got["tmp-x", "t"]["confidence"] == 0.58


def test_lists_are_bounded_and_ordered(spark):
    rows = [(i, "s", "t", f"a.w{i % 40:02d} z.z") for i in range(100)]
    got = mining.candidates([observed(spark, rows)], spark.createDataFrame([], "term string")).first()
    assert got["exact_terms"] == ["z.z", *[f"a.w{i:02d}" for i in range(7)]] and got["observations"] == 100
    assert mining.candidates([observed(spark, [])], spark.createDataFrame([], "term string")).count() == 0
