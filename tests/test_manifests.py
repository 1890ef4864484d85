import random

from pyspark.sql import functions as F

from sparkevidence.operators import manifests

KIND = "id string, source string, n int, more struct<a:int,api_key:string,list:array<struct<token:string,b:int>>>, m map<string,string>, password string"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def row(i, n=0, secret="x", m=None):
    return f"k{i}", f"s{i % 3}" if i % 10 else None, n, (i, secret, [(secret, i)]), {"kept": "v", "Auth-Token": secret} if m is None else m, secret


def test_secrets_go_at_any_depth(spark):
    clean = manifests.without_secrets(table(spark, [row(1, secret="geheim"), ("k2", "s", 1, None, None, None)]))
    assert clean.columns == ["id", "source", "n", "more", "m"]
    a, b = sorted(clean.collect())
    assert a["more"].asDict(True) == {"a": 1, "list": [{"b": 1}]} and a["m"] == {"kept": "v"} and b["more"] is None and b["m"] is None
    assert "geheim" not in str(a)


def test_drift_is_that_of_all_rows(spark):
    r = random.Random(3)
    old = {i: row(i, r.randint(0, 9)) for i in range(400)}
    new = {i: old[i] for i in old if i % 37}
    new |= {i: row(i, 99) for i in range(5, 400, 61) if i in new} | {i: row(i) for i in range(1000, 1006)}
    new = {i: (*x[:-1], "other secret") for i, x in new.items()}
    for depth in (0, 1, 2):
        a, b = (manifests.manifest(table(spark, list(x.values())), "source", "id", depth) for x in (old, new))
        got = {(x["id"], x["drift"]) for x in manifests.drift(a, b, "source", "id", depth).collect()}
        want = {(old[i][0], "removed") for i in old if i not in new} | {(new[i][0], "added") for i in new if i not in old} | {(old[i][0], "modified") for i in old if i in new and old[i][:-1] != new[i][:-1]}
        assert got == want
        same = manifests.manifest(table(spark, list(old.values())).repartition(5), "source", "id", depth)
        assert manifests.drift(a, same, "source", "id", depth).count() == 0


def test_only_leaves_that_differ_are_read(spark):
    old = [row(i) for i in range(300)]
    a, b = manifests.manifest(table(spark, old), "source", "id", 2), manifests.manifest(table(spark, [row(0, 5), *old[1:]]), "source", "id", 2)
    assert manifests.drifted_leaves(a[0], b[0], "source", 2).count() == 1
    assert manifests.depth_for(0) == manifests.depth_for(1000) == 0 and manifests.depth_for(1001) == 1 and manifests.depth_for(10**9) == 5


def test_manifests_are_verified(spark):
    nodes, _ = manifests.manifest(table(spark, [row(i) for i in range(1, 40) if i % 10]), "source", "id", 1)
    roots = {r["source"]: r for r in nodes.where("level = 0").collect()}
    expected = spark.createDataFrame([("s0", roots["s0"]["rows"], roots["s0"]["digest"]), ("s1", roots["s1"]["rows"] + 1, "0" * 64), ("gone", 1, "1")], "source string, rows long, digest string")
    torn = nodes.withColumn("rows", F.when((F.col("source") == "s2") & (F.col("level") == 1), F.col("rows") + 1).otherwise(F.col("rows")))
    got = {r["source"]: r["reasons"] for r in manifests.verified(torn, "source", expected).collect()}
    assert got == {"s0": [], "s1": ["count_differs", "checksum_differs"], "s2": ["not_expected", "torn_tree"], "gone": ["no_manifest"]}


def test_export(spark, tmp_path):
    manifests.exported(table(spark, [row(1), row(2)]), str(tmp_path / "b"), "source", "id")
    assert spark.read.parquet(str(tmp_path / "b/rows")).columns == ["id", "source", "n", "more", "m"]
    assert spark.read.parquet(str(tmp_path / "b/tree")).where("level = 0").agg(F.sum("rows")).first()[0] == 2
