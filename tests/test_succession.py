import random
import re

from sparkevidence.operators import succession

KIND = "document_key string, title string"


def plain(missing, discovered, most=5):
    """All pairs."""

    def told(key, title):
        path = [x for x in key.lower().split("/") if x]
        words = re.findall(r"\w+", (title or "").lower())
        return " ".join(words) or None, path[-1] if path else None, "/".join(path[-2:]) if len(path) > 1 else None, set(words)

    best = {}
    for k, t in missing:
        for s, u in discovered:
            if k is None or s is None or k == s:
                continue
            a, b = told(k, t), told(s, u)
            same = a[0] is not None and a[0] == b[0]
            alike = not same and a[3] and len(a[3] & b[3]) >= 0.67 * len(a[3] | b[3]) - 1e-9
            n = 2 * same + (a[1] is not None and a[1] == b[1]) + (a[2] is not None and a[2] == b[2]) + bool(alike)
            if n >= 2:
                best.setdefault(k, {})[s] = max(n, best.get(k, {}).get(s, 0))
    return {(k, s, n, i + 1) for k, c in best.items() for i, (s, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most])}


def candidates(spark, missing, discovered):
    return {tuple(r) for r in succession.successor_candidates(spark.createDataFrame(missing, KIND), spark.createDataFrame(discovered, KIND)).collect()}


def test_blocks_find_the_best_of_all_pairs(spark):
    r = random.Random(1)
    title = lambda: r.choice([None, "", "Getting Started", " ".join(r.sample("a b c d e f g h".split(), r.randint(1, 6)))])
    key = lambda side: "/".join([side, r.choice("xyz"), r.choice(["guide", "api", "Guide"]), r.choice(["index", "setup", "start/"])])
    missing, discovered = [(key("old"), title()) for _ in range(120)] + [(None, "x"), ("", "a b c")], [(key(r.choice(["old", "new"])), title()) for _ in range(150)] + [(None, "x"), ("one", "a b c")]
    got = candidates(spark, missing, discovered)
    assert got == plain(missing, discovered) and len({g[2] for g in got}) > 2


def test_common_titles_stay_small(spark):
    """Thousands of pages of one title: each missing key gets its few best, also those beyond the title."""
    missing = [(f"old/{i}/index", "Overview") for i in range(300)]
    discovered = [(f"new/{i}/index", "Overview") for i in range(300)]
    got = candidates(spark, missing, discovered)
    assert len(got) == 1500 and got == plain(missing, discovered)


def test_titles_and_tokens_do_not_go_with_pairs(spark):
    text = " ".join(f"word{i}" for i in range(400))
    missing, discovered = ([(f"{side}/{i}/index", f"{text} {i % 7}") for i in range(40)] for side in ("old", "new"))
    got = succession.successor_candidates(spark.createDataFrame(missing, KIND), spark.createDataFrame(discovered, KIND))
    assert "tokens" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == plain(missing, discovered)


def test_alike_titles_by_rare_tokens(spark, monkeypatch):
    """The same rows whether all classes of a last part are compared or only those that share a rare token."""
    r = random.Random(2)
    title = lambda: " ".join(r.sample("a b c d e f g h i j".split(), r.randint(3, 8)))
    missing, discovered = ([(f"{side}/{i}/{r.choice(['index', 'setup', i])}", title()) for i in range(80)] for side in ("old", "new"))
    want = plain(missing, discovered)
    assert candidates(spark, missing, discovered) == want and any(x[2] == 2 for x in want)
    monkeypatch.setattr(succession, "FEW", 0)
    assert candidates(spark, missing, discovered) == want


def test_reconciliation_sends_titles_a_few_times_only(spark):
    """Of long titles that many keys share, what is shuffled is a few times what they hold, though each key meets several others."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4000)) for _ in range(4)]
    kind = KIND + ", content_hash string"
    active, found = ([(f"{side}/{i}/p{i}", texts[i % 4], str(i)) for i in range(120)] for side in ("old", "new"))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    got = succession.reconciliation(spark.createDataFrame(active, kind), spark.createDataFrame(found, kind)).collect()
    assert sent() - before < 8 * sum(len(t) for side in (active, found) for _, t, _ in side)
    assert {x["document_key"]: x["successor"] for x in got if x["class"] == "replaced"} == {f"old/{i}/p{i}": f"new/{i}/p{i}" for i in range(120)}


def test_classes_and_blockers(spark):
    kind = KIND + ", content_hash string"
    active = [("s/a", "A", "1"), ("s/b", "B", "2"), ("s/old/c", "C page", "3"), ("s/d", "D", "4"), ("s/dup", "E", "5"), ("s/dup", "E", "5"), ("s/old/x", "Twice", "6"), ("s/older/x", "Twice", "7"), ("s/Case", "F", "8"), ("s/n", "N", None)]
    found = [("s/a", "A", "1"), ("s/b", "B", "9"), ("s/new/c", "C page", "3"), ("s/fresh", "Fresh", "1"), ("s/dup", "E", "5"), ("s/new/x", "Twice", "6"), ("s/case/", "F", "8"), ("s/n", "N", "1")]
    got = {r["document_key"]: (r["class"], r["successor"], r["blockers"]) for r in succession.reconciliation(spark.createDataFrame(active, kind), spark.createDataFrame(found, kind)).collect()}
    assert got["s/a"] == ("unchanged", None, []) and got["s/b"][0] == "changed" and got["s/old/c"] == ("replaced", "s/new/c", []) and got["s/d"] == ("missing", None, []) and got["s/fresh"][0] == "added"
    assert got["s/dup"][2] == ["duplicate_active_key"] and got["s/old/x"][2] == got["s/older/x"][2] == ["successor_wanted_twice"] and got["s/n"][2] == ["no_content_hash"]
    assert "key_collision" in got["s/Case"][2] and "key_collision" in got["s/case/"][2]


def test_written_tables_are_not_sent_by_the_bytes_of_their_files(spark):
    from pyspark.sql import functions as F

    from sparkevidence.sources.cuts import cut

    rows = cut(spark.range(20_000).select("id", F.repeat(F.lit("word "), 1000).alias("t")))
    assert "Broadcast" not in rows.join(cut(spark.range(20_000)), "id")._jdf.queryExecution().executedPlan().toString()


def test_links_of_titled_keys(spark):
    import __spark_entry__
    from sparkevidence.plans import corpus

    data = "/root/testdata/sf0.001"
    d = corpus.documents(spark, data)
    a, b = (d.where(f"status = '{s}'").selectExpr(f"document_key as {k}", "title").distinct() for s, k in (("archived", "a"), ("active", "b")))
    pairs = a.join(b, "title").where("a <> b")
    got = __spark_entry__.queries()["successor_candidates"](spark, data)
    assert "links" in got.columns and got.selectExpr("sum(links)").first()[0] == pairs.count() > 0
    assert got.selectExpr("sum(strong)").first()[0] == pairs.where("substring_index(a, '/', -1) = substring_index(b, '/', -1)").count()


def test_successors_of_titled_keys_are_named(spark, monkeypatch):
    """Each pair by its keys and signals, also where a title has several blocks on both sides."""
    import __spark_entry__
    from sparkevidence.plans import corpus, structure_queries

    data = "/root/testdata/sf0.001"
    d = corpus.documents(spark, data)
    a, b = (d.where(f"status = '{s}'").selectExpr(f"document_key as {k}", "title").distinct() for s, k in (("archived", "key"), ("active", "successor")))
    pairs = a.join(b, "title").where("key <> successor").selectExpr("key", "successor", "2 + int(substring_index(key, '/', -1) = substring_index(successor, '/', -1)) as signals")
    want = sorted(tuple(r) for r in pairs.collect())
    named = lambda: sorted(tuple(r) for r in __spark_entry__.queries()["successor_candidates"](spark, data).select("key", "successor", "signals").collect())
    assert named() == want != []
    monkeypatch.setattr(structure_queries, "_BLOCK", 1)
    assert named() == want
