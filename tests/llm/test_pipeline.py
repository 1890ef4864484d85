import random

import corpus_pipeline
from sparkevidence.llm import merge_dropout


def test_stages_act_and_keep_columns(docs, spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(90)
    rows, labels = [], []
    for i in range(240):
        kind = ("good", "good", "shout", "toxic")[i % 4]
        t = text(r.randint(40, 90))
        if kind == "toxic":
            t = " ".join(w if r.random() > 0.15 else r.choice(["idiot", "trash", "moron"]) for w in t.split())
        rows.append((i, t.upper() if kind == "shout" else t, "en", f"s{i % 3}"))
        labels.append((i, int(kind != "shout"), int(kind == "toxic")))
    good = [x for x in rows if x[0] % 4 < 2]
    rows += [(1000 + x[0], x[1] + " end", "en", "s0") for x in good[:10]]  # near copies
    rows += [(2000 + k, text(40) + " " + passage + " " + text(30), "en", "s1") for k in range(3)]  # a shared passage
    d = docs(rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels[:160], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, seen, str(tmp_path)).write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        assert seen.columns == d.columns, name
        after[name] = {x["doc_id"]: x for x in seen.collect()}
    bad = [i for i in range(160, 240) if i % 4 >= 2]
    assert sum(i in after["quality"] for i in bad) <= 4
    assert sum(x[0] in after["quality"] for x in good) >= 0.95 * len(good)
    left = after["near_duplicates"]
    assert not any(1000 + x[0] in left for x in good[:10] if x[0] in after["quality"]) and all(x[0] in left for x in good[:10] if x[0] in after["quality"])
    cut = after["repeated_substrings"]
    assert all(passage not in cut[2000 + k]["text"] and cut[2000 + k]["n_chars"] == len(cut[2000 + k]["text"]) for k in range(3) if 2000 + k in cut) and set(cut) == set(left)
    untouched = next(i for i in cut if i < 240)
    assert cut[untouched]["text"] == left[untouched]["text"]
    mixed = seen.collect()
    ids = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path))
    assert ids.count() == len(mixed) > 0
    back = merge_dropout.decode(ids).collect()
    assert sorted((x["doc_id"], x["text"]) for x in back) == sorted((x["doc_id"], x["text"]) for x in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x["doc_id"], x["ids"]) for x in whole.collect()) == sorted((x["doc_id"], x["ids"]) for x in ids.collect())


def test_stages_take_empty_and_hard_tables(docs, spark, hard, tmp_path):
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs(hard), docs(hard).where("false")):
        seen = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, str(tmp_path))
            assert seen.columns == rows.columns
        assert corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).columns == ["doc_id", "ids"]


def test_every_text_leaves_a_copy(docs, spark, tmp_path):
    """Repeated rows, rows without id and texts that are parts of others: neither deduplication stage loses a text wholly."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    a, b, c, part, more = text(75), text(80), text(70), text(60), text(200)
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (None, c), (3, part), (4, f"{more} {part}"), (5, text(90)), (5, text(90)), (6, ""), (6, ""), (7, None)]
    stages = dict(corpus_pipeline.STAGES)
    d = docs(rows).withColumnRenamed("size", "__row").withColumnRenamed("key", "__new")
    first = stages["near_duplicates"](spark, d, "")
    assert first.columns == d.columns
    one = [(x["doc_id"], x["text"]) for x in first.collect()]
    assert sorted(one, key=str) == sorted([(1, a), (None, b), (2, c), *rows[6:]], key=str)
    for seen in (first, d):  # the second stage alone meets copies, and keeps them
        left = [x["text"] for x in stages["repeated_substrings"](spark, seen, "").collect()]
        assert {a, b, c, part} <= set(left) and len(left) == seen.count()
        assert not any(t and part in t and t != part for t in left)
