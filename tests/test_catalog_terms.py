from pyspark.sql import functions as F

from sparkevidence.operators import catalog, terms


def test_anchor_terms_search_a_text_once(spark):
    """Each shape is one search of the text, however many terms it finds; a term counts once, under its first shape."""
    text = " ".join(["MAX_SIZE", "runFast", "v1.2", "/api/items", "--dry-run", "max_size", "HTTP", "a/b.c", "HTTP", "MAX_SIZE"] + [f"{'ABCDEFGHIJ'[i % 10]}{'KLMNOPQRST'[i // 10 % 10]}{'UVWXYZ'[i % 6]}" for i in range(3000)])
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain words")], "doc_id long, text string").select("doc_id", catalog.anchor_terms(F.col("text")).alias("a"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(catalog.ANCHOR_SHAPES) + 1
    got = {r["doc_id"]: r["a"] for r in df.collect()}
    assert got[2] is None and got[3] == [] and len(got[1]) == 30 == len({x["term"] for x in got[1]})
    first = [(x["term"], x["class"]) for x in got[1]][:9]
    assert first == [("MAX_SIZE", "config"), ("runFast", "function"), ("v1.2", "version"), ("/api/items", "endpoint"), ("--dry-run", "option"), ("max_size", "identifier"), ("MAX", "acronym"), ("SIZE", "acronym"), ("HTTP", "acronym")]


def test_examples_look_for_no_shapes(spark):
    chunks = spark.createDataFrame([(i, 0, "en", f"alpha MAX_SIZE w{i}") for i in range(5)] + [(9, 0, "en", None)], "document_id long, chunk_index int, course string, content string")
    stats = spark.createDataFrame([("alpha",), ("w3",), ("none",)], "term string")
    df = terms.with_examples(stats, chunks)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r["term"]: r["examples"] for r in df.collect()} == {"alpha": ["4", "3", "2"], "w3": ["3"], "none": None}
