from sparkevidence.operators import catalog


def test_phrases_of_any_length_are_found(spark):
    q = spark.createDataFrame([(1, "How do I set the upper limit of open files in the service config?"), (2, "something else")], "question_id long, question string")
    aliases = spark.createDataFrame([("s1", "service config")], "service_id string, phrase string")
    rules = spark.createDataFrame([("s1", "r1", 1, "set the upper limit of open files", "exact", "ulimit"), ("s1", "r2", 1, "limit of closed files", "exact", "no")], "service_id string, rule_id string, ordinal int, phrase string, kind string, term string")
    got = catalog.enrich_questions(q, aliases, rules).collect()
    assert [(r["question_id"], r["services"], r["exact_terms"]) for r in got] == [(1, ["s1"], ["ulimit"])]
