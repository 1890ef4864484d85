from sparkevidence.operators import suggestions


def test_reuse_and_cooldown(spark):
    kind = "service_id string, url string, ts long"
    stored = spark.createDataFrame([("One Docs", "https://one.org/docs/", 1000), ("two", "https://two.org", 0)], kind)
    incoming = spark.createDataFrame([("one", "HTTPS://ONE.org/docs?x=1", 1100), ("one", "https://one.org/other", 1200), ("two", "https://two.org/new", 5000), ("two", "https://two.org/newer", 5001), ("three", "https://three.org/a", 1), ("three", "https://three.org/a#b", 2), (None, "https://x.org", 1), ("four", None, 1)], kind)
    got = {(r["service_id"], r["url"]): (r["suggestions"], r["outcome"]) for r in suggestions.upserted(stored, incoming, 3600).collect()}
    assert got == {("one", "https://one.org/docs"): (1, "reused"), ("one", "https://one.org/other"): (1, "cooling"), ("two", "https://two.org/new"): (1, "pending"), ("two", "https://two.org/newer"): (1, "cooling"), ("three", "https://three.org/a"): (2, "pending")}
    assert suggestions.upserted(stored, incoming.where("false"), 1).count() == 0


def test_reviews_and_previews(spark):
    events = [
        (1, 1, "preview", "ready", 10), (1, 2, "decision", "approved", 20), (1, 3, "decision", "activated", 30), (1, 4, "decision", "rejected", 40), (2, 1, "preview", "failed", 10), (2, 2, "decision", "approved", 20), (2, 3, "decision", "rejected", 30),
        (3, 1, "preview", "already_connected", 5), (3, 2, "decision", "approved", 6), (4, 1, "decision", "rejected", 7), (4, 2, "preview", "ready", 8), (5, 1, "preview", "nonsense", 1), (6, 1, "decision", "approved", 1), (6, 2, "decision", "activation_failed", 2), (6, 3, "decision", "approved", 3),
    ]
    got = {r["suggestion_id"]: tuple(r)[1:] for r in suggestions.transitions(spark.createDataFrame(events, "suggestion_id long, no int, kind string, value string, ts long")).collect()}
    assert got == {1: ("activated", "ready", 30, 1), 2: ("rejected", "failed", 30, 1), 3: ("already_connected", "already_connected", None, 1), 4: ("rejected", "ready", 7, 0), 5: ("pending", None, None, 1), 6: ("approved", None, 3, 0)}
