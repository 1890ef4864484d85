from sparkevidence.operators import health


def test_thresholds_of_four_levels(spark):
    day, now = 86400, 100 * 86400
    kind = "source_name string, total long, active long, latest_s long, quality string, service_id string, refresh_days int"
    rows = [("own", 1, 1, now - 15 * day, "PASS", "s", 50), ("service", 1, 1, now - 15 * day, "PASS", "s", 50), ("refresh", 1, 1, now - 15 * day, "PASS", "none", 7), ("default", 1, 1, now - 15 * day, "PASS", None, None), ("zero", 1, 1, now - 31 * day, "PASS", None, 0), ("no time", 1, 1, None, "PASS", None, None), ("off", 1, 0, now, "FAIL", "s", 1)]
    policy, services = spark.createDataFrame([("own", 14), ("zero", 0)], "source_name string, days int"), spark.createDataFrame([("s", 20)], "service_id string, days int")
    got = {r["source_name"]: (r["threshold"], r["health"]) for r in health.source_health(spark.createDataFrame(rows, kind), policy, now, services=services).collect()}
    assert got == {"own": (14, "stale"), "service": (20, "healthy"), "refresh": (7, "stale"), "default": (30, "healthy"), "zero": (30, "stale"), "no time": (30, "unknown"), "off": (20, "inactive")}
