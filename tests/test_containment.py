import json
import random

from sparkevidence.operators import containment


def plain(value, wanted, top=True):
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and plain(value[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(plain(v, w, False) for v in value) for w in wanted)
    equal = lambda v: not isinstance(v, (dict, list)) and isinstance(v, bool) == isinstance(wanted, bool) and isinstance(v, str) == isinstance(wanted, str) and v == wanted
    return equal(value) or (top and isinstance(value, list) and any(equal(v) for v in value))


KEYS, LEAVES = ["a", "b c", "d'e", "ü"], [None, True, False, 0, 1, 2, 1.0, 2.5, "1", "x", "it's", ""]


def some(r, depth=3):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice(LEAVES)
    if kind < 0.6:
        return [some(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {k: some(r, depth - 1) for k in r.sample(KEYS, r.randint(0, 3))}


def part(r, value):
    """Something that value contains, often."""
    if isinstance(value, dict):
        return {k: part(r, v) for k, v in value.items() if r.random() < 0.6}
    if isinstance(value, list):
        return [part(r, v) for v in r.sample(value, r.randint(0, len(value)))]
    return value


def test_against_recursion(spark):
    r = random.Random(12)
    values = [*LEAVES, *[some(r) for _ in range(80)]]
    filters = [*LEAVES[:4], *[some(r, 2) for _ in range(15)], *[part(r, v) for v in values[12:60]]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id long, meta string")
    table = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(filters)], "filter_id long, filter string")
    got = {(x["filter_id"], x["id"]) for x in containment.matching(rows, table, "id", "meta").collect()}
    want = {(i, j) for i, w in enumerate(filters) for j, v in enumerate(values) if w == {} or plain(v, w)}
    wrong = [(filters[i], values[j], (i, j) in want) for i, j in got ^ want]
    assert not wrong, wrong[:3]


def test_odd_rows_and_filters(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, None), (3, "{broken"), (4, "[1, 2]")], "id long, meta string")
    table = spark.createDataFrame([(1, None), (2, ""), (3, "{}"), (4, "{broken"), (5, '{"a": 1.0}'), (6, "2"), (7, '{"a": "1"}')], "filter_id long, filter string")
    got = sorted((r["filter_id"], r["id"]) for r in containment.matching(rows, table, "id", "meta").collect())
    assert got == [(f, i) for f in (1, 2, 3) for i in (1, 2, 3, 4)] + [(5, 1), (6, 4)]
    assert containment.matching(rows, table.where("false"), "id", "meta").count() == 0


def test_promoted_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", '{"source": "a", "n": 1}'), (2, "b", '{"source": "b", "n": 1}')], "id long, source string, meta string").write.parquet(str(tmp_path / "t"))
    df = containment.metadata_contains(spark.read.parquet(str(tmp_path / "t")), "meta", '{"source": "a", "n": 1}', {"source": "source"})
    assert [r["id"] for r in df.collect()] == [1]
    assert "EqualTo(source,a)" in df._jdf.queryExecution().executedPlan().toString()
    assert containment.metadata_contains(spark.read.parquet(str(tmp_path / "t")), "meta", {}).count() == 2
