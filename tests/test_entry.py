import importlib
import sys

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_names_and_flagship(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 70
    assert __spark_entry__.entry(spark).columns == ["question_id", "document_id", "matched", "score", "rank"]


def test_entry_works_without_the_llm_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sparkevidence.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkevidence.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert "top_documents" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())


@pytest.mark.parametrize("name", ["term_statistics", "apply_ingest", "top_documents", "score_cases", "source_health"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "conversations", "embeddings", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, DATA).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
