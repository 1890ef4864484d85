"""A table of filters against the metadata of all documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparkevidence.operators import containment
from sparkevidence.plans import corpus
from sparkevidence.plans.base import query

#: Filters of the demonstration table. Fixed values.
FILTERS = (
    {}, {"source": "src1"}, {"lang": "de", "size": {"lines": 1}}, {"tags": ["long"]}, {"tags": ["long", "de"]}, {"size": {}}, {"tags": []}, {"parts": [{"kind": "title"}]}, {"parts": [{"kind": "body", "n": 2}]},
    {"parts": [{"n": 1}, {"kind": "body"}]}, {"even": True}, {"even": None}, {"half": 2.0}, {"half": "2"}, {"lang": "en", "even": False, "tags": ["short"]}, {"missing": 1}, {"parts": [{"kind": "title", "n": 2}]}, {"size": {"lines": 3, "chars": 500}},
)


def _rows(spark, sf_dir):
    """Documents with metadata as JSON text."""
    d, n = corpus.table(spark, sf_dir, "documents"), F.size(F.split("text", "\n"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    size = F.when(F.length("text") > 1000, "long").otherwise("short")
    text = F.concat(
        F.lit('{"source": '), q("source"), F.lit(', "lang": '), q("lang"), F.lit(', "size": {"chars": '), F.length("text").cast("string"), F.lit(', "lines": '), n.cast("string"), F.lit('}, "tags": ['), q(size), F.lit(", "), q("lang"), F.lit('], "even": '),
        F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit(', "half": '), F.floor(F.col("doc_id") % 10 / 2).cast("string"), F.lit(', "parts": [{"kind": "title", "n": 1}, {"kind": "body", "n": '), (F.col("doc_id") % 4).cast("string"), F.lit("}]}"),
    )
    return d.select("doc_id", text.alias("metadata"))


def _sql(x: str, wanted, top: bool = True, depth: int = 0) -> str:
    """The same test on DuckDB's JSON."""
    if isinstance(wanted, dict):
        return " AND ".join([f"json_type({x}) = 'OBJECT'", *[f"coalesce({_sql(f"json_extract({x}, '$.{k}')", v, False, depth)}, false)" for k, v in wanted.items()]])
    if isinstance(wanted, list):
        e = f"e{depth}"
        return " AND ".join([f"json_type({x}) = 'ARRAY'", *[f"len(list_filter(json_extract({x}, '$[*]'), lambda {e}: coalesce({_sql(e, w, False, depth + 1)}, false))) > 0" for w in wanted]])
    if wanted is None:
        return f"json_type({x}) = 'NULL'"
    if isinstance(wanted, bool):
        return f"json_type({x}) = 'BOOLEAN' AND {x}::VARCHAR = '{str(wanted).lower()}'"
    if isinstance(wanted, str):
        return f"json_type({x}) = 'VARCHAR' AND json_extract_string({x}, '$') = '{wanted}'"
    return f"json_type({x}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND {x}::DOUBLE = {float(wanted)}"


_META = """m AS (SELECT doc_id, ('{"source": "' || source || '", "lang": "' || lang || '", "size": {"chars": ' || len(text) || ', "lines": ' || len(string_split(text, chr(10))) || '}, "tags": ["' || CASE WHEN len(text) > 1000 THEN 'long' ELSE 'short' END || '", "' || lang || '"], "even": '
    || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "half": ' || (doc_id % 10) // 2 || ', "parts": [{"kind": "title", "n": 1}, {"kind": "body", "n": ' || doc_id % 4 || '}]}')::JSON AS j FROM documents)"""


@query(f"WITH {_META} " + " UNION ALL ".join(f"SELECT {i} AS filter_id, doc_id FROM m" + (f" WHERE coalesce({_sql('j', w)}, false)" if w else "") for i, w in enumerate(FILTERS)))
def matching_filters(spark, sf_dir):
    """Each filter with the documents whose metadata contain it."""
    filters = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(FILTERS)], "filter_id int, filter string")
    return containment.matching(_rows(spark, sf_dir), filters, "doc_id", "metadata")
