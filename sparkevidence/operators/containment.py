"""Metadata that contains a filter: objects, arrays and scalars compared to any depth in Variant columns."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters are a rule table: each becomes a part of one expression, so they are taken so many at a time, and refused beyond a bound.
AT_ONCE, MOST_FILTERS = 50, 5000


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _scalar(value: Column, wanted: Any) -> Column:
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (_kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (_kind(value) == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    number = (_kind(value) == "BIGINT") | _kind(value).startswith("DECIMAL") | _kind(value).isin("DOUBLE", "FLOAT")
    return number & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))


def _child(value: Column, key: str) -> Column:
    """The value of an object's key; keys that a path cannot name are looked up in the object as a map."""
    if re.fullmatch(r"[\w .-]+", key):
        return F.try_variant_get(value, f'$["{key}"]', "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))


def contains(value: Column, wanted: Any, top: bool = True) -> Column:
    """Whether a Variant contains a value of JSON: an object all its keys with values that are contained, an array each of its elements in
    some element, whatever their order and number; a scalar is equal. At the top an array contains a scalar that is an element of it.
    Numbers are equal by value, whatever their type. False for null."""
    known = value.isNotNull()
    if isinstance(wanted, dict):
        parts = [_kind(value).startswith("OBJECT"), *[contains(_child(value, k), v, False) for k, v in wanted.items()]]
        return F.coalesce(reduce(Column.__and__, parts, known), F.lit(False))
    elements = F.try_variant_get(value, "$", "array<variant>")
    is_array = _kind(value).startswith("ARRAY")
    if isinstance(wanted, list):
        parts = [is_array, *[F.exists(elements, lambda e: contains(e, w, False)) for w in wanted]]  # noqa: B023
        return F.coalesce(reduce(Column.__and__, parts, known), F.lit(False))
    found = _scalar(value, wanted)
    if top:
        found = found | F.coalesce(is_array & F.exists(elements, lambda e: _scalar(e, wanted)), F.lit(False))
    return F.coalesce(known & found, F.lit(False))


def metadata_contains(rows: DataFrame, metadata: str, wanted: dict | str, promoted: dict[str, str] | None = None) -> DataFrame:
    """Rows whose metadata, JSON text, contains the filter; an empty filter lets all pass, null metadata contain nothing else. promoted: top-level keys that
    are columns too; their tests are put on the columns as well, so they reach the scan."""
    wanted = json.loads(wanted) if isinstance(wanted, str) else wanted
    if not wanted:
        return rows
    for key, column in (promoted or {}).items():
        if isinstance(wanted.get(key), (str, int, float)):
            rows = rows.where(F.col(column) == F.lit(wanted[key]))
    return rows.where(contains(F.try_parse_json(F.col(metadata)), wanted))


def matching(rows: DataFrame, filters: DataFrame, key: str, metadata: str) -> DataFrame:
    """(filter_id, key) of all rows that contain a filter of a table (filter_id, filter), JSON texts. Metadata are parsed once for each
    block of filters and tested where they are; nothing is shuffled. Null, empty and {} filters let all rows pass, broken ones none; broken
    metadata contain nothing but these."""
    table = filters.select("filter_id", "filter").dropDuplicates(["filter_id"]).orderBy("filter_id").limit(MOST_FILTERS + 1).collect()
    if len(table) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    tests: list[tuple[Any, Any]] = []
    for r in table:
        try:
            tests.append((r["filter_id"], json.loads(r["filter"]) if r["filter"] and r["filter"].strip() else {}))
        except json.JSONDecodeError:
            continue
    kind = filters.schema["filter_id"].dataType
    parts = []
    for a in range(0, len(tests), AT_ONCE):
        hit = lambda v: F.filter(F.array(*[F.when(F.lit(True) if w == {} else contains(v, w), F.lit(i).cast(kind)) for i, w in tests[a : a + AT_ONCE]]), lambda x: x.isNotNull())  # noqa: B023, E731
        parsed = F.array(F.try_parse_json(F.col(metadata)))
        parts.append(rows.select(F.explode(F.element_at(F.transform(parsed, hit), 1)).alias("filter_id"), key))
    return reduce(DataFrame.unionByName, parts) if parts else rows.select(F.lit(None).cast(kind).alias("filter_id"), key).where("false")
