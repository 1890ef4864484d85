"""Where queries are registered: a name, a function of (spark, sf_dir), and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return add
