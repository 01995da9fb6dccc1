"""All queries of the core: identifier -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import drifting, live, matching, quality, relations, scalars, scans

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [quality, scans, relations, scalars, matching, drifting, live]


def entries() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries named {name}")
            found[name] = pair
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql}
