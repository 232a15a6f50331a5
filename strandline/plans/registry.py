"""Names of queries, with the function and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.tables import SQL as MEASUREMENTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, events: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` goes on from the measurements' common table expressions if ``events``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {MEASUREMENTS}{sql}" if events else sql
        return f

    return add
