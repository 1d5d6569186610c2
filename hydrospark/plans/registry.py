"""Registry of the queries and of the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from hydrospark.sources.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Views``, and DuckDB SQL for its rows if there is any."""

    def register(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return make

    return register
