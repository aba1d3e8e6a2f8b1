"""Where queries register with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spanloom.sources.adapters import with_tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(needs: str = "", sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name; ``needs`` are the
    canonical tables its SQL uses."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(needs, sql) if needs else sql.strip()
        return f

    return register
