"""The named queries: each with its Spark plan and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestory.plans.views import AS_OF, with_views
from lodestory.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str):
    """Register a function of Fixtures under a name, with the SQL that gives the same rows."""

    def wrap(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql.replace("AS_OF", AS_OF), views)
        return f

    return wrap
