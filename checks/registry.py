"""All registered queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.compose import compose
from checks.tables_sql import TABLES
from patronage.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from checks import base, events, identity, ingest, marts, models, reads, scores

    return [base, ingest, identity, events, marts, reads, scores, models]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _modules():
        for name, build in module.QUERIES.items():
            out[name] = (lambda b: lambda spark, sf_dir: b(Tables(spark, sf_dir)))(build)
    return out


def oracle_sql() -> dict[str, str]:
    named = dict(TABLES)
    for module in _modules():
        named.update(getattr(module, "VIEWS", {}))
    return {
        name: compose(sql, named) for module in _modules() for name, sql in module.SQL.items()
    }
