"""All queries outside the subpackage llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partweave.plans import extras, forms, identifiers, matchers, reports, reviews, scores, streams, uploads

_MODULES = [matchers, identifiers, forms, scores, reports, reviews, extras, streams, uploads]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
