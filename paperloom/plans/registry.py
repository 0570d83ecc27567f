"""All queries by name, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> function of spark and the tables' folder) and ORACLE_SQL (name -> DuckDB SQL).
MODULES: list[str] = [
    "paperloom.operators.retrieval",
    "paperloom.operators.usage",
    "paperloom.operators.forms",
    "paperloom.operators.fields",
    "paperloom.operators.accounts",
    "paperloom.operators.geometry",
    "paperloom.operators.images",
    "paperloom.operators.arrange",
    "paperloom.operators.outlines",
    "paperloom.operators.edits",
    "paperloom.operators.reading",
    "paperloom.operators.annotations",
    "paperloom.operators.fonts",
    "paperloom.operators.textops",
    "paperloom.operators.pages",
    "paperloom.operators.answers",
    "paperloom.operators.replies",
    "paperloom.operators.compare",
    "paperloom.operators.records",
    "paperloom.operators.layout",
    "paperloom.sources.files",
    "paperloom.sources.logs",
    "paperloom.sources.events_sink",
    "paperloom.streaming.counters",
    "paperloom.streaming.stateful",
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(m).ORACLE_SQL.items()}
