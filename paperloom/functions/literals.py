"""Small literal tables, given once and used both as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) if isinstance(value, int) else f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: Sequence[tuple], columns: str, name: str) -> str:
    """``(VALUES ...) AS name(columns)``."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS {name}({columns})"


def values_and(rows: Sequence[tuple], columns: str, name: str, select: str) -> str:
    """The literal rows and those of ``select``, as ``name(columns)``."""
    return f"(SELECT * FROM {values(rows, columns, '_v')} UNION ALL {select}) AS {name}({columns})"


def pick(rows: Sequence[tuple], column: int, i: str) -> str:
    """SQL for the value of a column of the literal row number ``i``."""
    return "[" + ", ".join(_sql(r[column]) for r in rows) + f"][{i} + 1]"
