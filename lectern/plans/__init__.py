"""Named queries of the engine, each with DuckDB SQL for the same rows, by subject. All read given tables; shapes that
no given table has are wrapped around given rows (``wrapped``, ``wrapped_records``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder of tables) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def rows(schema: str, values: list[tuple]) -> str:
    """Rows as DuckDB SQL. ``schema``: name type, ...; values are strings, numbers, booleans and nulls."""
    names = [x.split() for x in schema.split(",")]
    cast = {"string": "VARCHAR", "long": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    shown = ", ".join(f"{n}::{cast[t]} AS {n}" for n, t in names)
    body = ", ".join("(" + ", ".join(map(_literal, v)) + ")" for v in values)
    return f"SELECT {shown} FROM (VALUES {body}) AS t({', '.join(n for n, _ in names)})"
