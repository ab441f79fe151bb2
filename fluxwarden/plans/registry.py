"""Driver queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import flowview

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; {flows} and {dense} in the SQL stand for the flow views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{flows}", f"({flowview.SPARSE_SQL})").replace("{dense}", f"({flowview.DENSE_SQL})")
        return f

    return add
