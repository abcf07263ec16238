"""Registry of queries, and literal fixtures that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name, each with the SQL that must give the same rows where SQL can."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        if "'" in v or "\\" in v:
            raise ValueError("a fixture string must read alike in both engines")
        return f"'{v}'"
    return repr(v)


def values(names: str, *rows) -> str:
    """SELECT over literal rows; names are separated by blanks."""
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS fixture({', '.join(names.split())})"
