"""Every query over the driver's tables by name, and its SQL where SQL can express it.

A query gets Tables and returns a DataFrame; its SQL may name the same derived tables, which are put before it as
common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameloom.sources.adapters import ADAPTERS, duckdb_text, spark_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Driver tables and the tables derived from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return spark_frame(self.spark, self.sf_dir, name)


def with_tables(sql: str) -> str:
    """``sql`` after the common table expressions of the derived tables that it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ADAPTERS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(duckdb_text(name))
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{n} AS ({duckdb_text(n)})" for n in needed)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else ""
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ",\n", sql) if re.match(r"\s*WITH\b", sql) else f"\n{sql}"
    return f"WITH {recursive}{parts}{rest}"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return register


from frameloom.plans import queries_flow, queries_frames, queries_scalar, queries_tracks  # noqa: E402, F401
