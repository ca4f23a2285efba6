"""The catalogue of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspar.sources.adapters import quoted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_first_match(text: str, table: tuple, default: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), {quoted(k)})" for k in keywords) + f" THEN {quoted(label)}" for label, keywords in table)
    return f"CASE {cases} ELSE {quoted(default)} END"


def sql_in(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"
