"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named double columns for comparison across engines."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def r6(names: Sequence[str] | str) -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Arrays of text as one comma-separated text."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})
