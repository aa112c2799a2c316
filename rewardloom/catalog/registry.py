"""The registry the entry file reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rewardloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]

# White space as Python sees it, as a class of DuckDB's regex engine.
SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores when it is too small to fill them."""
    return spread(table(spark, folder, name))


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
