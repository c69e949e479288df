"""Named queries over the given tables and the SQL that states their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB statement, absent where SQL cannot say it."""
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[name] = in_utc
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def joined(name: str, sep: str = "|") -> Column:
    return F.array_join(F.col(name), sep).alias(name)


def long(*names: str) -> list[Column]:
    return [F.col(name).cast("bigint").alias(name) for name in names]


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(name), 6).alias(name) for name in names]


def stamp(name: str, alias: str | None = None) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
