"""Registry of named queries and of the DuckDB text that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .domain import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# digits for ratios near 1, where six could fall on a tie
FINE = 10


def tidy(df: DataFrame, digits: int = 6, fine: str = "") -> DataFrame:
    """Round floating columns and widen integers so that two engines agree on values."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), FINE if field.name in fine.split() else digits) + F.lit(0.0)).alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(field.name)
        out.append(c)
    return df.select(*out)


def sql_text(body: str, views: str = "", doubles: str = "", digits: int = 6, fine: str = "") -> str:
    """Prefix a body with the named views it reads and round its floating columns."""
    names = _with_dependencies(views.split())
    prefix = ""
    if names:
        prefix = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in names) + "\n"
    if prefix and body.startswith("WITH "):
        body = "SELECT * FROM (" + body + ")"
    if not doubles:
        return prefix + body
    rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {FINE if c in fine.split() else digits}) + 0.0 AS {c}" for c in doubles.split())
    return f"{prefix}SELECT * REPLACE ({rounded}) FROM ({body}) AS checked"


def _with_dependencies(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in SQL_VIEWS[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def query(name: str, sql: str | None = None, views: str = "", doubles: str = "", digits: int = 6, fine: str = ""):
    """Register ``fn(spark, folder)`` under ``name`` together with its check."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)  # Python workers need the library's modules
            return tidy(fn(spark, folder), digits, fine)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_text(sql, views, doubles, digits, fine)
        return fn

    return register
