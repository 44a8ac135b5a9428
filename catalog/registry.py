"""One entry per query: the Spark side, and the SQL that must give the same rows.

``spec`` names the result columns, each with a kind: ``:i`` whole number, ``:d`` number
compared to six places, none for as it is. It shapes both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .oracle_tables import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(name, kind) for name, _, kind in (part.partition(":") for part in spec.split())]


def shape(df: DataFrame, spec: str) -> DataFrame:
    def column(name: str, kind: str):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        return c.alias(name)

    return df.select(*[column(*c) for c in _columns(spec)])


def shape_sql(body: str, spec: str) -> str:
    def column(name: str, kind: str) -> str:
        if kind == "i":
            return f"{name}::BIGINT AS {name}"
        if kind == "d":
            return f"round({name}::DOUBLE, 6) + 0.0 AS {name}"
        return name

    select = ", ".join(column(*c) for c in _columns(spec))
    return sql(f"SELECT {select} FROM ({body.strip()}) AS result_rows")


def query(spec: str, check: str | None = None):
    """Register the decorated function under its own name."""
    def add(make):
        name = make.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(make(spark, sf_dir), spec)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = shape_sql(check, spec)
        return make

    return add
