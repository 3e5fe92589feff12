"""Registered queries: one per operator, over the driver's tables.

``register`` takes the query name and, where SQL can say the same, an independent
formulation for the check tool. ``rounded`` and ``rounded_sql`` cut sums of doubles to
nine digits on both sides, since summation order differs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def rounded_sql(sql: str, columns: Sequence[str], digits: int = 9) -> str:
    """Round the named columns of a statement; ``sql`` may start with WITH."""
    items = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({items}) FROM ({sql}) AS result"
