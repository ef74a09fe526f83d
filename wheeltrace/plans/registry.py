"""Name -> (Spark query, DuckDB text) registry used by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r(col: Column | str, digits: int = 6) -> Column:
    """Round, and turn -0.0 into 0.0 so both engines print the same value."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded(df: DataFrame, *plain: str, digits: int = 6, **cols: Column | str) -> DataFrame:
    return df.select(*plain, *[r(c, digits).alias(n) for n, c in cols.items()])


def q(expr: str, digits: int = 6) -> str:
    """SQL text for the same rounding."""
    return f"(round({expr}, {digits}) + 0e0)"
