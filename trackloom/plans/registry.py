"""Register of named queries: a function of (spark, sf_dir), and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.fixtures import load, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(view: str | tuple[str, ...], sql: str | None = None):
    """Register a function of one or more views under its own name."""
    views = (view,) if isinstance(view, str) else view

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[load(spark, sf_dir, v) for v in views])
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def job(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def r6(x) -> Column:
    """Rounded to 6 decimals as SQL's round does, the binary product and not the decimal text deciding at halves; never -0.0."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * 1e6) / 1e6 + 0.0


def r4(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * 1e4) / 1e4 + 0.0


def q6(x: str) -> str:
    return f"(CAST(round({x}, 6) AS DOUBLE) + 0.0)"


def q4(x: str) -> str:
    return f"(CAST(round({x}, 4) AS DOUBLE) + 0.0)"
