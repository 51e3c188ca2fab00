"""All named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import aggregate_queries, along_queries, choice_queries, geometry_queries, join_queries, quality_queries, raster_queries, reader_queries, report_queries, scalar_queries, source_queries, stream_queries, window_queries  # noqa: F401
from trackloom.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running-speed summary per runner, fastest first."""
    return QUERIES["agg_08_running_speed"](spark, sf_dir).orderBy("mean", "run_id", ascending=[False, True])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
