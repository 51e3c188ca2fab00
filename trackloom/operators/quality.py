"""Data-quality rules: what breaks a rule comes out as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def not_increasing(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """DQC-01: rows whose time is not after the one before."""
    before = F.lag(time).over(W.partitionBy(*keys).orderBy(tie))
    return df.withColumn("_b", before).where(F.col(time) <= F.col("_b")).drop("_b")


def leaps(track: DataFrame, limit: float, path: str = "path_id") -> DataFrame:
    """DQC-02: steps longer than ``limit``."""
    w = W.partitionBy(path).orderBy("seq")
    return track.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).where(F.col("step") > limit)


def too_fast(df: DataFrame, run: str, order: list[str], time: str, speed: str, good: Column, slack: float) -> DataFrame:
    """DQC-03: good rows whose way since the last row, (x, y) over time, exceeds the stated speed by ``slack``."""
    w = W.partitionBy(run).orderBy(*order)
    rate = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / (F.col(time) - F.lag(time).over(w))
    return df.withColumn("rate", rate).where(good & (F.col("rate") > F.col(speed) + slack))


def off_ground(track: DataFrame, cells: DataFrame) -> DataFrame:
    """DQC-04: points on blocked or missing cells."""
    keyed = track.withColumn("cx", F.floor("x")).withColumn("cy", F.floor("y"))
    met = keyed.join(cells.select("cx", "cy", "blocked"), ["cx", "cy"], "left")
    return met.where(F.coalesce("blocked", F.lit(True)))


def count_mismatches(df: DataFrame, run: str, channel: str, equal: list[str], present: list[str]) -> DataFrame:
    """DQC-05: runs whose ``equal`` channels differ in rows or that lack one of ``present``."""
    counts = df.groupBy(run).agg(*[F.count_if(F.col(channel) == c).alias(c) for c in {*equal, *present}])
    differs = F.greatest(*[F.col(c) for c in equal]) != F.least(*[F.col(c) for c in equal])
    lacks = F.lit(False)
    for c in present:
        lacks = lacks | (F.col(c) == 0)
    return counts.where(differs | lacks)


def restless(df: DataFrame, standing: str, x: str, y: str, z: str, slack: float = 0.8) -> DataFrame:
    """DQC-06: standing rows whose acceleration is not that of gravity."""
    size = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return df.where(F.col(standing) & (F.abs(size - 9.81) > slack))


def out_of_band(report: DataFrame, key: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """DQC-07, 10: (key, name, value) of each value outside its band; a missing value is outside."""
    long = report.unpivot([key], list(bands), "name", "value")
    low = F.create_map(*[F.lit(x) for n, (a, _) in bands.items() for x in (n, a)])[F.col("name")]
    high = F.create_map(*[F.lit(x) for n, (_, b) in bands.items() for x in (n, b)])[F.col("name")]
    return long.where(~F.coalesce(F.col("value").between(low, high), F.lit(False)))


def broken_candidates(points: DataFrame, costs: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """DQC-08: candidates with under two points or without a finite cost."""
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = F.col(cost).isNull() | F.isnan(cost) | (F.abs(cost) == float("inf")) | (F.coalesce("_n", F.lit(0)) < 2)
    return costs.join(n, keys, "left").where(bad).select(*keys)


def dangling(edges: DataFrame, nodes: DataFrame, end: str, node: str) -> DataFrame:
    """DQC-09: edges whose end is no node."""
    return edges.join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_anti")
