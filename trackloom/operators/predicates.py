"""Row filters, pages and reshaping projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.aggregates import finite

__all__ = ["finite"]


def moving() -> Column:
    """PRJ-01"""
    return ~F.col("standing") & ~F.col("turning")


def running(least: float = 0.5) -> Column:
    """PRJ-02"""
    return moving() & (F.col("speed") >= least)


def in_window(time: str, start, end) -> Column:
    """PRJ-04: closed; an inverted window is empty."""
    return F.col(time).between(start, end)


def strided_page(df: DataFrame, series: str, idx: str, stride: int, offset: int, limit: int) -> DataFrame:
    """PRJ-05: rows whose dense index is a multiple of ``stride``, paged on that view, with its total."""
    total = F.ceil(F.count("*").over(W.partitionBy(series)) / stride)
    view = df.withColumn("total", total).where(F.col(idx) % stride == 0).withColumn("at", F.floor(F.col(idx) / stride))
    return view.where(F.col("at").between(offset, offset + limit - 1))


def downsample(df: DataFrame, series: str, idx: str, most: int) -> DataFrame:
    """PRJ-06: about ``most`` rows evenly, and the last."""
    n = F.count("*").over(W.partitionBy(series))
    return df.withColumn("_n", n).where((F.col(idx) % F.ceil(F.col("_n") / most) == 0) | (F.col(idx) == F.col("_n") - 1)).drop("_n")


def accepts(kind: str, topics: list[str]) -> Column:
    """PRJ-08: no topics accept all; the last events of a task always pass."""
    return F.lit(True) if not topics else F.col(kind).isin(*topics, "done", "error")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def box(x0, y0, x1, y1) -> Column:
    """PRJ-09"""
    return F.struct(_c(x0).alias("x0"), _c(y0).alias("y0"), _c(x1).alias("x1"), _c(y1).alias("y1"))


def box_contains(b: Column, x, y) -> Column:
    return (_c(x) >= b["x0"]) & (_c(x) <= b["x1"]) & (_c(y) >= b["y0"]) & (_c(y) <= b["y1"])


def box_intersects(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def box_union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def box_expanded(a: Column, by) -> Column:
    return box(a["x0"] - by, a["y0"] - by, a["x1"] + by, a["y1"] + by)


def box_intersection(a: Column, b: Column) -> Column:
    """Null for disjoint boxes."""
    cut = box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when(box_intersects(a, b), cut)


def poly_ring() -> Column:
    """Corners of the fixture's squares and triangles."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")

    def corner(x, y) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(F.col("triangle") == 1, F.array(corner(x0, y0), corner(x1, y0), corner(x0, y1))).otherwise(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def ring_edges(ring: Column) -> Column:
    """Each corner with the next one."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, nexts, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def in_edges(x, y, edges: Column) -> Column:
    """Even-odd rule over a ring's edges.

    The point goes along with the sum: a lambda that refers to columns of one side of a join is
    not told apart from the other side's when such a filter is pushed down.
    """

    def step(s: Column, e: Column) -> Column:
        between = (e["ay"] > s["y"]) != (e["by"] > s["y"])
        left = s["x"] < (e["bx"] - e["ax"]) * (s["y"] - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), F.when(between & left, ~s["odd"]).otherwise(s["odd"]).alias("odd"))

    return F.aggregate(edges, F.struct(_c(x).alias("x"), _c(y).alias("y"), F.lit(False).alias("odd")), step, lambda s: s["odd"])


def point_in_ring(x, y, ring: Column) -> Column:
    """PRJ-10: even-odd rule; fewer than three corners hold nothing."""
    return (F.size(ring) >= 3) & in_edges(x, y, ring_edges(ring))


def passable(blocked) -> Column:
    """PRJ-11: in the grid and not blocked; a cell outside has no flag and counts as blocked."""
    return ~F.coalesce(_c(blocked), F.lit(True))


def mph(speed) -> Column:
    """PRJ-12"""
    return _c(speed) * 2.2369362920544025


def feet(metres) -> Column:
    """PRJ-12"""
    return _c(metres) * 3.280839895013123


def plausible(ratio, mean_speed, p95, acf_tenth) -> Column:
    """PRJ-13"""
    ok = _c(ratio).between(1, 3) & (_c(mean_speed) > 0.5) & (_c(p95) < 8) & (F.abs(_c(acf_tenth)) < 0.999)
    return F.coalesce(ok, F.lit(False))


def sensor_row(df: DataFrame, time: str, channel: str, values: list[str], keep: list[str] = ()) -> DataFrame:
    """PRJ-14: one channel's values in the row that all channels share, the other fields null."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("latitude_deg", "double"), ("longitude_deg", "double"), ("altitude_m", "double"), ("speed_mps", "double"), ("heading_rad", "double"), ("valid", "boolean"), ("satellites", "int"), ("pressure_pa", "double"))]
    return df.select(*keep, F.col(time).alias("time_s"), F.lit(channel).alias("channel"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"), *empty)


def of_gait(channel: str, activity: str | None) -> Column:
    """PRJ-15: recordings of a channel and, if given, of an activity in any case."""
    keep = F.col("channel") == channel
    return keep if activity is None else keep & (F.lower("activity") == activity.lower())


def normalise(kind: Column, raw: Column, low: Column, high: Column, palette: Column) -> Column:
    """PRJ-16: scalar within its range, category by palette, boolean 0 or 1, direction as it is; an empty range gives 0."""
    span = high - low
    scalar = F.when(F.abs(span) < 1e-12, 0.0).otherwise(F.least(F.greatest((raw - low) / span, F.lit(0.0)), F.lit(1.0)))
    return F.when(kind == "scalar", scalar).when(kind == "category", F.get(palette, F.round(raw).cast("int"))).when(kind == "boolean", (raw >= 0.5).cast("double")).otherwise(raw.cast("double"))


def unit_range(df: DataFrame, value: str) -> DataFrame:
    """PRJ-17: finite values brought to [0, 1] by their range, as ``unit``."""
    span = df.where(finite(value)).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    unit = F.when(F.col("_hi") > F.col("_lo"), F.least(F.greatest((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return df.crossJoin(F.broadcast(span)).withColumn("unit", unit).drop("_lo", "_hi")


def metric_rows(df: DataFrame, key: str, units: dict[str, str]) -> DataFrame:
    """PRJ-19: one row for each metric of a wide report, with its unit."""
    long = df.unpivot([key], list(units), "metric", "value")
    return long.withColumn("unit", F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[F.col("metric")])


def in_map(cx: str, cy: str, width: int, height: int) -> Column:
    """PRJ-20"""
    return (F.col(cx) < width) & (F.col(cy) < height)
