"""Route choice: path sizes, probabilities, overlaps and distinct routes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.scalars import edge_key
from trackloom.operators.geometry import segments


def keyed_segments(points: DataFrame, group: str, route: str) -> DataFrame:
    """SCA-33: (group, route, key, length) of each route's legs."""
    rows = segments(points.withColumn("_r", F.struct(group, route)), "_r")
    return rows.select(f"_r.{group}", f"_r.{route}", edge_key("x0", "y0", "x1", "y1").alias("key"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length"))


def path_sizes(points: DataFrame, group: str, route: str) -> DataFrame:
    """GRP-24: for each leg its share of the route over the number of the group's routes that use it, summed, within [0.001, 1]; a lone route has 1."""
    legs = keyed_segments(points, group, route)
    used = legs.groupBy(group, "key").agg(F.count_distinct(route).alias("_used"))
    routes = legs.groupBy(group).agg(F.count_distinct(route).alias("_routes"))
    total = legs.groupBy(group, route).agg(F.sum("length").alias("_total"))
    met = legs.join(used, [group, "key"]).join(total, [group, route]).join(routes, group)
    size = F.sum(F.col("length") / F.col("_total") / F.col("_used"))
    out = met.groupBy(group, route).agg(F.first("_routes").alias("_routes"), size.alias("_size"))
    return out.select(group, route, F.when(F.col("_routes") == 1, 1.0).otherwise(F.least(F.greatest("_size", F.lit(0.001)), F.lit(1.0))).alias("path_size"))


def probabilities(df: DataFrame, group: str, cost: str, size: str, beta: float) -> DataFrame:
    """GRP-25: size * exp(-(cost - least cost) / beta), shared out in the group; uniform where the sum vanishes."""
    w = W.partitionBy(group)
    rows = df.withColumn("_u", F.col(size) * F.exp(-(F.col(cost) - F.min(cost).over(w)) / beta))
    total = F.sum("_u").over(w)
    return rows.withColumn("probability", F.when(total > 0, F.col("_u") / total).otherwise(1.0 / F.count("*").over(w))).drop("_u")


def overlaps(points: DataFrame, group: str, route: str) -> DataFrame:
    """GRP-26: (group, a, b, overlap), a < b: shared length over the shorter route's, for routes that share a leg."""
    legs = keyed_segments(points, group, route).groupBy(group, route, "key").agg(F.sum("length").alias("length"))
    total = legs.groupBy(group, route).agg(F.sum("length").alias("total"))
    a, b = legs.select(group, F.col(route).alias("a"), "key", "length"), legs.select(group, F.col(route).alias("b"), "key", F.col("length").alias("_other"))
    shared = a.join(b, [group, "key"]).where("a < b").groupBy(group, "a", "b").agg(F.sum(F.least("length", "_other")).alias("shared"))
    ta, tb = total.select(group, F.col(route).alias("a"), F.col("total").alias("ta")), total.select(group, F.col(route).alias("b"), F.col("total").alias("tb"))
    met = shared.join(ta, [group, "a"]).join(tb, [group, "b"])
    return met.select(group, "a", "b", (F.col("shared") / F.least("ta", "tb")).alias("overlap"))


def distinct_routes(routes: DataFrame, pairs: DataFrame, group: str, route: str, limit: float, most: int) -> DataFrame:
    """GRP-27: routes taken in order while each overlaps every one taken by ``limit`` at most, up to ``most`` a group."""
    kind_g, kind_r = (routes.schema[c].dataType.simpleString() for c in (group, route))
    close = pairs.where(F.col("overlap") > limit).groupBy(group, F.col("b").alias(route)).agg(F.collect_list("a").alias("_against"))
    met = routes.select(group, route).distinct().join(close, [group, route], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list = []
        for r, against in rows.sort_values(route)[[route, "_against"]].itertuples(index=False):
            if len(taken) < most and not (set(against) if against is not None else set()) & set(taken):
                taken.append(r)
        return pd.DataFrame({group: rows[group].iloc[0], route: taken})

    return met.groupBy(group).applyInPandas(run, f"{group} {kind_g}, {route} {kind_r}")
