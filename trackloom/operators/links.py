"""Feasibility of points, links between levels, patches, mosaics and look-ahead grades."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.scalars import point_segment_distance, tile_name
from trackloom.operators.joins import as_of_forward, dealt, distance_to_blocked, upsert
from trackloom.operators.windows import arc_lengths


def feasibility(points: DataFrame, cells: DataFrame, keys: list[str], width: int, height: int, radius: float) -> DataFrame:
    """JON-07: reason (outside, unknown, forbidden, too_close, ok) and distance_m to what blocks, null where it is not asked."""
    keyed = points.withColumn("_cx", F.floor("x")).withColumn("_cy", F.floor("y"))
    mask = cells.select(F.col("cx").cast("long").alias("_cx"), F.col("cy").cast("long").alias("_cy"), F.col("blocked").alias("_b"))
    met = distance_to_blocked(keyed.join(mask, ["_cx", "_cy"], "left"), cells, keys, 1.0, radius)
    inside = F.col("_cx").between(0, width - 1) & F.col("_cy").between(0, height - 1)
    reason = F.when(~inside, "outside").when(F.col("_b").isNull(), "unknown").when(F.col("_b"), "forbidden").when(F.col("clearance") < radius, "too_close").otherwise("ok")
    rows = met.withColumn("reason", reason)
    return rows.withColumn("distance_m", F.when(F.col("reason") == "forbidden", 0.0).when(F.col("reason").isin("too_close", "ok"), F.col("clearance"))).drop("_cx", "_cy", "_b", "clearance")


def mosaic_sample(points: DataFrame, dem: DataFrame, keys: list[str], step: float) -> DataFrame:
    """JON-18: height of the pixel of dem(tile, px, py, height) that holds each (lon, lat), null where no tile does."""
    keyed = points.select(*keys, tile_name("lat", "lon").alias("tile"), F.floor((F.col("lon") - F.floor("lon")) / step).alias("px"), F.floor((F.col("lat") - F.floor("lat")) / step).alias("py"))
    return keyed.join(dem, ["tile", "px", "py"], "left").select(*keys, "height")


def patched(base: DataFrame, patch: DataFrame, keys: list[str], base_hash: str, patch_hash: str, derived: list[str]) -> DataFrame:
    """JON-25: chunks replaced by those of a patch that was made for this base and holds no derived layer."""
    if base_hash != patch_hash:
        raise ValueError("the patch was made for another base")
    if patch.where(F.col("layer").isin(*derived)).limit(1).count():
        raise ValueError("the patch holds a derived layer")
    return upsert(base, patch, keys)


def traversals(track: DataFrame, links: list[tuple[int, float, float, float, float]], ends: float, footprint: float, path: str = "path_id") -> DataFrame:
    """JON-26: (path, link, i, j) of each way through a link(id, ax, ay, bx, by): near one end, within the footprint, near the other; links are few and fixed."""
    kind = track.schema[path].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        p, out = rows[["x", "y"]].to_numpy(dtype=float).tolist(), []

        def away(q, ax, ay, bx, by):
            dx, dy = bx - ax, by - ay
            square = dx * dx + dy * dy
            t = min(1.0, max(0.0, ((q[0] - ax) * dx + (q[1] - ay) * dy) / square)) if square else 0.0
            return math.hypot(q[0] - ax - t * dx, q[1] - ay - t * dy)

        for link, ax, ay, bx, by in links:
            i = 0
            while i < len(p):
                at_a, at_b = math.dist(p[i], (ax, ay)) <= ends, math.dist(p[i], (bx, by)) <= ends
                hit = None
                if at_a or at_b:
                    goal = (bx, by) if at_a else (ax, ay)
                    for j in range(i + 1, len(p)):
                        if math.dist(p[j], goal) <= ends:
                            hit = j
                            break
                        if away(p[j], ax, ay, bx, by) > footprint:
                            break
                if hit is not None:
                    out.append((rows[path].iloc[0], link, i, hit))
                i = hit + 1 if hit is not None else i + 1
        return pd.DataFrame(out, columns=[path, "link", "i", "j"])

    return track.groupBy(path).applyInPandas(run, f"{path} {kind}, link long, i long, j long")


def near_links(points: DataFrame, links: DataFrame, radius: float, size: float = 50.0) -> DataFrame:
    """JON-27: points within ``radius`` of a link(link, ax, ay, bx, by), met in the square buckets that the link's box, widened by the radius, touches."""

    def reached(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor((F.least(a, b) - radius) / size), F.floor((F.greatest(a, b) + radius) / size)))

    spread = links.withColumn("_bx", reached("ax", "bx")).withColumn("_by", reached("ay", "by"))
    keyed = points.withColumn("_bx", F.floor(F.col("x") / size)).withColumn("_by", F.floor(F.col("y") / size))
    return keyed.join(spread, ["_bx", "_by"]).where(point_segment_distance("x", "y", "ax", "ay", "bx", "by") <= radius).drop("_bx", "_by")


def link_measures() -> dict[str, Column]:
    """SCA-22: length, level length, rise and cost of links(ax, ay, az, bx, by, bz, unit_cost, wait_s), waiting priced at 3 m/s."""
    dx, dy, dz = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("bz") - F.col("az")
    length = F.sqrt(dx * dx + dy * dy + dz * dz)
    return {"length_3d": length, "length_flat": F.hypot(dx, dy), "rise": dz, "cost": length * F.col("unit_cost") + F.col("wait_s") * 3.0}


def look_ahead_grade(track: DataFrame, window: float, steps: int = 10, worst_case: bool = False, path: str = "path_id") -> DataFrame:
    """WIN-17: for each vertex the weighted mean grade over the next ``window`` metres, weights 1 down to 0.5; in the worst case a climb above 0.05 counts whole."""
    # Each vertex makes the rows at which it asks beside its own, so a path's rows are dealt once, and sorted once by arc.
    whole = W.partitionBy(path)
    rows = arc_lengths(dealt(track, path), path).withColumn("_total", F.max("arc").over(whole))
    rows = rows.withColumn("_v", F.struct("arc", "z")).withColumn("_seg", F.struct(F.col("_v").alias("v"), F.lead("_v").over(whole.orderBy("arc", "seq")).alias("n")))
    end = F.least(F.col("arc") + window, F.col("_total"))

    def asked(k: int, side: int) -> Column:
        s = F.col("arc") + (end - F.col("arc")) * float(k) / steps + 0.5 * side
        return F.struct(F.greatest(s, F.lit(0.0)).alias("at"), F.lit(1).alias("order"), F.lit(k).alias("k"), F.lit(side).alias("side"))

    own = F.struct(F.col("arc").alias("at"), F.lit(0).alias("order"), F.lit(-1).alias("k"), F.lit(0).alias("side"))
    told = rows.select(path, "seq", "_seg", F.explode(F.array(own, *[asked(k, side) for k in range(steps + 1) for side in (-1, 1)])).alias("_e"))
    line = whole.orderBy("_e.at", "_e.order", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = told.withColumn("_g", F.last(F.when(F.col("_e.order") == 0, F.col("_seg")), ignorenulls=True).over(line)).where("_e.order = 1")
    a, b = F.col("_g.v"), F.col("_g.n")
    span = b["arc"] - a["arc"]
    t = F.when(span > 0, F.least((F.col("_e.at") - a["arc"]) / span, F.lit(1.0))).otherwise(0.0)
    z = F.when(b.isNull(), a["z"]).otherwise(a["z"] + t * (b["z"] - a["z"]))
    rises = told.select(path, "seq", F.col("_e.k").alias("k"), F.col("_e.side").alias("_side"), z.alias("_z")).groupBy(path, "seq", "k")
    got = rises.agg((F.max(F.when(F.col("_side") == 1, F.col("_z"))) - F.max(F.when(F.col("_side") == -1, F.col("_z")))).alias("_g"))
    weight = 1.0 - 0.5 * F.col("k") / steps
    mean = F.sum(F.col("_g") * weight) / F.sum(weight)
    grade = F.when(F.max("_g") > 0.05, F.max("_g")).otherwise(mean) if worst_case else mean
    return got.groupBy(path, "seq").agg(grade.alias("grade"))


def barometer_error(readings: DataFrame, truth: DataFrame, run: str, time: str, read: str, true: str) -> DataFrame:
    """AGG-40: bias and root mean square of readings against the truth at or after their time."""
    met = as_of_forward(readings, truth, run, time).withColumn("_e", F.col(read) - F.col(f"_t.{true}"))
    return met.groupBy(run).agg(F.avg("_e").alias("bias"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"))
