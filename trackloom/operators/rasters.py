"""Raster jobs on cells(cx, cy, ...): statistics by level, fills, neighbourhoods, distance and cost fields."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.scalars import TAU, node_key
from trackloom.operators.joins import dealt, segment_cells
from trackloom.sources.shared import shared_base


def _at(cells: DataFrame, dx: int, dy: int, name: str, value: str = "value") -> DataFrame:
    """The value of the neighbour at (dx, dy), to be joined on cx, cy."""
    return cells.select((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.col(value).alias(name))


def chunks_in_box(cells: DataFrame, chunk: int, x0: int, y0: int, x1: int, y1: int, most: int = 1_048_576) -> DataFrame:
    """SRC-17: cells of the chunks that meet a box; a box of more than ``most`` chunks is refused."""
    cols, rows = x1 // chunk - x0 // chunk + 1, y1 // chunk - y0 // chunk + 1
    if cols * rows > most:
        raise ValueError(f"{cols * rows} chunks asked for, {most} at most")
    return cells.where(F.floor(F.col("cx") / chunk).between(x0 // chunk, x1 // chunk) & F.floor(F.col("cy") / chunk).between(y0 // chunk, y1 // chunk))


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """AGG-27: (level, cx, cy, value): each level's cells are the means of four below, missing ones counting as 0."""
    level = cells.select("cx", "cy", "value")
    out = level.select(F.lit(0).alias("level"), "cx", "cy", "value")
    for k in range(1, levels + 1):
        level = level.groupBy(F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg((F.sum("value") / 4).alias("value"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "cx", "cy", "value"))
    return out


def quadtree(cells: DataFrame, depth: int, threshold: float, directed: str | None = None) -> DataFrame:
    """AGG-28: (depth, nx, ny, key, mean, top): blocks of up to 2^depth cells whose largest value exceeds their mean by ``threshold`` at most, none within another.

    A block of several cells that holds one whose flag ``directed`` is set is divided. Cells are dealt once,
    by the largest block that holds them; all smaller ones are windows within it, so each cell
    knows the largest block around it that holds, and these are what remains.
    """
    top = [F.shiftright("cx", depth).alias("_tx"), F.shiftright("cy", depth).alias("_ty")]
    flag = F.coalesce(F.col(directed), F.lit(False)) if directed else F.lit(False)
    rows = cells.select("cx", "cy", "value", flag.alias("_directed"), *top)
    kept = None
    for k in range(depth, -1, -1):
        nx, ny = F.shiftright("cx", k), F.shiftright("cy", k)
        w = W.partitionBy("_tx", "_ty", nx, ny)
        mean, high = F.avg("value").over(w), F.max("value").over(w)
        holds = F.lit(k == 0) | (high - mean <= threshold) & ~F.max("_directed").over(w)
        node = F.when(holds, F.struct(F.lit(k).alias("k"), nx.alias("nx"), ny.alias("ny"), mean.alias("mean"), high.alias("top")))
        kept = node if kept is None else F.coalesce(kept, node)
    nodes = rows.select("_tx", "_ty", kept.alias("n")).groupBy("_tx", "_ty", "n.k", "n.nx", "n.ny").agg(F.first("n.mean").alias("mean"), F.first("n.top").alias("top"))
    key = F.lit(None).cast("long")
    for k in range(depth + 1):
        key = F.when(F.col("k") == k, node_key("nx", "ny", 16 - k)).otherwise(key)
    return nodes.select((16 - F.col("k")).alias("depth"), "nx", "ny", key.alias("key"), "mean", "top")


def covering_node(points: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """JON-23: each point(cx, cy)'s block, the smallest if there were several."""
    spread = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    key = F.lit(None).cast("long")
    for k in range(depth + 1):
        key = F.when(F.col("_k") == k, node_key(F.shiftright(F.col("cx"), k), F.shiftright(F.col("cy"), k), 16 - k)).otherwise(key)
    met = spread.withColumn("key", key).join(nodes.select("key", "depth"), "key")
    return met.groupBy("cx", "cy").agg(F.max_by("key", "depth").alias("key"), F.max("depth").alias("depth"))


def dilated(cells: DataFrame, radius: int) -> DataFrame:
    """GRP-14: each cell takes the largest value within ``radius`` cells."""
    disc = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc])
    spread = cells.select("cx", "cy", "value", F.explode(offsets).alias("_o"))
    grown = spread.groupBy((F.col("cx") + F.col("_o.dx")).alias("cx"), (F.col("cy") + F.col("_o.dy")).alias("cy")).agg(F.max("value").alias("value"))
    return grown.join(cells.select("cx", "cy"), ["cx", "cy"], "left_semi")


def swept(cells: DataFrame, first_column: int = 0) -> DataFrame:
    """GRP-15, directional form: a cell without a value takes that of its left neighbour, one in the first column that of the one above, and the first of all the first value that there is, or 0.

    Neighbours are filled before what lies behind them, so along a row the last value carries on, and a row
    that begins without one begins with what its first column has carried down: one scan of each row and one of the
    first column. ``cells(cx, cy, value)`` has a row for each cell; null and NaN are no values.
    """
    value = F.when(~F.isnan("value"), F.col("value").cast("double"))
    rows = cells.select("cx", "cy", value.alias("value"))
    told = rows.agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("cy", "cx"))).alias("_first"))
    down = F.last("value", ignorenulls=True).over(W.partitionBy("cx").orderBy("cy").rowsBetween(W.unboundedPreceding, W.currentRow))
    column = rows.where(F.col("cx") == first_column).select("cy", down.alias("_down"))
    along = F.last("value", ignorenulls=True).over(W.partitionBy("cy").orderBy("cx").rowsBetween(W.unboundedPreceding, W.currentRow))
    met = rows.withColumn("_along", along).join(column, "cy", "left").crossJoin(F.broadcast(told))
    return met.select("cx", "cy", F.coalesce("_along", "_down", "_first", F.lit(0.0)).alias("value"))


def inpainted(cells: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """GRP-15: cells without a value take the mean of their valid neighbours, ring by ring until nothing changes; what is never reached becomes 0.

    The valid neighbours of a ring are the ring before it, so a round touches that ring and the
    cells that are still empty only. Each is checkpointed, since the next one uses its rows twice.
    ``most_rounds`` is a limit for safety: an error is raised where it does not suffice.
    """
    context = cells.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(cells.sparkSession))
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    known, empty = cells.where("value is not null").select("cx", "cy", "value"), cells.where("value is null").select("cx", "cy")
    front, done, rings = known, 0, []
    while True:
        spread = front.select("cx", "cy", "value", F.explode(around).alias("_o")).select((F.col("cx") + F.col("_o.dx")).alias("cx"), (F.col("cy") + F.col("_o.dy")).alias("cy"), "value")
        front = spread.join(empty, ["cx", "cy"], "left_semi").groupBy("cx", "cy").agg(F.avg("value").alias("value")).checkpoint()
        if front.limit(1).count() == 0:
            break
        if done == most_rounds:
            raise ValueError(f"{most_rounds} rounds do not fill the raster")
        done += 1
        empty = empty.join(front, ["cx", "cy"], "left_anti").checkpoint()
        rings.append(front)
        if len(rings) == 32:  # keeps the plan short on wide holes
            rings = [functools.reduce(DataFrame.unionByName, rings).coalesce(context.defaultParallelism).checkpoint()]
    return functools.reduce(DataFrame.unionByName, [known, *rings, empty.withColumn("value", F.lit(0.0))])


def bilinear(points: DataFrame, cells: DataFrame, keys: list[str], resolution: float = 1.0) -> DataFrame:
    """GRP-16: value between the four cell centres around each point(x, y); null unless all four have one."""
    u, v = F.col("x") / resolution - 0.5, F.col("y") / resolution - 0.5
    corners = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    spread = points.withColumn("_u", u - F.floor(u)).withColumn("_v", v - F.floor(v)).withColumn("_o", F.explode(corners))
    spread = spread.withColumn("cx", F.floor(u) + F.col("_o.dx")).withColumn("cy", F.floor(v) + F.col("_o.dy"))
    weight = F.when(F.col("_o.dx") == 1, F.col("_u")).otherwise(1 - F.col("_u")) * F.when(F.col("_o.dy") == 1, F.col("_v")).otherwise(1 - F.col("_v"))
    met = spread.withColumn("_w", weight).join(cells.select("cx", "cy", "value"), ["cx", "cy"], "left")
    return met.groupBy(*keys).agg(F.when(F.count("value") == 4, F.sum(F.col("_w") * F.col("value"))).alias("value"))


def gradients(cells: DataFrame, resolution: float = 1.0) -> DataFrame:
    """GRP-17: central differences gx and gy (one-sided at the edge, 0 alone) and their slope."""
    rows = cells
    for name, dx, dy in (("_w", -1, 0), ("_e", 1, 0), ("_s", 0, -1), ("_n", 0, 1)):
        rows = rows.join(_at(cells, dx, dy, name), ["cx", "cy"], "left")

    def along(a: str, b: str) -> Column:
        return F.coalesce((F.col(b) - F.col(a)) / (2 * resolution), (F.col(b) - F.col("value")) / resolution, (F.col("value") - F.col(a)) / resolution, F.lit(0.0))

    rows = rows.withColumn("gx", along("_w", "_e")).withColumn("gy", along("_s", "_n")).drop("_w", "_e", "_s", "_n")
    return rows.withColumn("slope", F.hypot("gx", "gy"))


def _envelope(xs: list[float], squares: list[float], at: list[float]) -> list[float]:
    """For each of ``at`` the least of (x - at)^2 + square, both lists sorted: the lower envelope of the parabolas."""
    hull, starts = [], []
    for i, (x, s) in enumerate(zip(xs, squares, strict=True)):
        start = -math.inf
        while hull:
            k = hull[-1]
            start = (s + x * x - squares[k] - xs[k] * xs[k]) / (2 * (x - xs[k]))
            if start > starts[-1]:
                break
            hull.pop()
            starts.pop()
            start = -math.inf
        hull.append(i)
        starts.append(start)
    out, j = [], 0
    for x in at:
        while j + 1 < len(hull) and starts[j + 1] < x:
            j += 1
        out.append((x - xs[hull[j]]) ** 2 + squares[hull[j]])
    return out


def distance_field(cells: DataFrame, resolution: float = 1.0, reach: int | None = None, band: int = 16) -> DataFrame:
    """GRP-18: exact distance to the nearest blocked cell's centre on a raster without gaps; null without blocked cells, and beyond ``reach`` cells if that is given.

    First along columns, by windows; then along rows by the lower envelope of the columns'
    parabolas. A Python worker sees ``band`` rows of the raster at a time.
    """
    w = W.partitionBy("cx").orderBy("cy")
    y = F.when(F.col("blocked"), F.col("cy"))
    up = F.col("cy") - F.last(y, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    down = F.last(y, ignorenulls=True).over(W.partitionBy("cx").orderBy(F.desc("cy")).rowsBetween(W.unboundedPreceding, 0)) - F.col("cy")
    column = cells.select("cx", "cy", F.least(up, down).cast("double").alias("_d"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cy", "cx", "_d"]).drop_duplicates(["cy", "cx"])
        squares = []
        for _, row in rows.groupby("cy", sort=False):
            near = row[row["_d"].notna()]
            squares += _envelope(near["cx"].astype(float).tolist(), (near["_d"] ** 2).tolist(), row["cx"].astype(float).tolist()) if len(near) else [None] * len(row)
        return pd.DataFrame({"cx": rows["cx"], "cy": rows["cy"], "_s": pd.array(squares, "Float64")})

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("cx", "cy"))
    best = column.groupBy(F.floor(F.col("cy") / band).alias("_band")).applyInPandas(run, f"{kinds}, _s double")
    if reach is not None:
        best = best.where(F.col("_s") <= reach * reach)
    return cells.join(best, ["cx", "cy"], "left").withColumn("distance", F.sqrt("_s") * resolution).drop("_s")


def gradient_sectors(cells: DataFrame, sectors: int = 16) -> DataFrame:
    """GRP-19: direction of the gradient in sectors, null on blocked and flat cells."""
    rows = gradients(cells)
    index = F.pmod(F.round(F.atan2("gy", "gx") / TAU * sectors).cast("long"), F.lit(sectors).cast("long"))
    return rows.withColumn("sector", F.when(~F.col("blocked") & (F.col("slope") > 1e-9), index))


def cost_field(features: DataFrame, weights: dict[str, float], base: float, scale: float, soft: Column, blocked: str = "blocked") -> DataFrame:
    """GRP-20: (base + weighted features) * scale, no less than the soft rule and 0.001, infinite where blocked."""
    total = F.lit(base)
    for name, weight in weights.items():
        total = total + weight * F.col(name)
    return features.withColumn("cost", F.when(F.col(blocked), math.inf).otherwise(F.greatest(total * scale, soft, F.lit(1e-3))))


def cost_fields(features: DataFrame, weights: DataFrame, key: list[str], base: float) -> DataFrame:
    """GRP-21: costs of all modes: features(key, dim, value) with weights(mode, dim, weight), a small table."""
    met = features.join(F.broadcast(weights), "dim")
    return met.groupBy(*key, "mode").agg((base + F.sum(F.col("value") * F.col("weight"))).alias("cost"))


def cost_bounds(cells: DataFrame, cost: str) -> DataFrame:
    """AGG-29: least, largest and mean cost of passable cells; an error where there is none."""
    ok = F.col(cost) < math.inf
    got = cells.agg(F.min(F.when(ok, F.col(cost))).alias("low"), F.max(F.when(ok, F.col(cost))).alias("high"), F.avg(F.when(ok, F.col(cost))).alias("mean"))
    return got.withColumn("low", F.when(F.col("low").isNull(), F.raise_error(F.lit("no passable cell"))).otherwise(F.col("low")))


def heading_cost(base: Column, packed: Column, hx: Column, hy: Column, weight: float) -> Column:
    """GRP-22: cost at a cell for a heading, where a packed direction says which way is easy."""
    index = F.floor(packed / 256)
    strength = (packed - index * 256) / 255.0
    turned = 1.0 + strength * (1.0 - F.cos(index / 256 * TAU - F.atan2(hy, hx)))
    return F.when((packed > 0) & (strength > 0), base + weight * turned).otherwise(base)


def segment_costs(segments: DataFrame, cells: DataFrame, keys: list[str], step: float = 0.5) -> DataFrame:
    """GRP-23: trapezoid sum of the cell costs along each segment, in equal steps of at most ``step``; null where it enters a blocked or a missing cell.

    Segments with the same ends are followed once. One that enters a cell which is not open has no cost, and its steps are not taken.
    """
    ends = ["x0", "y0", "x1", "y1"]
    lines = dealt(segments.select(*ends).distinct(), *ends)
    entered = segment_cells(lines, 1.0).join(cells.where("not blocked").select("cx", "cy"), ["cx", "cy"], "left_anti")
    shut = entered.select(*ends).distinct()
    lines = lines.join(shut, ends, "left_anti")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    spread = lines.withColumn("_l", length).withColumn("_steps", F.greatest(F.ceil(F.col("_l") / step), F.lit(1).cast("long")))
    spread = spread.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_steps"))))
    t = F.col("_k") / F.col("_steps")
    spread = spread.withColumn("cx", F.floor(F.col("x0") + t * (F.col("x1") - F.col("x0")))).withColumn("cy", F.floor(F.col("y0") + t * (F.col("y1") - F.col("y0"))))
    weight = F.when((F.col("_k") == 0) | (F.col("_k") == F.col("_steps")), 0.5).otherwise(1.0)
    summed = spread.join(cells.select("cx", "cy", "value"), ["cx", "cy"]).groupBy(*ends).agg(F.sum(weight * F.col("value") * F.col("_l") / F.col("_steps")).alias("cost"))
    return segments.select(*keys, *ends).join(summed, ends, "left").select(*keys, "cost")


def filled_cells(corners: DataFrame, key: str) -> DataFrame:
    """GRP-11: cells(key, cx, cy) of rings(key, seq, x, y): centres inside by the even-odd rule, and every cell that an edge enters. Rings are dealt out before they become cells."""
    corners = dealt(corners, key)
    w = W.partitionBy(key).orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    edges = corners.select(key, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), first["x"]).alias("x1"), F.coalesce(F.lead("y").over(w), first["y"]).alias("y1"))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = F.when(F.ceil(low - 0.5) < F.ceil(high - 0.5), F.sequence(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1)).otherwise(F.array().cast("array<bigint>"))
    lines = edges.withColumn("cy", F.explode(rows)).withColumn("_x", F.col("x0") + (F.col("cy") + 0.5 - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    scan = W.partitionBy(key, "cy").orderBy("_x", "seq")
    spans = lines.withColumn("_n", F.row_number().over(scan)).withColumn("_to", F.lead("_x").over(scan)).where((F.col("_n") % 2 == 1) & F.col("_to").isNotNull())
    inner = F.when(F.ceil(F.col("_x") - 0.5) < F.ceil(F.col("_to") - 0.5), F.sequence(F.ceil(F.col("_x") - 0.5), F.ceil(F.col("_to") - 0.5) - 1)).otherwise(F.array().cast("array<bigint>"))
    inside = spans.select(key, F.explode(inner).alias("cx"), "cy")
    return inside.union(segment_cells(edges, 1.0).select(key, "cx", "cy")).distinct()


def painted(strokes: DataFrame) -> DataFrame:
    """GRP-12: of strokes(cx, cy, pass, rank, value, rule): the latest ``set`` stroke of a cell, raised by ``max`` strokes after it."""
    order = F.struct("pass", "rank")
    reset = strokes.where("rule = 'set'").groupBy("cx", "cy").agg(F.max(F.struct(order.alias("o"), "value")).alias("_r"))
    met = strokes.join(reset, ["cx", "cy"], "left")
    later = (F.col("rule") == "max") & (F.col("_r").isNull() | (order > F.col("_r.o")))
    got = met.groupBy("cx", "cy").agg(F.max(F.when(later, F.col("value"))).alias("_m"), F.first("_r").alias("_r"))
    return got.select("cx", "cy", F.greatest(F.col("_r.value"), F.col("_m")).alias("value"))


def painted_ways(ways: DataFrame, resolution: float = 1.0) -> DataFrame:
    """GRP-13: cells(cx, cy, surface, traffic, crowding, lighting) whose centre lies within a way's half width.

    ways(seq, x0, y0, x1, y1, half, surface, traffic, crowding, lighting): the surface is the busiest way's, the later one's on ties; the others take the largest value.
    Ways of the same ends and width paint the same cells: what they leave there is told once for all of them.
    """
    place, top = ["x0", "y0", "x1", "y1", "half"], [F.max(c).alias(c) for c in ("traffic", "crowding", "lighting")]
    ways = ways.groupBy(*place).agg(F.max_by(F.struct("traffic", "seq", "surface"), F.struct("traffic", "seq")).alias("_w"), *top)
    half = F.col("half") / resolution
    x0, y0, x1, y1 = (F.col(c) / resolution for c in ("x0", "y0", "x1", "y1"))
    spread = ways.withColumn("cx", F.explode(F.sequence(F.floor(F.least(x0, x1) - half), F.floor(F.greatest(x0, x1) + half))))
    spread = spread.withColumn("cy", F.explode(F.sequence(F.floor(F.least(y0, y1) - half), F.floor(F.greatest(y0, y1) + half))))
    px, py, dx, dy = F.col("cx") + 0.5, F.col("cy") + 0.5, x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    near = spread.where(F.hypot(px - x0 - t * dx, py - y0 - t * dy) <= half)
    return near.groupBy("cx", "cy").agg(F.max_by("_w.surface", F.struct("_w.traffic", "_w.seq")).alias("surface"), *top)


def raised(cells: DataFrame, buildings: DataFrame) -> DataFrame:
    """GRP-28: terrain with the heights of buildings(cx, cy, height) on top."""
    top = buildings.groupBy("cx", "cy").agg(F.max("height").alias("_h"))
    return cells.join(top, ["cx", "cy"], "left").withColumn("value", F.col("value") + F.coalesce("_h", F.lit(0.0))).drop("_h")


def local_variance(points: DataFrame, cells: DataFrame, keys: list[str], half: int = 3) -> DataFrame:
    """AGG-33: variance of the finite costs in the square of cells around each point; infinite for under four. It hangs on the point's own cell only and is told once for each."""
    span = F.sequence(F.lit(-half), F.lit(half))
    at = points.select(*keys, F.floor("x").alias("_i"), F.floor("y").alias("_j"))
    own = dealt(at.select("_i", "_j").distinct(), "_i", "_j")
    spread = own.withColumn("cx", F.explode(F.transform(span, lambda d: F.col("_i") + d))).withColumn("cy", F.explode(F.transform(span, lambda d: F.col("_j") + d)))
    met = spread.join(cells.where("not blocked").select("cx", "cy", "value"), ["cx", "cy"])
    told = met.groupBy("_i", "_j").agg(F.when(F.count("value") >= 4, F.var_pop("value")).alias("_v"))
    return at.join(told, ["_i", "_j"], "left").select(*keys, F.coalesce("_v", F.lit(math.inf)).alias("variance"))


def forbidden_ratio(cells: DataFrame, keys: list[str], blocked: str = "blocked") -> DataFrame:
    """AGG-25: share of blocked cells of each group, or of all."""
    return cells.groupBy(*keys).agg(F.coalesce(F.avg(F.col(blocked).cast("int")), F.lit(0.0)).alias("forbidden_ratio"))
