"""What a path is at an arc length, terrain under it, and candidates stored for its ends."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.joins import by_outline, dealt

_LEAST_LENGTH = 1e-3  #: metres of arc below which a segment has no grade


def frame_at(vertices: DataFrame, targets: DataFrame, path: str = "path_id") -> DataFrame:
    """JON-13: target rows (path, s) with x, y, tx, ty, segment_m and, of the channels that ``vertices(path, seq, arc, x, y ..)`` have, kappa, z, grade and link_speed at arc s.

    The segment that begins at or before s counts, the first or last beyond the ends. Position and kappa are
    linear in it; the tangent is its direction, (1, 0) without length, which segment_m tells; z is linear where both its
    vertices have one, and grade is the rise over it, where it is a millimetre long; link_speed is the
    lower of its vertices' own. A path of one vertex has its position only, one of none no rows.
    """
    channels = [c for c in ("kappa", "z", "link_speed") if c in vertices.columns]
    kept = ["arc", "x", "y", *channels]
    w = W.partitionBy(path).orderBy("arc", "seq")
    v = vertices.withColumn("_v", F.struct(*kept)).withColumn("_n", F.lead("_v").over(w)).withColumn("_count", F.count("*").over(W.partitionBy(path)))
    v = v.where(F.col("_n").isNotNull() | (F.col("_count") == 1))
    left = v.select(path, F.col("arc").alias("_at"), F.lit(0).alias("_side"), F.col("seq").alias("_seq"), F.struct(F.col("_v").alias("v"), F.col("_n").alias("n")).alias("_seg"))
    right = targets.select(path, F.col("s").cast("double").alias("_at"), F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_q"))
    order = W.partitionBy(path).orderBy("_at", "_side", "_seq")
    segment = F.coalesce(F.last("_seg", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first("_seg", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("_g", segment).where("_q is not null and _g is not null")
    a, b = F.col("_g.v"), F.col("_g.n")
    span = b["arc"] - a["arc"]
    t = F.least(F.greatest((F.col("_at") - a["arc"]) / F.greatest(span, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))

    def between(c: str) -> Column:
        return F.when(b.isNull(), a[c]).otherwise(a[c] + t * (b[c] - a[c]))

    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.hypot(dx, dy)
    out = {"x": between("x"), "y": between("y"), "tx": F.when(length > 1e-12, dx / length).otherwise(F.when(b.isNotNull(), F.lit(1.0))), "ty": F.when(length > 1e-12, dy / length).otherwise(F.when(b.isNotNull(), F.lit(0.0))), "segment_m": length}
    if "kappa" in channels:
        out["kappa"] = between("kappa")
    if "z" in channels:
        out |= {"z": F.when(b["z"].isNotNull() | b.isNull(), between("z")), "grade": F.when(span > _LEAST_LENGTH, (b["z"] - a["z"]) / span)}
    if "link_speed" in channels:
        out["link_speed"] = F.least(a["link_speed"], b["link_speed"])
    return rows.select("_q.*", *[c.alias(n) for n, c in out.items()])


def clamped_bilinear(points: DataFrame, cells: DataFrame, keys: list[str], width: int, height: int, resolution: float = 1.0) -> DataFrame:
    """GRP-16 with the edge clamped: (keys, value) between the cell centres around each point(x, y), which beyond the outer centres is theirs."""
    u = F.least(F.greatest(F.col("x") / resolution - 0.5, F.lit(0.0)), F.lit(width - 1.0))
    v = F.least(F.greatest(F.col("y") / resolution - 0.5, F.lit(0.0)), F.lit(height - 1.0))
    corners = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    spread = points.select(*keys, u.alias("_u"), v.alias("_v"), F.explode(corners).alias("_o"))
    fx, fy = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    weight = F.when(F.col("_o.dx") == 1, fx).otherwise(1 - fx) * F.when(F.col("_o.dy") == 1, fy).otherwise(1 - fy)
    spread = spread.select(*keys, weight.alias("_w"), F.least(F.floor("_u") + F.col("_o.dx"), F.lit(width - 1)).alias("cx"), F.least(F.floor("_v") + F.col("_o.dy"), F.lit(height - 1)).alias("cy"))
    met = spread.join(cells.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "value"), ["cx", "cy"], "left")
    return met.groupBy(*keys).agg(F.when(F.count_if(F.col("value").isNull() & (F.col("_w") > 0)) == 0, F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col("value")).otherwise(0.0))).alias("value"))


def terrain_gradient(points: DataFrame, cells: DataFrame, keys: list[str], width: int, height: int, resolution: float = 1.0) -> DataFrame:
    """GRP-17 at points: (keys, gx, gy), differences of the clamped heights one cell to either side."""
    around = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx * resolution).alias("dx"), F.lit(dy * resolution).alias("dy")) for n, dx, dy in (("e", 1.0, 0.0), ("w", -1.0, 0.0), ("n", 0.0, 1.0), ("s", 0.0, -1.0))])
    spread = points.select(*keys, "x", "y", F.explode(around).alias("_a")).select(*keys, F.col("_a.n").alias("_side"), (F.col("x") + F.col("_a.dx")).alias("x"), (F.col("y") + F.col("_a.dy")).alias("y"))
    heights = clamped_bilinear(spread, cells, [*keys, "_side"], width, height, resolution)
    side = {n: F.max(F.when(F.col("_side") == n, F.col("value"))) for n in "ewns"}
    return heights.groupBy(*keys).agg(((side["e"] - side["w"]) / (2 * resolution)).alias("gx"), ((side["n"] - side["s"]) / (2 * resolution)).alias("gy"))


def directional_slope(dx, dy, gx="gx", gy="gy") -> Column:
    """GRP-17: rise of a gradient along a direction, 0 for none."""
    dx, dy = (F.col(c) if isinstance(c, str) else c for c in (dx, dy))
    length = F.hypot(dx, dy)
    return F.when(length > 2.0**-52, (F.col(gx) * dx + F.col(gy) * dy) / length).otherwise(0.0)


def path_grades(vertices: DataFrame, targets: DataFrame, cells: DataFrame, keys: list[str], width: int, height: int, resolution: float = 1.0, path: str = "path_id") -> DataFrame:
    """WIN-18: (keys, grade, cross_grade) at arcs s of a path: its own rise where it has heights, else the terrain's along its tangent; across, the terrain's to the left."""
    at = frame_at(vertices, targets, path)
    met = at.join(terrain_gradient(at, cells, keys, width, height, resolution), keys)
    along = directional_slope("tx", "ty")
    return met.select(*keys, (F.coalesce("grade", along) if "z" in vertices.columns else along).alias("grade"), directional_slope(-F.col("ty"), F.col("tx")).alias("cross_grade"))


def library_lookup(queries: DataFrame, libraries: DataFrame, entries: DataFrame, cell: float, attach: float = 30.0, measure: Callable[[str], Column] = F.col) -> DataFrame:
    """JON-15: (query, idx, miss, to_start, to_goal): the stored candidates of each query, or the kind of miss.

    ``queries(query, library, params, sx, sy, gx, gy)`` ask a library by the cells of ``cell`` metres of their ends;
    ``libraries(library, params)`` were made with a parameter set, ``entries(library, idx, sx, sy, ex, ey)`` are
    stored under the cells of their own. Candidates with an end over ``attach`` metres from the query's are dropped. A query
    without a candidate has one row: no_library, parameters_differ, no_entry, or too_far with the least distance that either end
    was off by; ``measure`` of the two distances is asked once for queries and entries of the same ends, which meet in blocks: no pair of rows is shuffled.
    """
    ends, kept = ["sx", "sy", "gx", "gy"], ["_at_sx", "_at_sy", "_at_ex", "_at_ey"]
    known = queries.join(libraries.select("library", F.col("params").alias("_stored"), F.lit(True).alias("_has")), "library", "left")
    fits = known.where(F.col("_has") & F.col("_stored").eqNullSafe(F.col("params")))
    stored = entries.select("library", "idx", *[F.col(c[4:]).alias(c) for c in kept])

    cells = [f"_{c}" for c in ends]
    placed = lambda rows, at: rows.select("*", *[F.floor(F.col(c) / cell).alias(k) for c, k in zip(at, cells, strict=True)])
    away = [F.hypot(F.col("_at_sx") - F.col("sx"), F.col("_at_sy") - F.col("sy")).alias("to_start"), F.hypot(F.col("gx") - F.col("_at_ex"), F.col("gy") - F.col("_at_ey")).alias("to_goal")]
    asked, held = placed(fits.select("library", *ends).distinct(), ends), placed(stored.select("library", *kept).distinct(), kept)
    met = dealt(asked, "library", *ends).join(held, ["library", *cells]).select("library", *ends, *away)
    near = (F.col("to_start") <= attach) & (F.col("to_goal") <= attach)
    told = met.groupBy("library", *ends).agg(F.count_if(near).alias("_near"), F.min("to_start").alias("to_start"), F.min("to_goal").alias("to_goal"))
    fit = F.col("_has") & F.col("_stored").eqNullSafe(F.col("params"))
    kind = F.when(F.col("_has").isNull(), "no_library").when(~F.col("_stored").eqNullSafe(F.col("params")), "parameters_differ").when(F.col("_near").isNull(), "no_entry").when(F.col("_near") == 0, "too_far")
    none = F.col("_near") == 0
    misses = known.join(told, ["library", *ends], "left").select("query", F.lit(None).cast(dict(entries.dtypes)["idx"]).alias("idx"), kind.alias("miss"), F.when(fit & none, measure("to_start")).alias("to_start"), F.when(fit & none, measure("to_goal")).alias("to_goal"))
    askers = placed(by_outline(fits.select("library", *ends, "query"), ["library", *ends]), ends).withColumnRenamed("_members", "_queries")
    holders = placed(by_outline(stored, ["library", *kept]), kept)
    hits = dealt(askers, "library", *cells).join(holders, ["library", *cells]).select("_queries", "_members", *away).where(near)
    hits = hits.select("_members", F.explode("_queries.query").alias("query"), measure("to_start").alias("to_start"), measure("to_goal").alias("to_goal"))
    hits = hits.select("query", F.explode("_members.idx").alias("idx"), "to_start", "to_goal")
    return hits.select("query", "idx", F.lit(None).cast("string").alias("miss"), "to_start", "to_goal").unionByName(misses.where("miss is not null"))


def segments_near_links(segments: DataFrame, links: DataFrame, radius: float, tolerance: float, size: float = 50.0) -> DataFrame:
    """JON-27: each segment(x0, y0, x1, y1) with each link(link, ax, ay, bx, by) whose footprint of ``radius`` it crosses, and ``is_link`` where it is the link, either way round, to ``tolerance``.

    They meet in square buckets that their boxes touch, the links' widened by the radius; a pair is told in one of them.
    """
    low, high = (lambda a, b, r=0.0: F.floor((F.least(a, b) - r) / size)), (lambda a, b, r=0.0: F.floor((F.greatest(a, b) + r) / size))
    left = segments.withColumns({"_lx": low("x0", "x1"), "_ly": low("y0", "y1")}).withColumn("_bx", F.explode(F.sequence("_lx", high("x0", "x1")))).withColumn("_by", F.explode(F.sequence("_ly", high("y0", "y1"))))
    right = links.withColumns({"_kx": low("ax", "bx", radius), "_ky": low("ay", "by", radius)}).withColumn("_bx", F.explode(F.sequence("_kx", high("ax", "bx", radius)))).withColumn("_by", F.explode(F.sequence("_ky", high("ay", "by", radius))))
    met = left.join(right, ["_bx", "_by"]).where((F.col("_bx") == F.greatest("_lx", "_kx")) & (F.col("_by") == F.greatest("_ly", "_ky")))
    p, q = [(F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))], [(F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))]
    boxes = F.lit(True)
    for i in (0, 1):
        boxes = boxes & (F.greatest(p[0][i], p[1][i]) + 2 * radius >= F.least(q[0][i], q[1][i])) & (F.greatest(q[0][i], q[1][i]) + 2 * radius >= F.least(p[0][i], p[1][i]))
    met = met.where(boxes & ((_segment_distance(p, q) <= radius) | _cross(p, q)))
    ends = lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1]) <= tolerance
    return met.withColumn("is_link", ends(p[0], q[0]) & ends(p[1], q[1]) | ends(p[0], q[1]) & ends(p[1], q[0])).drop("_bx", "_by", "_lx", "_ly", "_kx", "_ky")


def _cross(p, q) -> Column:
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *p, *q
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    whole = ux * vy - uy * vx
    t, u = ((cx - ax) * vy - (cy - ay) * vx) / whole, ((cx - ax) * uy - (cy - ay) * ux) / whole
    return F.when(F.abs(whole) > 1e-12, t.between(0, 1) & u.between(0, 1)).otherwise(False)


def _segment_distance(p, q) -> Column:
    """Least distance of an end of one segment to the other."""

    def away(point, a, b) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.least(F.greatest(((point[0] - a[0]) * dx + (point[1] - a[1]) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(point[0] - a[0] - t * dx, point[1] - a[1] - t * dy)

    return F.least(away(p[0], *q), away(p[1], *q), away(q[0], *p), away(q[1], *p))


def clearance_in_window(points: DataFrame, cells: DataFrame, keys: list[str], columns: int, rows: int, radius: float, resolution: float = 1.0) -> DataFrame:
    """JON-08: (keys, clearance): distance to the nearest blocked cell centre among the cells within ``ceil(radius / resolution)`` of a point's own and in the grid, ``radius`` if none is blocked, null if one is missing."""
    reach = max(1, math.ceil(radius / resolution))
    at = points.select(*keys, "x", "y", F.floor(F.col("x") / resolution).alias("_cx"), F.floor(F.col("y") / resolution).alias("_cy"))
    span = lambda c, most: F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(most - 1)))
    fits = (F.col("_cx") - reach < columns) & (F.col("_cx") + reach >= 0) & (F.col("_cy") - reach < rows) & (F.col("_cy") + reach >= 0)
    spread = at.where(fits).withColumn("cx", F.explode(span("_cx", columns))).withColumn("cy", F.explode(span("_cy", rows)))
    met = spread.join(cells.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "blocked"), ["cx", "cy"], "left")
    away = F.hypot((F.col("cx") + 0.5) * resolution - F.col("x"), (F.col("cy") + 0.5) * resolution - F.col("y"))
    found = met.groupBy(*keys).agg(F.when(F.count_if(F.col("blocked").isNull()) == 0, F.coalesce(F.min(F.when(F.col("blocked"), away)), F.lit(radius))).alias("_d"), F.lit(True).alias("_in"))
    return points.select(*keys).join(found, keys, "left").select(*keys, F.when(F.col("_in"), F.col("_d")).otherwise(F.lit(radius)).alias("clearance"))


def checked_points(points: DataFrame, cells: DataFrame, keys: list[str], columns: int, rows: int, radius: float, resolution: float = 1.0) -> DataFrame:
    """JON-07: (keys, reason, distance_m, cx, cy, elevation) of points(x, y) in their own order: outside, unknown, forbidden, too_close or ok.

    ``cells(cx, cy, blocked, elevation)``; the cell is that of the point within the grid, its elevation null where unknown; the distance
    is 0 on a forbidden cell and null outside, on unknown cells, and where a cell of the window is missing.
    """
    at = points.select(*keys, "x", "y", F.floor(F.col("x") / resolution).alias("cx"), F.floor(F.col("y") / resolution).alias("cy"))
    mask = cells.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.col("blocked").alias("_b"), "elevation")
    met = at.join(mask, ["cx", "cy"], "left").join(clearance_in_window(points, cells, keys, columns, rows, radius, resolution), keys)
    inside = F.col("cx").between(0, columns - 1) & F.col("cy").between(0, rows - 1)
    reason = F.when(~inside, "outside").when(F.col("_b").isNull(), "unknown").when(F.col("_b"), "forbidden").when(F.col("clearance") < radius, "too_close").otherwise("ok")
    told = met.withColumn("reason", reason)
    distance = F.when(F.col("reason") == "forbidden", 0.0).when(F.col("reason").isin("too_close", "ok"), F.col("clearance"))
    return told.select(*keys, "reason", distance.alias("distance_m"), *[F.when(inside, F.col(c)).alias(c) for c in ("cx", "cy", "elevation")])
