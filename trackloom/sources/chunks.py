"""Rasters and quadtree nodes as files laid out in Z order, read by boxes.

Chunks are numbered by interleaved bits of their column and row. The leading bits are a zone, which is
a partition of the table; within a zone rows are in the order of their chunk. So a box names
the zones that it meets, which prunes files, and ranges of chunk numbers, which prune row groups.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.scalars import morton_encode

#: Added to a chunk's column and row, so that those left of and below the origin have numbers too.
_BIAS = 1 << 30
#: A zone is 2^_ZONE chunks wide.
_ZONE = 6
#: No more ranges than this are asked for; where a box has more, neighbours are joined.
_RANGES = 64
CELLS = "chunk long, cx long, cy long, value double, layer string, level int, zone long"
NODES = "depth int, nx long, ny long, key long, mean double, top double, low long, high long, zone long"


def z_ranges(x0: int, y0: int, x1: int, y1: int, most: int = _RANGES) -> list[tuple[int, int]]:
    """Closed ranges of Z-order numbers that hold all places (x, y) of a closed box, in order, ``most`` at most.

    Squares are divided, largest first, as long as they reach out of the box and there is room for more.
    """
    if x1 < x0 or y1 < y0:
        return []
    top = max(x1, y1, 1).bit_length()
    parts, whole = [(-top, 0, 0)], []
    while parts:
        k, x, y = heapq.heappop(parts)
        size = 1 << -k
        if x >= x0 and y >= y0 and x + size - 1 <= x1 and y + size - 1 <= y1 or k == 0 or len(parts) + len(whole) + 4 > 4 * most:
            whole.append((k, x, y))
            continue
        half = size // 2
        for cx, cy in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
            if cx <= x1 and cy <= y1 and cx + half - 1 >= x0 and cy + half - 1 >= y0:
                heapq.heappush(parts, (k + 1, cx, cy))
    ranges = sorted((_interleaved(x, y), _interleaved(x, y) + (1 << -2 * k) - 1) for k, x, y in whole)
    joined = [list(ranges[0])]
    for low, high in ranges[1:]:
        if low == joined[-1][1] + 1:
            joined[-1][1] = high
        else:
            joined.append([low, high])
    while len(joined) > most:
        k = min(range(len(joined) - 1), key=lambda i: joined[i + 1][0] - joined[i][1])
        joined[k : k + 2] = [[joined[k][0], joined[k + 1][1]]]
    return [(a, b) for a, b in joined]


def _interleaved(x: int, y: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(max(x, y, 1).bit_length()))


def _one_of(name: str, ranges: list[tuple[int, int]]) -> Column:
    """Whether a column lies in one of some ranges; single values become a list, so that partitions are found by it."""
    single = [a for a, b in ranges if a == b]
    found = [F.col(name).isin(single)] if single else []
    return reduce(lambda a, b: a | b, found + [F.col(name).between(a, b) for a, b in ranges if a != b], F.lit(False))


def chunk_number(cx, cy, chunk: int) -> Column:
    return morton_encode(F.floor(F.col(cx) / chunk) + _BIAS, F.floor(F.col(cy) / chunk) + _BIAS)


def write_chunks(cells: DataFrame, folder: str, chunk: int, layer: str = "value", level: int = 0) -> None:
    """SRC-17: lay out cells(cx, cy, value) as a layer's level below ``folder``, beside what is there.

    Rows are dealt in ranges of chunks, so a zone of any size is written by several tasks, each
    a file that holds a range of chunks in order.
    """
    rows = cells.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("chunk", chunk_number("cx", "cy", chunk)).withColumn("zone", F.shiftright("chunk", 2 * _ZONE)).withColumns({"layer": F.lit(layer), "level": F.lit(level)})
    laid = rows.repartitionByRange("chunk", "cy").sortWithinPartitions("zone", "chunk", "cy", "cx")
    laid.select("chunk", "cx", "cy", "value", "layer", "level", "zone").write.mode("append").partitionBy("layer", "level", "zone").parquet(folder)


def read_box(spark: SparkSession, folder: str, chunk: int, box: tuple[int, int, int, int], layer: str = "value", level: int = 0, most: int = 1_048_576) -> DataFrame:
    """SRC-17: (cx, cy, value) of the chunks that meet a closed box (x0, y0, x1, y1) of cells; one of more than ``most`` chunks is refused.

    Only files of zones that meet the box are opened, and of these only row groups with a chunk
    in one of the box's ranges. An inverted box holds nothing.
    """
    x0, y0, x1, y1 = (c // chunk + _BIAS for c in box)
    if (x1 - x0 + 1) * (y1 - y0 + 1) > most and x1 >= x0 and y1 >= y0:
        raise ValueError(f"{(x1 - x0 + 1) * (y1 - y0 + 1)} chunks asked for, {most} at most")
    cells = spark.read.schema(CELLS).parquet(folder).where((F.col("layer") == layer) & (F.col("level") == level))
    if x1 < x0 or y1 < y0:
        return cells.where("false").select("cx", "cy", "value")
    zones = z_ranges(x0 >> _ZONE, y0 >> _ZONE, x1 >> _ZONE, y1 >> _ZONE)
    met = cells.where(_one_of("zone", zones)).where(_one_of("chunk", z_ranges(x0, y0, x1, y1)))
    return met.where(F.floor(F.col("cx") / chunk).between(x0 - _BIAS, x1 - _BIAS) & F.floor(F.col("cy") / chunk).between(y0 - _BIAS, y1 - _BIAS)).select("cx", "cy", "value")


def read_boxes(spark: SparkSession, folder: str, chunk: int, boxes: DataFrame, layer: str = "value", level: int = 0, most: int = 1_048_576) -> DataFrame:
    """SRC-17 for boxes(key, x0, y0, x1, y1): (key, cx, cy, value) of the chunks that meet each box.

    The chunks of the boxes are joined on zone and chunk; while Spark can broadcast them, the zones
    that they name prune the scan as it starts. A box of more than ``most`` chunks fails the query, an inverted one has no rows.
    """
    c = {n: F.floor(F.col(n) / chunk) for n in ("x0", "y0", "x1", "y1")}
    right = (c["x0"] <= c["x1"]) & (c["y0"] <= c["y1"])
    count = (c["x1"] - c["x0"] + 1) * (c["y1"] - c["y0"] + 1)
    allowed = F.when(count <= most, c["x0"]).otherwise(F.raise_error(F.lit("a box asks for too many chunks")).cast("long"))
    spread = boxes.where(right).select("key", F.explode(F.sequence(allowed, c["x1"])).alias("kx"), "y0", "y1").select("key", "kx", F.explode(F.sequence(c["y0"], c["y1"])).alias("ky"))
    asked = spread.withColumn("chunk", morton_encode(F.col("kx") + _BIAS, F.col("ky") + _BIAS)).withColumn("zone", F.shiftright("chunk", 2 * _ZONE)).where("zone >= 0").select("key", "zone", "chunk")
    cells = spark.read.schema(CELLS).parquet(folder).where((F.col("layer") == layer) & (F.col("level") == level))
    return cells.join(asked, ["zone", "chunk"]).select("key", "cx", "cy", "value")


def write_nodes(nodes: DataFrame, folder: str, deepest: int = 16) -> None:
    """JON-23: lay out quadtree nodes (depth, nx, ny, key, mean, top) below ``folder`` by the Z-order range of the cells that each covers.

    Nodes wider than a zone are a partition of their own; they are few.
    """
    k = F.lit(deepest) - F.col("depth")
    corner = morton_encode(F.call_function("shiftleft", F.col("nx").cast("long"), k), F.call_function("shiftleft", F.col("ny").cast("long"), k))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * k)
    rows = nodes.withColumn("low", corner).withColumn("high", F.col("low") + size - 1)
    rows = rows.withColumn("zone", F.when(k <= _ZONE, F.shiftright("low", 2 * _ZONE)).otherwise(F.lit(-1).cast("long")))
    types = dict(f.split() for f in NODES.split(", "))
    rows.repartitionByRange("low", "high").sortWithinPartitions("zone", "low").select(*[F.col(n).cast(t).alias(n) for n, t in types.items()]).write.partitionBy("zone").parquet(folder)


def nodes_in_box(spark: SparkSession, folder: str, box: tuple[int, int, int, int], deepest: int = 16) -> DataFrame:
    """JON-23: stored nodes whose area meets a closed box (x0, y0, x1, y1) of cells with no index below 0.

    A node's cells are one Z-order range and the box's are a few, so overlapping ranges prune
    zones and row groups; what they let through beyond the box is dropped by its corners.
    """
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), box[2], box[3]
    nodes = spark.read.schema(NODES).parquet(folder)
    if x1 < x0 or y1 < y0:
        return nodes.where("false").drop("low", "high", "zone")
    zones = _one_of("zone", [(-1, -1), *z_ranges(x0 >> _ZONE, y0 >> _ZONE, x1 >> _ZONE, y1 >> _ZONE)])
    ranges = reduce(lambda a, b: a | b, [(F.col("low") <= b) & (F.col("high") >= a) for a, b in z_ranges(x0, y0, x1, y1)])
    return nodes.where(zones).where(ranges).where(_meets(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1), deepest)).drop("low", "high", "zone")


def _meets(x0: Column, y0: Column, x1: Column, y1: Column, deepest: int) -> Column:
    k = F.lit(deepest) - F.col("depth")
    corner = {c: F.call_function("shiftleft", F.col(f"n{c}").cast("long"), k) for c in "xy"}
    side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return (corner["x"] <= x1) & (corner["x"] + side > x0) & (corner["y"] <= y1) & (corner["y"] + side > y0)


def nodes_in_boxes(nodes: DataFrame, boxes: DataFrame, tile: int = 6, deepest: int = 16, most: int = 1_048_576) -> DataFrame:
    """JON-23 for boxes(key, x0, y0, x1, y1) of cells: each box's key as ``box`` with each node(depth, nx, ny, ...) whose area meets it.

    Boxes and nodes meet in tiles of 2^tile cells, on an equal key; a pair is given in the one
    tile that holds the lower left corner of what both share, so none comes twice. What covers more than
    ``most`` tiles fails the query; inverted boxes have no rows.
    """
    k = F.lit(deepest) - F.col("depth")
    low = {c: F.call_function("shiftleft", F.col(f"n{c}").cast("long"), k) for c in "xy"}
    side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    placed = nodes.withColumns({"_x0": low["x"], "_y0": low["y"], "_x1": low["x"] + side - 1, "_y1": low["y"] + side - 1})
    asked = boxes.where("x0 <= x1 and y0 <= y1").select(F.col("key").alias("box"), *[F.col(c).cast("long").alias(f"_b{c}") for c in ("x0", "y0", "x1", "y1")])

    def tiled(rows: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        t = {c: F.shiftright(c, tile) for c in (x0, y0, x1, y1)}
        count = (t[x1] - t[x0] + 1) * (t[y1] - t[y0] + 1)
        first = F.when(count <= most, t[x0]).otherwise(F.raise_error(F.lit("a box or node covers too many tiles")).cast("long"))
        return rows.withColumn("_tx", F.explode(F.sequence(first, t[x1]))).withColumn("_ty", F.explode(F.sequence(t[y0], t[y1])))

    met = tiled(placed, "_x0", "_y0", "_x1", "_y1").join(tiled(asked, "_bx0", "_by0", "_bx1", "_by1"), ["_tx", "_ty"])
    shared = {c: F.greatest(f"_{c}0", f"_b{c}0") for c in "xy"}
    meets = (F.col("_x0") <= F.col("_bx1")) & (F.col("_x1") >= F.col("_bx0")) & (F.col("_y0") <= F.col("_by1")) & (F.col("_y1") >= F.col("_by0"))
    once = (F.shiftright(shared["x"], tile) == F.col("_tx")) & (F.shiftright(shared["y"], tile) == F.col("_ty"))
    return met.where(meets & once).select("box", *nodes.columns)
