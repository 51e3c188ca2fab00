"""Stored rasters and nodes: what a box finds, and what it leaves unread."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import rasters as R
from trackloom.sources import chunks as C


def scanned(df):
    """Rows, and how many files their scan opened."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    files = leaf.metrics().get("numFiles")
    return rows, files.get().value() if files.isDefined() else 0


@pytest.mark.parametrize("most", [1, 3, 64])
def test_ranges_hold_the_box_and_little_else(most):
    rng = random.Random(1)
    for _ in range(60):
        x0, y0 = rng.randrange(40), rng.randrange(40)
        x1, y1 = x0 + rng.randrange(20), y0 + rng.randrange(20)
        ranges = C.z_ranges(x0, y0, x1, y1, most)
        numbers = {C._interleaved(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        held = [range(a, b + 1) for a, b in ranges]
        assert len(ranges) <= most and all(any(n in r for r in held) for n in numbers)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        if most == 64:
            assert {n for r in held for n in r} == numbers
    assert C.z_ranges(3, 3, 2, 9) == []


def test_a_box_reads_its_own_files(spark, tmp_path):
    """Files read follow the box, not the map of 8 by 5 zones."""
    folder = str(tmp_path / "map")
    cells = spark.range(-384, 640, 3).withColumnRenamed("id", "cx").join(spark.range(0, 640, 7).withColumnRenamed("id", "cy")).withColumn("value", (F.col("cx") * 10_000 + F.col("cy")).cast("double"))
    C.write_chunks(cells, folder, 2)
    C.write_chunks(cells.where("cx < 100 and cy < 100"), folder, 2, "other", 3)
    files = spark.read.schema(C.CELLS).parquet(folder).where("layer = 'value'").select(F.input_file_name()).distinct().count()
    for box in ((10, 10, 30, 30), (-300, 5, -200, 100), (0, 0, 300, 300), (5000, 0, 6000, 10), (40, 40, 30, 50)):
        got = C.read_box(spark, folder, 2, box)
        plan = got._jdf.queryExecution().toString()
        rows, opened = scanned(got)
        x0, y0, x1, y1 = (c // 2 for c in box)
        want = {(x, y, x * 10_000.0 + y) for x in range(-384, 640, 3) for y in range(0, 640, 7) if x0 <= x // 2 <= x1 and y0 <= y // 2 <= y1}
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        if box[0] <= box[2]:
            assert "zone" in plan.split("PartitionFilters")[1].split("]")[0] and "chunk" in plan.split("PushedFilters")[1].split("]")[0]
            assert opened <= 4 + files * (box[2] - box[0] + 256) * (box[3] - box[1] + 256) / (1024 * 640)
    assert {r.cx for r in C.read_box(spark, folder, 2, (0, 0, 639, 639), "other", 3).collect()} == {x for x in range(-384, 100, 3) if x >= 0}
    with pytest.raises(ValueError, match="chunks asked for"):
        C.read_box(spark, folder, 2, (0, 0, 10**6, 10**6))


def test_boxes_prune_as_the_scan_starts(spark, tmp_path):
    folder = str(tmp_path / "map")
    cells = spark.range(0, 640, 5).withColumnRenamed("id", "cx").join(spark.range(0, 640, 5).withColumnRenamed("id", "cy")).withColumn("value", F.lit(1.0))
    C.write_chunks(cells, folder, 2)
    boxes = [(1, 0, 0, 9, 9), (2, 5, 5, 20, 11), (3, 9, 9, 2, 2), (4, 500, 500, 510, 503)]
    got = C.read_boxes(spark, folder, 2, spark.createDataFrame(boxes, "key int, x0 long, y0 long, x1 long, y1 long"))
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    want = {(k, x, y) for k, x0, y0, x1, y1 in boxes for x in range(0, 640, 5) for y in range(0, 640, 5) if x0 // 2 <= x // 2 <= x1 // 2 and y0 // 2 <= y // 2 <= y1 // 2}
    assert sorted((r.key, r.cx, r.cy) for r in got.collect()) == sorted(want)
    with pytest.raises(Exception, match="too many chunks"):
        C.read_boxes(spark, folder, 2, spark.createDataFrame([(1, 0, 0, 9999, 9999)], "key int, x0 long, y0 long, x1 long, y1 long"), most=100).collect()


def test_nodes_that_meet_boxes(spark, tmp_path):
    rng = random.Random(4)
    cells = spark.createDataFrame([(x, y, rng.choice([0.0, 0.0, 0.0, 1.0])) for x in range(96) for y in range(80)], "cx long, cy long, value double")
    nodes = R.quadtree(cells, 5, 0.2)
    rows = [(r.depth, r.nx, r.ny) for r in nodes.collect()]
    folder = str(tmp_path / "nodes")
    C.write_nodes(nodes, folder)
    boxes = [(k, x, y, x + rng.randrange(40), y + rng.randrange(40)) for k in range(12) for x, y in [(rng.randrange(-5, 90), rng.randrange(-5, 90))]] + [(99, 5, 5, 1, 1)]

    def meeting(x0, y0, x1, y1):
        return sorted((d, nx, ny) for d, nx, ny in rows if nx << 16 - d <= x1 and nx + 1 << 16 - d > x0 and ny << 16 - d <= y1 and ny + 1 << 16 - d > y0 and x0 <= x1 and y0 <= y1)

    for k, *box in boxes:
        assert sorted((r.depth, r.nx, r.ny) for r in C.nodes_in_box(spark, folder, box).collect()) == meeting(*box)
    asked = spark.createDataFrame(boxes, "key int, x0 long, y0 long, x1 long, y1 long")
    for tile in (2, 6):
        got = sorted((r.box, r.depth, r.nx, r.ny) for r in C.nodes_in_boxes(nodes, asked, tile).collect())
        assert got == sorted((k, *n) for k, *box in boxes for n in meeting(*box))
    plan = C.nodes_in_box(spark, folder, (10, 10, 20, 20))._jdf.queryExecution().toString()
    assert "zone" in plan.split("PartitionFilters")[1].split("]")[0] and "low" in plan.split("PushedFilters")[1].split("]")[0]
