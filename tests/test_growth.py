"""Rows that are shuffled do not grow with the product of two sides, nor with the copies of a place or an outline."""

import itertools
import math
import random
import time
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import along as N
from trackloom.operators import geometry as G
from trackloom.operators import joins as J
from trackloom.operators import links as L
from trackloom.operators import rasters as R
from trackloom.operators import report as RP


@contextmanager
def counting_shuffled(spark):
    """How many records the stages within have shuffled, without broadcasts."""
    told, store, gateway = [], spark._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        got = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(got.apply(i).stageId(), got.apply(i).attemptId()): got.apply(i).shuffleWriteRecords() for i in range(got.size())}

    name, before = "spark.sql.autoBroadcastJoinThreshold", stages()
    spark.conf.set(name, -1)
    try:
        yield told
    finally:
        spark.conf.unset(name)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    told.append(sum(n for k, n in stages().items() if k not in before))


def walks(spark, paths=20, steps=15):
    dice = random.Random(1)
    return spark.createDataFrame([(p, s, float(dice.randrange(40)), float(dice.randrange(40))) for p in range(paths) for s in range(steps)], "path_id long, seq long, x double, y double")


def boxes(spark, copies=200):
    corners = [(0.0, 0.0), (10.0, 5.0), (20.0, 20.0)]
    return spark.createDataFrame([(k * len(corners) + i, x, y, x + 20, y + 20) for k in range(copies) for i, (x, y) in enumerate(corners)], "region_id long, x_lo double, y_lo double, x_hi double, y_hi double")


def entered(track, held):
    at = {(r.path_id, r.seq): (r.x, r.y) for r in track.collect()}
    out = set()
    for b in held.collect():
        inside = {k for k, (x, y) in at.items() if b.x_lo <= x <= b.x_hi and b.y_lo <= y <= b.y_hi}
        out |= {(p, s, b.region_id) for p, s in inside if (p, s - 1) not in inside}
    return out


def test_f1_entries_do_not_shuffle_pairs(spark):
    track, held = walks(spark), boxes(spark)
    with counting_shuffled(spark) as told:
        got = J.box_entries(track, held).collect()
    assert {(r.path_id, r.seq, r.region_id) for r in got} == entered(track, held) and len(got) > 20_000
    assert told[0] < 5_000


def test_f5_counted_entries_shuffle_outlines_only(spark):
    track, held = walks(spark), boxes(spark)
    with counting_shuffled(spark) as told:
        got = J.box_entries(track, held, counted=True).collect()
    want = sorted((r, p, s) for p, s, r in entered(track, held))
    numbers, seen = set(), {}
    for r, p, s in want:
        seen[r, p] = seen.get((r, p), -1) + 1
        numbers.add((p, s, r, seen[r, p]))
    assert {(r.path_id, r.seq, r.region_id, r.entry) for r in got} == numbers and len(got) == len(want)
    assert told[0] < 5_000


def test_f2_points_of_one_place_ask_once(spark):
    points = spark.createDataFrame([(k, float(k % 3), 0.0) for k in range(3000)], "k long, x double, y double")
    nodes = spark.createDataFrame([(k, float(k % 2), 1.0) for k in range(1, 1000)], "node long, nx double, ny double")
    with counting_shuffled(spark) as told:
        got = J.nearest_node(points, nodes, ["k"], 4.0).collect()
    assert {(r.k, round(r.distance, 6), r.node) for r in got} == {(k, 1.0, 2 - k % 3) if k % 3 < 2 else (k, 1.414214, 1) for k in range(3000)}
    assert told[0] < 5_000


def test_f6_regions_of_one_outline_are_met_as_one(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (30, 0), (30, 30))])
    regions, points = spark.range(300).select(F.col("id").alias("region_id"), ring.alias("ring")), walks(spark).select("path_id", "seq", "x", "y")
    with counting_shuffled(spark) as told:
        got = J.points_in_regions(points, regions, size=1.0).select("path_id", "seq", "region_id").collect()
    within = {(r.path_id, r.seq) for r in points.collect() if 0 < r.y < r.x < 30}
    assert {(r.path_id, r.seq) for r in got} >= within and len({r.region_id for r in got}) == 300
    assert len(got) == 300 * len({(r.path_id, r.seq) for r in got})
    assert told[0] < 20_000


def test_f7_pairs_of_copies_come_from_their_places(spark):
    points = spark.createDataFrame([(k, 1.0 + 2 * (k % 2), 0.0) for k in range(400)], "k long, x double, y double")
    with counting_shuffled(spark) as told:
        got = J.pairs_within(points, "k", 1.5).collect()
    assert {(r.a, r.b, r.distance) for r in got} == {(a, b, 0.0) for b in range(400) for a in range(b) if (a - b) % 2 == 0}
    assert len(got) == 2 * 200 * 199 / 2 and told[0] < 2_500
    near = J.pairs_within(points, "k", 2.0).collect()
    assert {(r.a, r.b) for r in near} == {(a, b) for b in range(400) for a in range(b)} and len(near) == 400 * 399 / 2


def test_f16_totals_of_pairs_form_none(spark):
    points = spark.createDataFrame([(k, float(k % 3), 0.0) for k in range(900)], "k long, x double, y double")
    with counting_shuffled(spark) as told:
        got = J.pair_totals(points, 1.5).first()
    same, apart = 3 * 300 * 299 // 2, 2 * 300 * 300
    assert got.edges == same + apart and got.mean_length == pytest.approx(apart / (same + apart)) and told[0] < 500
    none = J.pair_totals(points.limit(0), 1.5).first()
    assert (none.edges, none.mean_length) == (0, None)


def test_f18_boxes_of_one_outline_are_met_as_one(spark):
    held = boxes(spark, copies=40).union(spark.createDataFrame([(999, 200.0, 200.0, 201.0, 201.0)], "region_id long, x_lo double, y_lo double, x_hi double, y_hi double"))
    with counting_shuffled(spark) as told:
        got = J.touching_boxes(held, "region_id", 1.0).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for b in range(120) for a in range(b)} and len(got) == 120 * 119 / 2
    assert told[0] < 10_000


def raster(spark, size=8):
    return spark.createDataFrame([(x, y, float(x * y % 5), (x + 2 * y) % 7 == 0) for x in range(size) for y in range(size)], "cx long, cy long, value double, blocked boolean")


def copies(spark, n=600):
    return spark.createDataFrame([(k, 0.25 + k % 3, 2.5) for k in range(n)], "k long, x double, y double")


def test_f21_nearest_free_cells_are_sought_once_a_place(spark):
    points, cells = copies(spark), raster(spark)
    with counting_shuffled(spark) as told:
        got = {r.k: (round(r.distance, 9), r.cy, r.cx) for r in J.nearest_free(points, cells, ["k"], 1.0, 3.0).collect()}
    free = [(r.cy, r.cx) for r in cells.collect() if not r.blocked]
    for k, x, y in points.collect():
        assert got[k] == min((round(((cx + 0.5 - x) ** 2 + (cy + 0.5 - y) ** 2) ** 0.5, 9), cy, cx) for cy, cx in free)
    assert len(got) == 600 and told[0] < 3_000


def test_f23_clearance_is_sought_once_a_place(spark):
    points, cells = copies(spark), raster(spark)
    with counting_shuffled(spark) as told:
        got = {r.k: r.clearance for r in J.distance_to_blocked(points, cells, ["k"], 1.0, 3.0).collect()}
    shut = [(r.cx, r.cy) for r in cells.collect() if r.blocked]
    for k, x, y in points.collect():
        assert got[k] == pytest.approx(min(3.0, *(((cx + 0.5 - x) ** 2 + (cy + 0.5 - y) ** 2) ** 0.5 for cx, cy in shut)))
    assert len(got) == 600 and told[0] < 3_000


def test_f22_variance_is_told_once_a_cell(spark):
    points, cells = copies(spark), raster(spark)
    with counting_shuffled(spark) as told:
        got = {r.k: r.variance for r in R.local_variance(points, cells, ["k"]).collect()}
    open_ = {(r.cx, r.cy): r.value for r in cells.collect() if not r.blocked}
    for k, x, y in points.collect():
        v = [open_[c] for c in ((int(x) + dx, int(y) + dy) for dx in range(-3, 4) for dy in range(-3, 4)) if c in open_]
        assert got[k] == pytest.approx(sum((u - sum(v) / len(v)) ** 2 for u in v) / len(v))
    far = R.local_variance(spark.createDataFrame([(1, 900.0, 2.0), (2, None, 2.0)], "k long, x double, y double"), cells, ["k"])
    assert {r.k: r.variance for r in far.collect()} == {1: float("inf"), 2: float("inf")}
    assert len(got) == 600 and told[0] < 3_000


def legs(spark, n=300):
    return spark.createDataFrame([(k, 0.5, 0.5, 6.5 if k % 2 else 0.5, 3.5) for k in range(n)], "k long, x0 double, y0 double, x1 double, y1 double")


def test_f19_f20_segments_of_the_same_ends_are_followed_once(spark):
    cells = raster(spark).where("blocked")
    with counting_shuffled(spark) as told:
        got = J.blocked_segments(legs(spark).where("k > 0"), cells.where("cx = 3"), ["k"]).collect()
    assert {r.k for r in got} == {k for k in range(1, 300) if k % 2} and len(got) == 150 and told[0] < 1_500
    with counting_shuffled(spark) as told:
        entered = [(r.k, r.cx, r.cy) for r in J.segment_cells(legs(spark, 2), 1.0).collect()]
    assert len(set(entered)) == len(entered) and {(cx, cy) for k, cx, cy in entered if k == 0} == {(0, y) for y in range(4)}
    assert told[0] == 0


def test_f17_costs_of_the_same_ends_are_summed_once(spark):
    cells = raster(spark).withColumn("blocked", F.lit(False))
    with counting_shuffled(spark) as told:
        got = {r.k: r.cost for r in R.segment_costs(legs(spark), cells, ["k"]).collect()}
    assert len(got) == 300 and len(set(got.values())) == 2 and None not in got.values() and told[0] < 1_500
    shut = R.segment_costs(legs(spark), cells.withColumn("blocked", F.col("cx") == 3), ["k"]).collect()
    assert {r.k: r.cost for r in shut} == {k: None if k % 2 else got[0] for k in range(300)}


def test_f24_a_vertex_asks_without_more_shuffles(spark):
    track = walks(spark).withColumn("z", F.col("x") / 10)
    with counting_shuffled(spark) as told:
        got = L.look_ahead_grade(track, 20.0).collect()
    assert len(got) == 300 and told[0] < 1_000


def test_f27_shares_of_long_vectors_take_one_pass(spark):
    rows = spark.range(20).select("id", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: (i * (F.col("id") + 1) % 7).cast("double")).alias("v"))
    began = time.monotonic()
    got = rows.select("id", S.softmax("v", 2.0).alias("p")).collect()
    assert time.monotonic() - began < 20  # minutes where each element adds up all others
    for r in got:
        e = [math.exp((i * (r.id + 1) % 7 - (6 if r.id != 6 else 0)) / 2.0) for i in range(500)]
        assert r.p == pytest.approx([x / sum(e) for x in e])
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None])], "id long, v array<double>")
    assert {r.id: r.p for r in odd.select("id", S.softmax("v").alias("p")).collect()} == {1: None, 2: [], 3: [0.5, 0.5]}


def counting_sizes(monkeypatch, owner, name):
    sizes, plain = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda a, *rest: sizes.append(np.size(a)) or plain(a, *rest))
    return sizes


def test_f25_folds_are_sought_within_their_reach(monkeypatch):
    dice = np.random.default_rng(3)
    walk = np.cumsum(dice.uniform(-0.9, 1.0, size=(2000, 2)), axis=0)
    copied = np.repeat(walk[:200], 50, axis=0)
    sizes = counting_sizes(monkeypatch, np, "hypot")
    alone = G._without_folds(walk[:200], 12.0, 1.0, frozenset(), 1.0)
    few = sum(sizes)
    kept = G._without_folds(copied, 12.0, 1.0, frozenset(), 1.0)
    assert sum(sizes) == 2 * few and sorted({k // 50 for k in kept}) == alone and 20 < len(alone) < 200
    assert 200 < len(G._without_folds(walk, 12.0, 1.0, frozenset(), 1.0)) < 2000 and sum(sizes) < 400_000


def test_f26_few_places_are_looked_at_behind_a_turn(monkeypatch):
    corners = np.array([(30.0 * (k // 2), 30.0 * ((k + 1) // 2 % 2)) for k in range(600)])
    sizes = counting_sizes(monkeypatch, G, "_turned")
    found = G._reversals(G._Line(corners), 4.0, math.radians(60))
    assert len(found) == 598 and {kind for _, _, kind in found} == {"corner"} and sum(sizes) < 1_000 * len(found)


def test_f29_ways_of_the_same_ends_are_painted_once(spark):
    ways = spark.range(300_000, numPartitions=1).selectExpr("id AS seq", "id % 2 * 4e0 AS x0", "0e0 AS y0", "id % 2 * 4e0 + 3 AS x1", "1.5e0 AS y1", "1.2e0 AS half", "id % 9 AS surface", "id % 50 / 10e0 AS traffic", "0e0 AS crowding", "id / 3e5 AS lighting")
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    got = {(r.cx, r.cy): r for r in R.painted_ways(ways).collect()}
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    peak = max(store.taskList(st.stageId(), st.attemptId(), 99).apply(0).taskMetrics().get().peakExecutionMemory() for st in map(stages().apply, range(stages().size())) if st.stageId() not in before and st.numCompleteTasks())
    assert (got[0, 0].surface, got[0, 0].traffic, got[0, 0].lighting) == (299_998 % 9, 4.8, 299_998 / 3e5)  # even ways
    assert (got[6, 1].surface, got[6, 1].traffic, got[6, 1].lighting) == (299_999 % 9, 4.9, 299_999 / 3e5)  # odd ways
    assert peak < 200 * 2**20, peak


def test_f30_an_outline_is_filled_once(spark, tmp_path, monkeypatch):
    from trackloom.plans import catalog

    spark.range(1, 481).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "1e0 AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    met, filled = [], R.filled_cells
    monkeypatch.setattr(R, "filled_cells", lambda corners, key: met.append(corners.select(key).distinct().count()) or filled(corners, key))
    got = {r.region_id: r.cells for r in catalog.queries()["grp_11_filled_cells"](spark, str(tmp_path)).collect()}
    assert got == {k: 210 if k % 2 else 400 for k in range(1, 481)} and met == [80]


def test_f8_queries_of_the_same_ends_meet_entries_once(spark):
    copies = spark.range(60_000)
    queries = copies.selectExpr("id AS query", "id % 2 AS library", "1 AS params", "1e0 AS sx", "1e0 AS sy", "1e0 AS gx", "1e0 AS gy")
    entries = copies.selectExpr("0L AS library", "id AS idx", "9e0 AS sx", "1e0 AS sy", "1e0 AS ex", "1e0 AS ey").union(spark.sql("SELECT 1L, id, 1e0, 2e0, 1e0, 1e0 FROM range(3)"))
    libraries = spark.createDataFrame([(0, 1), (1, 1)], "library long, params int")
    began = time.monotonic()
    got = N.library_lookup(queries, libraries, entries, 25.0, 5.0).groupBy("miss", "to_start", "to_goal").agg(F.count("*").alias("n"), F.count_distinct("query", F.coalesce("idx", F.lit(-1))).alias("m")).collect()
    assert {tuple(r) for r in got} == {("too_far", 8.0, 0.0, 30_000, 30_000), (None, 1.0, 0.0, 90_000, 90_000)}
    assert time.monotonic() - began < 30  # 1.8 billion pairs of rows where each query meets each entry


def test_f28_a_report_shuffles_samples_once_for_all_their_measures(spark):
    dice = random.Random(28)
    rows = [(r, float(s), s, dice.uniform(0, 6), dice.uniform(-0.1, 0.1), dice.uniform(-1, 1), s * 3.0, dice.random() < 0.1, dice.random() < 0.1) for r in range(20) for s in range(60)]
    samples = spark.createDataFrame(rows, "run_id long, time_s double, event_id long, speed double, kappa_eff double, offset_m double, arc_s double, standing boolean, turning boolean").localCheckpoint()
    track = walks(spark).withColumnRenamed("path_id", "run_id").localCheckpoint()
    errors = samples.select("run_id", F.col("speed").alias("horizontal"), F.col("offset_m").alias("vertical"), "speed").localCheckpoint()
    with counting_shuffled(spark) as told:
        got = RP.run_report(samples, track, "run_id", ["time_s", "event_id"], 1.0, 20.0, 2.5, 0.05, errors=errors).collect()
    assert len(got) == 20 and all(r.laps == 8 and r.fix_speed_p95 is not None and r.position_memory >= 1 for r in got)
    # samples for their measures and for the laps, the path's vertices, and rows that are one a run or a lap
    assert told[0] <= 2.8 * len(rows)


def test_f28_memories_told_at_once_are_those_told_alone(spark):
    dice = random.Random(29)
    sizes = {1: 1, 2: 2, 3: 3, 4: 6, 5: 40, 6: 90}
    rows = [(r, float(s // 2), s, sum(dice.uniform(-1, 1) for _ in range(3)) + s / 10, math.sin(s / 5), 2.0) for r, n in sizes.items() for s in range(n)]
    samples = spark.createDataFrame(rows, "run_id long, time_s double, event_id long, a double, b double, still double")
    held, told = RP.residual_memories(samples, "run_id", ["time_s", "event_id"], {c: c for c in ("a", "b", "still")}, 4.0)
    got = {r.run_id: r for r in held.groupBy("run_id").agg(*[c.alias(n) for n, c in told.items()]).collect()}
    for c in ("a", "b", "still"):
        alone = {r.run_id: (r.acf_1, r.lag) for r in RP.residual_memory(samples, "run_id", ["time_s", "event_id"], c, 4.0).collect()}
        assert alone.keys() == got.keys() == sizes.keys()
        for k, (acf, lag) in alone.items():
            assert got[k][f"{c}_memory"] == lag and got[k][f"{c}_acf_1"] == (acf if acf is None else pytest.approx(acf, abs=1e-12)), (c, k)


def turns(values):
    return sum(a != b for a, b in itertools.pairwise(values))


def test_r04_f2_f6_entries_into_boxes_of_one_outline_follow_one_another(spark):
    track, held = walks(spark, paths=60), boxes(spark, copies=20)
    with counting_shuffled(spark):
        got = J.box_entries(track, held).collect()
    assert {(r.path_id, r.seq, r.region_id) for r in got} == entered(track, held) and len(got) > 5_000
    assert turns([r.region_id % 3 for r in got]) < 3 * 16
    counted = J.box_entries(track, held, counted=True).collect()
    assert len(counted) == len(got) and turns([(r.region_id, r.entry) for r in counted]) < len(got) / 2


def test_r04_f3_f6_pairs_with_outlines_of_few_regions_are_not_shuffled(spark):
    track = walks(spark, paths=20)
    own = spark.range(300).selectExpr("id AS region_id", "id / 1e3 AS x_lo", "0e0 AS y_lo", "30 + id / 1e3 AS x_hi", "40e0 AS y_hi").localCheckpoint()
    with counting_shuffled(spark) as told:
        got = J.box_entries(track, own).collect()
    assert {(r.path_id, r.seq, r.region_id) for r in got} == entered(track, own) and len(got) > 20_000 and told[0] < 10_000
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x_lo", "y_lo"), ("x_hi", "y_lo"), ("x_hi", "y_hi"), ("x_lo", "y_hi"))])
    with counting_shuffled(spark) as told:
        found = J.points_in_regions(track.select("path_id", "seq", "x", "y"), own.select("region_id", ring.alias("ring"))).collect()
    assert len(found) == sum(k / 1e3 <= r.x < 30 + k / 1e3 for r in track.collect() for k in range(300)) > 20_000 and told[0] < 10_000


def test_r04_f3_points_in_regions_of_one_outline_follow_one_another(spark):
    corner = lambda x, y: F.struct((F.col("x_lo") + x).alias("x"), (F.col("y_lo") + y).alias("y"))
    regions = boxes(spark, copies=20).select("region_id", F.array(corner(0, 0), corner(20, 0), corner(20, 20), corner(0, 20)).alias("ring"))
    points = walks(spark, paths=60).select("path_id", "seq", "x", "y")
    with counting_shuffled(spark):
        got = J.points_in_regions(points, regions, size=10.0).select("path_id", "seq", "region_id").collect()
    at = [(r.path_id, r.seq, k * 3 + i) for r in points.collect() for i, (x, y) in enumerate([(0, 0), (10, 5), (20, 20)]) if x <= r.x < x + 20 and y <= r.y < y + 20 for k in range(20)]
    assert sorted(map(tuple, got)) == sorted(at) and turns([r.region_id % 3 for r in got]) < 3 * 16


def test_r04_f4_pairs_of_copies_are_stored_in_little_room(spark, tmp_path):
    points = spark.range(6000).selectExpr("struct(id * 7919 % 1000 AS p, id AS s) AS k", "id % 30 * 10e0 AS x", "0e0 AS y")
    J.pairs_within(points, "k", 1.5).select("a.*", F.col("b.p").alias("q"), F.col("b.s").alias("t"), "distance").coalesce(1).write.parquet(f"{tmp_path}/out")
    told, stored = spark.read.parquet(f"{tmp_path}/out").count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert told == 30 * 200 * 199 // 2 and stored < told, stored / told


def test_r04_f5_pairs_of_ends_are_not_shuffled(spark):
    ends = spark.range(200)
    queries = ends.selectExpr("id AS query", "0L AS library", "1 AS params", "id / 1e2 AS sx", "1e0 AS sy", "1e0 AS gx", "1e0 AS gy")
    entries = ends.selectExpr("0L AS library", "id AS idx", "id / 1e2 AS sx", "1e0 AS sy", "1e0 AS ex", "3e0 AS ey")
    libraries = spark.createDataFrame([(0, 1)], "library long, params int")
    with counting_shuffled(spark) as told:
        got = N.library_lookup(queries, libraries, entries, 25.0, 5.0).collect()
    assert {(r.query, r.idx): r.to_start for r in got} == {(q, e): pytest.approx(abs(q - e) / 100) for q in range(200) for e in range(200)}
    assert {r.to_goal for r in got} == {2.0} and told[0] < 5_000


def test_r04_f1_a_count_is_read_and_written_once_for_rows_that_come_together():
    from trackloom.streaming import processors as P

    asked, kept = [], {}

    class Counts:
        def containsKey(self, key):
            asked.append(key)
            return key in kept

        def getValue(self, key):
            asked.append(key)
            return kept[key]

        def updateValue(self, key, value):
            asked.append(key)
            kept[key] = value

        def clear(self):
            kept.clear()

    told = P._Entries(1000, "run", "seq", "region")
    told.counts = Counts()
    visits = lambda first: [(first + k, first + k, (7, None, 8)[k % 3]) for k in range(300)]
    out, state = told.flushed((1,), visits(0), None)
    assert [r[3] for r in out if r[1] == 7] == list(range(100)) and kept == {(7,): (100,), (8,): (100,)} and len(asked) == 2
    more, state = told.flushed((1,), visits(300), state)
    assert [r[3] for r in more if r[1] == 8] == list(range(100, 200)) and kept == {(7,): (200,), (8,): (200,)} and len(asked) == 8
    late, _ = told.flushed((1,), visits(5000), state)  # silent for longer than a second: counts begin anew
    assert [r[3] for r in late if r[1] == 7] == list(range(100)) and kept == {(7,): (100,), (8,): (100,)}
