"""Whole jobs: every row takes part, and sizes that the fixtures lack give the same results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import joins as J
from trackloom.operators import rasters as R
from trackloom.operators import signal as SG
from trackloom.plans import catalog
from trackloom.sources.fixtures import load

SF = "/root/testdata/sf0.001"


def test_point_queries_answer_for_every_row(spark):
    points = load(spark, SF, "track").count()
    for name in ("jon_07_feasibility", "jon_08_clearance", "agg_33_local_variance"):
        assert catalog.queries()[f"{name}"](spark, SF).count() == points


def test_radius_pairs_of_all_points(spark):
    rows = load(spark, SF, "track").select("path_id", "seq", "x", "y").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    near = np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :]) <= 1.5
    got = catalog.queries()["jon_11_radius_pairs"](spark, SF)
    assert got.count() == (near.sum() - len(rows)) // 2 == catalog.queries()["agg_34_edges"](spark, SF).first().edges
    # keys of path and position stay apart where a path has over 1000 points
    assert got.select("a_path_id", "a_seq", "b_path_id", "b_seq").distinct().count() == got.count()


def test_library_hits_by_counting(spark):
    random = np.random.default_rng(3)
    asked = [(i, int(random.integers(3)), int(random.integers(60))) for i in range(80)]
    library = [(int(random.integers(3)), int(random.integers(60))) for _ in range(90)]
    got = J.counted_within(spark.createDataFrame(asked, "i long, k long, c long"), spark.createDataFrame(library, "k long, c long"), ["i"], "k", "c", 5)
    want = {i: sum(k == b and abs(c - d) <= 5 for b, d in library) for i, k, c in asked}
    assert {r.i: r.hits for r in got.collect()} == {i: n for i, n in want.items() if n}


def test_distinct_routes_see_every_path(spark):
    paths = load(spark, SF, "track").select(F.floor(F.col("path_id") / 20).alias("od")).distinct()
    assert catalog.queries()["grp_27_distinct_routes"](spark, SF).select("od").distinct().count() == paths.count()


def test_inpaint_fills_holes_wider_than_any_limit(spark):
    n = 70  # rings from one side
    cells = spark.createDataFrame([(x, 0, 4.0 if x == 0 else None) for x in range(n + 1)], "cx long, cy long, value double").coalesce(1)
    assert {r.value for r in R.inpainted(cells).collect()} == {4.0}
    with pytest.raises(ValueError):
        R.inpainted(cells, most_rounds=2)


def test_distance_field_is_exact_at_any_distance(spark):
    random = np.random.default_rng(4)
    shut = {(int(x), int(y)) for x, y in zip(random.integers(0, 20, 9), random.integers(0, 20, 9), strict=True)} | {(180, 3)}
    cells = spark.createDataFrame([(x, y, (x, y) in shut) for x in range(200) for y in range(25)], "cx long, cy long, blocked boolean")
    for r in R.distance_field(cells).collect():
        assert r.distance == pytest.approx(min(math.hypot(r.cx - x, r.cy - y) for x, y in shut))
    assert R.distance_field(cells.withColumn("blocked", F.lit(False))).where("distance is not null").count() == 0


def test_spectrum_of_a_long_series_is_one_transform(spark):
    random = np.random.default_rng(5)
    series = {1: random.normal(size=1000), 2: random.normal(size=7), 3: random.normal(size=128), 4: random.normal(size=1), 5: random.normal(size=65)}
    df = spark.createDataFrame([(s, i * (3 if s == 5 else 1), float(v)) for s, x in series.items() for i, v in enumerate(x)], "s long, i long, v double")
    got = {(r.s, r.bin): (r.frequency_hz, r.magnitude) for r in SG.spectrum(df, "s", "i", "v", 10.0, segment_rows=64).collect()}
    want = {}
    for s, x in series.items():
        n, size = len(x), 1 << (len(x) - 1).bit_length()
        if n > 1:
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            want |= {(s, k): (k * 10.0 / size, m) for k, m in enumerate(np.abs(np.fft.rfft(x * window, size)) * 2 / window.sum())}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_long_segments_pay_for_every_cell(spark):
    cells = spark.createDataFrame([(x, 0, 100.0 if x == 37 else 1.0, False) for x in range(101)], "cx long, cy long, value double, blocked boolean")
    legs = spark.createDataFrame([(1, 0.5, 0.5, 100.5, 0.5), (2, 5.5, 0.5, 5.5, 0.5)], "k long, x0 double, y0 double, x1 double, y1 double")
    cost = {r.k: r.cost for r in R.segment_costs(legs, cells, ["k"]).collect()}
    assert cost == {1: pytest.approx(199.0), 2: 0.0}
