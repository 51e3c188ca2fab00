"""Order-dependent operators against plain Python, own files, and edge cases."""

import json
import math
import struct
import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates as A
from trackloom.operators import choice as C
from trackloom.operators import geometry as G
from trackloom.operators import joins as J
from trackloom.operators import links as L
from trackloom.operators import rasters as R
from trackloom.operators import signal as SG
from trackloom.operators import windows as O
from trackloom.sources import readers, writers


def track(spark, points, path=1):
    return spark.createDataFrame([(path, i, float(x), float(y), 0.0) for i, (x, y) in enumerate(points)], "path_id long, seq long, x double, y double, z double")


def test_deduplicate_compares_with_last_kept(spark):
    got = O.deduplicate(track(spark, [(0, 0), (0.6, 0), (1.2, 0), (1.8, 0), (2.4, 0)]), 1.0).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 2, 4]


def test_low_pass_is_recursive(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 10.0, 10.0])], "s long, i long, v double")
    assert [r.low for r in O.low_pass(df, "s", "i", "v", 0.1, 0.2).orderBy("i").collect()] == [0.0, 5.0, 7.5]


def test_moving_average_keeps_its_width(spark):
    values = [float(i * i % 7) for i in range(9)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "s long, i long, v double")
    for width in (1, 2, 4, 5, 9, 12):
        got = [r.smooth for r in O.moving_average(df, "s", "i", "v", width).orderBy("i").collect()]
        for i, g in enumerate(got):
            start = max(0, min(i - width // 2, len(values) - width))
            assert g == pytest.approx(np.mean(values[start : start + width])), (width, i)


def test_simplify_and_spikes(spark):
    straight = track(spark, [(i, 0.01 * (i % 2)) for i in range(10)])
    assert [r.seq for r in G.simplify(straight, 0.05).orderBy("seq").collect()] == [0, 9]
    fold = track(spark, [(0, 0), (1, 0), (2, 0), (2, 3), (2, 0.1), (4, 0)])
    assert [r.seq for r in G.remove_spikes(fold, 12.0, 1.0).orderBy("seq").collect()] == [0, 1, 2, 4, 5]
    corner = track(spark, [(0, 0), (5, 0), (10, 0), (10, 5), (10, 10)])
    turn = G.turns(corner, 4.0, 60.0).collect()
    assert len(turn) == 1 and turn[0].arc == pytest.approx(10, abs=0.1) and turn[0].kind == "corner" and turn[0].turn == pytest.approx(math.pi / 2)


def test_rings_close_or_go(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 0.0), (1, 0, 2, 1.0, 1.0), (1, 1, 0, 0.0, 0.0), (1, 1, 1, 0.0, 1.0), (1, 1, 2, 1.0, 1.0), (2, 0, 0, 0.0, 0.0), (2, 0, 1, 5.0, 5.0)]
    got = G.stitched_rings(spark.createDataFrame(rows, "rel long, fragment long, seq long, x double, y double"), "rel").collect()
    assert {r.rel for r in got} == {1} and len(got) == 5


def test_spectrum_finds_the_line(spark):
    n, rate = 1500, 100.0
    df = spark.createDataFrame([(1, i, math.sin(2 * math.pi * 2.5 * i / rate) + 0.2 * math.sin(2 * math.pi * 5 * i / rate + 0.7)) for i in range(n)], "s long, i long, v double")
    gait = SG.gait_signature(SG.spectrum(df, "s", "i", "v", rate), "s").first()
    assert gait.cadence_hz == pytest.approx(2.5, abs=0.02)
    assert gait.ratio_2 == pytest.approx(0.2, abs=0.03)


def test_distinct_routes_in_order(spark):
    points = spark.createDataFrame([(1, r, i, float(x), float(y)) for r, way in enumerate([[(0, 0), (10, 0), (20, 0)], [(0, 0), (10, 0), (20, 5)], [(0, 0), (5, 9), (20, 0)]]) for i, (x, y) in enumerate(way)], "od long, route long, seq long, x double, y double")
    pairs = C.overlaps(points, "od", "route")
    assert sorted(r.route for r in C.distinct_routes(points, pairs, "od", "route", 0.3, 9).collect()) == [0, 2]


def test_inpaint_ring_by_ring(spark):
    cells = spark.createDataFrame([(x, 0, 8.0 if x == 0 else None) for x in range(4)], "cx long, cy long, value double")
    assert {r.cx: r.value for r in R.inpainted(cells).collect()} == {0: 8.0, 1: 8.0, 2: 8.0, 3: 8.0}
    assert R.inpainted(cells.where("cx > 0")).select("value").distinct().collect()[0].value == 0.0


def test_segments_and_blocked_cells(spark):
    legs = spark.createDataFrame([(1, 0.5, 0.5, 3.5, 0.5), (2, 0.2, 0.2, 1.8, 1.8)], "k long, x0 double, y0 double, x1 double, y1 double")
    got = J.segment_cells(legs, 1.0).collect()
    assert {(r.cx, r.cy) for r in got if r.k == 1} == {(0, 0), (1, 0), (2, 0), (3, 0)}
    cells = spark.createDataFrame([(x, y, 2.0, x == 3) for x in range(4) for y in range(2)], "cx long, cy long, value double, blocked boolean")
    cost = {r.k: r.cost for r in R.segment_costs(legs, cells, ["k"]).collect()}
    assert cost[1] is None and cost[2] == pytest.approx(2 * math.hypot(1.6, 1.6))


def test_fill_covers_edges(spark):
    corners = spark.createDataFrame([(1, 0, 0.2, 0.2), (1, 1, 2.8, 0.2), (1, 2, 2.8, 2.8), (1, 3, 0.2, 2.8)], "k long, seq long, x double, y double")
    assert R.filled_cells(corners, "k").count() == 9


def test_links(spark):
    through = track(spark, [(0, 0), (5, 0), (10, 0), (20, 0), (10, 0), (4, 0.2), (0, 0)])
    got = L.traversals(through, [(7, 0.0, 0.0, 10.0, 0.0)], 0.5, 1.0).orderBy("i").collect()
    assert [(r.link, r.i, r.j) for r in got] == [(7, 0, 2), (7, 4, 6)]
    flat = L.look_ahead_grade(through, 20.0)
    assert flat.where("grade <> 0").count() == 0


def test_path_of_one_point_and_none(spark):
    one = track(spark, [(3, 4)])
    assert [(r.x, r.y) for r in G.resample(one, 1.0).collect()] == [(3.0, 4.0), (3.0, 4.0)]
    none = one.where("seq > 5")
    assert G.resample(none, 1.0).count() == O.curvatures(none).count() == R.pyramid(none.selectExpr("seq as cx", "seq as cy", "x as value"), 2).count() == 0
    assert A.distribution(none, [], "x").first().n == 0


def test_ks_of_equal_and_empty_sides(spark):
    df = spark.createDataFrame([(1, v, s) for v in (1.0, 2.0, 3.0, float("nan")) for s in (True, False)], "k long, v double, a boolean")
    assert A.ks_statistic(df, "v", "a", ["k"]).first().d == 0.0
    assert A.ks_statistic(df.where("a"), "v", "a", ["k"]).first().d == 1.0
    p = A.ks_statistic(df, "v", "a").select(A.ks_p_value("d", "n_a", "n_b").alias("p")).first().p
    assert p == 1.0


def test_gcj_outside_is_untouched(spark):
    row = spark.range(1).select(S.gcj02_to_wgs84(F.lit(2.35), F.lit(48.85)).alias("p")).first().p
    assert (row.lon, row.lat) == (2.35, 48.85)


def test_classes_of_ways(spark):
    tags = [{"highway": "footway", "surface": "gravel"}, {"highway": "primary", "tunnel": "yes"}, {"leisure": "track", "sport": "soccer; running", "surface": "tartan"}, {"leisure": "pitch", "surface": "tartan"}, {"highway": "path", "layer": "-1"}, {"highway": "raceway"}, {}]
    got = [r.c.surface if r.c else None for r in spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t map<string,string>").select("i", S.classify_way(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["gravel", None, "track", "ground", None, None, None]


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"time_s": 1.0}\r\n\nnot json\n{"time_s": 2.0}\n')
    got = readers.tolerant_ndjson(spark, str(tmp_path / "a.ndjson"), "time_s double").collect()
    assert sorted((r.time_s or 0) for r in got) == [0, 1.0, 2.0] and [r._raw for r in got if r._raw] == ["not json"]


def test_sensor_rows_reject_unknown_channels(spark, tmp_path):
    (tmp_path / "s.ndjson").write_text('{"time_s":1,"channel":"gnss","valid":true}\n{"time_s":2,"channel":"sonar"}\n')
    with pytest.raises(Exception, match="unknown channel sonar"):
        readers.sensors(spark, str(tmp_path / "s.ndjson")).collect()


def test_truth_and_recordings(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text(json.dumps({"time_s": 0.5, "position": {"x": 1, "y": 2}, "standing": True, "velocity": [1, 2, 3]}) + "\n")
    assert readers.truth(spark, str(tmp_path / "t.ndjson")).first().position.y == 2
    (tmp_path / "jog.csv").write_text("subject,ax,ay,az\n" + "".join(f"1,{i},0,9.8\n" for i in range(40)) + "2,1,1,1\nx,y\n")
    (tmp_path / "jog.meta").write_text("# about\nrate_hz = 10\nchannel = accel\nactivity = Jogging\n")
    got = readers.recordings(spark, str(tmp_path / "jog.csv"), str(tmp_path / "jog.meta"))
    assert got.count() == 40 and got.agg(F.max("idx")).first()[0] == 39


def test_other_recordings(spark, tmp_path):
    (tmp_path / "w.txt").write_text("33,Jogging,491,1.5,2.5,3.5;\n33,Walking,1,1,1,1;\nbad\n33,JOGGING,2,,1,1;\n")
    assert [r.ax for r in readers.accelerometer_text(spark, str(tmp_path / "w.txt"), "jogging").collect()] == [1.5]
    (tmp_path / "sub_7.csv").write_text("," + ",".join(f"{a}.{c}" for a in ("gravity", "userAcceleration") for c in "xyz") + "\n0,1,2,3,0.5,0.5,0.5\n")
    row = readers.motion_csv(spark, str(tmp_path / "sub_7.csv")).first()
    assert (row.subject, row.ax, row.az) == (7, 1.5, 3.5)
    folder = tmp_path / "a09" / "p3"
    folder.mkdir(parents=True)
    (folder / "s01.txt").write_text("1,2,3,4,5,6,7,8,9\n1,2\n")
    row = readers.numeric_matrix(spark, str(folder / "s01.txt")).first()
    assert (row.activity, row.subject, row.ay) == (9, 3, 2.0)
    for axis, shift in (("ax", 0), ("ay", 10)):
        (tmp_path / axis).write_text(f" {shift + 1} {shift + 2} {shift + 3} {shift + 4}\n {shift + 3} {shift + 4} {shift + 5} {shift + 6}\n")
    got = readers.windowed_axes(spark, {a: str(tmp_path / a) for a in ("ax", "ay")}).orderBy("idx").collect()
    assert [(r.idx, r.ax, r.ay) for r in got] == [(0, 1.0, 11.0), (1, 2.0, 12.0), (2, 3.0, 13.0), (3, 4.0, 14.0)]


def test_osm_and_targets(spark, tmp_path):
    good = {"type": "way", "id": 1, "tags": {"highway": "path"}, "geometry": [{"lat": 1.0, "lon": 2.0}]}
    (tmp_path / "o.json").write_text(json.dumps({"elements": [good, {"type": "way", "id": 2, "geometry": [None]}]}))
    assert [r.id for r in readers.osm_elements(spark, str(tmp_path / "o.json")).collect()] == [1]
    (tmp_path / "e.json").write_text(json.dumps({"elements": []}))
    with pytest.raises(ValueError):
        readers.osm_elements(spark, str(tmp_path / "e.json"))
    (tmp_path / "targets").write_text("# x\ncadence_hz = 2.5\nratio = 0.2\n")
    assert {r.name: r.tolerance for r in readers.targets(spark, str(tmp_path / "targets")).collect()} == {"cadence_hz": 0.10, "ratio": 0.03}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.5, 0.5, True)], "time_s double, x double, z double, terrain_z double, standing boolean")
    writers.write_stream_table(df, "truth", str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "truth")).first()
    assert (back.time_s, back.z, back.bounce_z, back.standing) == ("1.000", "3.5000", "3.00000", "1")
    cells = spark.createDataFrame([(0, 0, 1.5), (1, 1, 2.5)], "cx long, cy long, value double")
    grid = struct.unpack("<4f", base64.b64decode(writers.chunk_payloads(cells, 2).first().payload))
    assert grid[0] == 1.5 and grid[3] == 2.5 and math.isnan(grid[1])
    rec = spark.createDataFrame([(1, 0.1, 0.2, 0.3)], "subject int, ax double, ay double, az double")
    assert writers.recording_table(rec, "jog", "gyro", "accel", str(tmp_path)).first().name == "jog_gyro"
    line = json.loads(writers.geojson_lines(track(spark, [(0, 0), (1, 2)]), "path_id", "seq", "x", "y", False).first().feature)
    assert line["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 2.0]] and line["properties"]["coordinates"] == "local_metres"


def test_patch_guards(spark):
    base = spark.createDataFrame([(1, 1, 2.0)], "layer long, chunk long, v double")
    with pytest.raises(ValueError):
        L.patched(base, base, ["layer", "chunk"], "a", "b", [])
    with pytest.raises(ValueError):
        L.patched(base, base, ["layer", "chunk"], "a", "a", [1])
