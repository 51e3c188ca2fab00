"""Rules with a state or an order, against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import aggregates as A
from trackloom.operators import geometry as G
from trackloom.operators import joins as J
from trackloom.operators import links as L
from trackloom.operators import rasters as R
from trackloom.operators import register as REG
from trackloom.operators import signal as Z
from trackloom.operators import windows as O
from trackloom.operators.ranking import global_rank, merged_regions
from trackloom.operators.search import coordinate_search
from trackloom.sources import readers, writers


def test_gaps_reach_to_the_ends_of_runs(spark):
    fixes = spark.createDataFrame([(1, 3), (1, 4), (1, 7), (2, 5)], "run long, epoch long")
    runs = spark.createDataFrame([(1, 1, 9), (2, 5, 5), (3, 2, 4)], "run long, first long, last long")
    got = sorted(tuple(r) for r in O.gaps(fixes, "run", "epoch", runs).collect())
    assert got == [(1, 1, 2), (1, 5, 6), (1, 8, 9), (3, 2, 4)]
    assert sorted(tuple(r) for r in O.gaps(fixes, "run", "epoch").collect()) == [(1, 5, 6)]


def test_axes_of_two_splits_stay_apart(spark, tmp_path):
    for axis, shift in (("x", 0), ("y", 100)):
        for split in ("train", "test"):
            (tmp_path / f"acc_{axis}_{split}.txt").write_text("\n".join(" ".join(str(shift + 4 * w + i + (1000 if split == "test" else 0)) for i in range(4)) for w in range(4)) + "\n")
    got = readers.windowed_axes(spark, {f"a{a}": str(tmp_path / f"acc_{a}_*.txt") for a in "xy"}).collect()
    assert len(got) == 16 and {r.split for r in got} == {"train", "test"}
    assert all(r.ay == r.ax + 100 and (r.ax >= 1000) == (r.split == "test") for r in got)


def test_lines_keep_their_numbers_over_blocks(spark, tmp_path):
    texts = {"a.txt": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b.txt": ["one", "", "three"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        assert spark.read.text(str(tmp_path / "*.txt")).rdd.getNumPartitions() > 5
        got = readers.numbered_lines(spark, str(tmp_path / "*.txt"))
        rows = {(r.file, r.number): r.value for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {(name, i): line for name, lines in texts.items() for i, line in enumerate(lines)}


def test_files_of_given_names(spark, tmp_path):
    rows = [(f"t {k % 3}.csv", 100 - k, f"{100 - k},x") for k in range(60)]
    writers.write_named(spark.createDataFrame(rows, "file string, o int, value string").repartition(5), str(tmp_path / "out"), ["o"], "o,v")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["t 0.csv", "t 1.csv", "t 2.csv"]
    for k in range(3):
        own = sorted(o for name, o, _ in rows if name == f"t {k}.csv")
        assert (tmp_path / "out" / f"t {k}.csv").read_text().splitlines() == ["o,v", *[f"{o},x" for o in own]]
    with pytest.raises(OSError, match="could not be written"):
        writers.write_named(spark.createDataFrame(rows, "file string, o int, value string"), str(tmp_path / "out"), ["o"])


def test_elements_with_infinite_vertices_go(spark, tmp_path):
    ways = [{"type": "way", "id": i, "geometry": [{"lat": v, "lon": 1.0}]} for i, v in enumerate([1.0, math.inf, -math.inf, math.nan, None])]
    (tmp_path / "o.json").write_text(json.dumps({"elements": ways}))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, ways)))
    for name, lines in (("o.json", False), ("lines.json", True)):
        assert [r.id for r in readers.osm_elements(spark, str(tmp_path / name), lines).collect()] == [0]


def enters(a, b, shut, steps=4000):
    t = (np.arange(steps) + 0.5) / steps
    cells = np.floor(np.array(a) + t[:, None] * (np.array(b) - np.array(a))).astype(int)
    return any(tuple(c) in shut for c in cells.tolist())


def plain_without_folds(points, reach, gap, shut):
    """Point after point loses its first fold until it has none, and all that again until nothing goes."""
    points, again = list(points), True

    def fold(i):
        arc = 0.0
        for j in range(i + 1, len(points)):
            arc += math.dist(points[j - 1], points[j])
            direct = math.dist(points[i], points[j])
            if arc <= reach and direct < gap and arc > 2 * direct + 0.5 and not enters(points[i], points[j], shut):
                return j
        return None

    while again:
        again = False
        for i in range(len(points)):
            while i < len(points) and (j := fold(i)) is not None:
                del points[i + 1 : j]
                again = True
    return points


@pytest.mark.parametrize("walled", [False, True])
def test_folds_go_until_none_is_left(spark, walled):
    rnd = random.Random(6)
    rows, paths = [], {}
    for path in range(12):
        at, points = [5.3, 5.7], []
        for _ in range(40):
            at = [at[0] + rnd.uniform(-0.9, 1.0), at[1] + rnd.uniform(-0.9, 0.9)]
            points.append(tuple(at))
        paths[path] = points
        rows += [(path, i, x, y) for i, (x, y) in enumerate(points)]
    shut = {(rnd.randint(0, 12), rnd.randint(0, 12)) for _ in range(50)} if walled else set()
    blocked = spark.createDataFrame(sorted(shut), "cx long, cy long") if walled else None
    track = spark.createDataFrame(rows, "path_id long, seq long, x double, y double")
    got = {}
    for r in G.remove_spikes(track, 12.0, 1.0, blocked=blocked).collect():
        got.setdefault(r.path_id, []).append((r.seq, (r.x, r.y)))
    shorter = 0
    for path, points in paths.items():
        want = plain_without_folds(points, 12.0, 1.0, shut)
        assert [p for _, p in sorted(got[path])] == want
        shorter += len(want) < len(points)
    assert shorter > 3


def wandering(rnd, n):
    """Points of a walk with bends, reversals and short dead ends."""
    at, heading, points = [0.0, 0.0], 0.0, [(0.0, 0.0)]
    while len(points) < n:
        heading += rnd.choice([0.0, 0.1, -0.2, rnd.uniform(-3.2, 3.2)])
        step = rnd.choice([0.0, 0.3, 1.0, 4.0])
        at = [at[0] + step * math.cos(heading), at[1] + step * math.sin(heading)]
        points.append(tuple(at))
        if rnd.random() < 0.1:  # in and out again
            points += [(at[0] + 0.9, at[1]), tuple(at)]
    return points


def plain_turns(points, window, degrees):
    """The rule place by place, with a search for the leg at each."""
    arc = [0.0]
    for a, b in zip(points, points[1:]):
        arc.append(arc[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))
    total = arc[-1]

    def leg(s):
        s = min(max(s, 0.0), total)
        return min(max(k for k in range(len(arc)) if arc[k] <= s), len(points) - 2)

    def heading(s):
        (ax, ay), (bx, by) = points[leg(s)], points[leg(s) + 1]
        return math.atan2(by - ay, bx - ax) if math.hypot(bx - ax, by - ay) > 1e-12 else 0.0

    def place(s):
        k, s = leg(s), min(max(s, 0.0), total)
        t = min(max((s - arc[k]) / max(arc[k + 1] - arc[k], 1e-9), 0.0), 1.0)
        return [a + (b - a) * t for a, b in zip(points[k], points[k + 1])]

    def apart(a, b):
        return (a - b + math.pi) % (2 * math.pi) - math.pi

    found, step = [], max(window / 8, 0.25)
    if total <= 2 * window:
        return found
    begin, k = step, 0
    while (s := begin + step * k) < total - window:
        k += 1
        corner = apart(heading(s + window), heading(s - window))
        if abs(corner) >= math.radians(degrees):
            low, high, best = max(0.0, s - window), min(total, s + window), (-1.0, s)
            n = 0
            while low + 0.1 * n <= high + 1e-9:
                change = abs(apart(heading(low + 0.1 * n + 0.1), heading(low + 0.1 * n - 0.1)))
                if change > best[0]:
                    best = (change, low + 0.1 * n)
                n += 1
            found.append((best[1], corner, "corner"))
            begin, k = best[1] + 4 * window, 0
            continue
        for r in range(1, 7):
            if s + r / 2 <= total and math.dist(place(s), place(s + r / 2)) < 0.5 and abs(apart(heading(s + r / 2), heading(s))) > math.pi / 2:
                found.append((s + r / 4, apart(heading(s + r / 2), heading(s)), "fold"))
                begin, k = s + r / 4 + window, 0
                break
    return found


def plain_shortcuts(points, tolerance, span, cosine, shut):
    if len(points) < 3:
        return list(range(len(points)))
    arc = [0.0]
    for a, b in zip(points, points[1:]):
        arc.append(arc[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))

    def unit(a, b):
        size = math.hypot(b[0] - a[0], b[1] - a[1])
        return ((b[0] - a[0]) / size, (b[1] - a[1]) / size) if size else (0.0, 0.0)

    kept, i = [0], 0
    while i < len(points) - 1:
        furthest = i + 1
        for j in range(i + 1, min(len(points), i + 66)):
            if tuple(math.floor(c) for c in points[j]) in shut or arc[j] - arc[i] > span:
                break
            if arc[j] == arc[i]:
                continue
            cx, cy = points[j][0] - points[i][0], points[j][1] - points[i][1]
            size = math.hypot(cx, cy)
            away = [abs((x - points[i][0]) * cy - (y - points[i][1]) * cx) / size if size > 1e-9 else math.hypot(x - points[i][0], y - points[i][1]) for x, y in points[i + 1 : j]]
            if max(away, default=0.0) > tolerance:
                break
            u = unit(points[i - 1], points[i]) if i else (0.0, 0.0)
            v = unit(points[j], points[j + 1]) if j + 1 < len(points) else (0.0, 0.0)
            if (u == (0.0, 0.0) or v == (0.0, 0.0) or u[0] * v[0] + u[1] * v[1] >= cosine) and not (shut and enters(points[i], points[j], shut)):
                furthest = j
        kept.append(furthest)
        i = furthest
    return kept


def test_turns_by_the_rule(spark):
    rnd = random.Random(12)
    paths = {k: wandering(rnd, rnd.choice([1, 2, 5, 60, 120])) for k in range(25)}
    bend = [(5 * math.cos(t / 20), 5 * math.sin(t / 20)) for t in range(64)]
    paths |= {90: [(0.0, 0.0), *[(x + 30.0, y) for x, y in bend]]}
    track = spark.createDataFrame([(k, i, x, y) for k, points in paths.items() for i, (x, y) in enumerate(points)], "path_id long, seq long, x double, y double")
    got = {}
    for r in G.turns(track, 6.0, 60.0).collect():
        got.setdefault(r.path_id, []).append((r.arc, r.turn, r.kind))
    kinds = set()
    for k, points in paths.items():
        want, own = plain_turns(points, 6.0, 60.0), sorted(got.get(k, []))
        assert [w[2] for w in want] == [o[2] for o in own] and all(a[0] == pytest.approx(b[0], abs=1e-6) and a[1] == pytest.approx(b[1], abs=1e-6) for a, b in zip(own, want))
        kinds |= {w[2] for w in want}
    assert kinds == {"corner", "fold"} and len(got[90]) == 1


@pytest.mark.parametrize("walled", [False, True])
def test_shortcuts_by_the_rule(spark, walled):
    rnd = random.Random(13)
    paths = {k: [(x + 0.137, y + 0.291) for x, y in wandering(rnd, rnd.choice([1, 2, 3, 50, 150]))] for k in range(20)}
    shut = {(rnd.randint(-40, 40), rnd.randint(-40, 40)) for _ in range(900)} if walled else set()
    track = spark.createDataFrame([(k, i, x, y) for k, points in paths.items() for i, (x, y) in enumerate(points)], "path_id long, seq long, x double, y double")
    blocked = spark.createDataFrame(sorted(shut), "cx long, cy long") if walled else None
    got = {}
    for r in G.simplify(track, 1.5, 12.0, 0.7, blocked=blocked).collect():
        got.setdefault(r.path_id, []).append(r.seq)
    for k, points in paths.items():
        assert sorted(got[k]) == plain_shortcuts(points, 1.5, 12.0, 0.7, shut)
    assert sum(map(len, got.values())) < 0.9 * sum(map(len, paths.values()))


def test_blocks_with_directed_cells_divide(spark):
    cells = spark.createDataFrame([(x, y, 1.0, (x, y) == (5, 6)) for x in range(8) for y in range(8)], "cx long, cy long, value double, directed boolean")
    assert [(r.depth, r.nx, r.ny) for r in R.quadtree(cells, 3, 0.1).collect()] == [(13, 0, 0)]
    got = sorted((r.depth, r.nx, r.ny) for r in R.quadtree(cells, 3, 0.1, "directed").collect())
    assert got == [(14, 0, 0), (14, 0, 1), (14, 1, 0), (15, 2, 2), (15, 3, 2), (15, 3, 3), (16, 4, 6), (16, 4, 7), (16, 5, 6), (16, 5, 7)]


def test_links_near_points_by_trying_all(spark):
    rnd = random.Random(3)
    points = [(k, rnd.uniform(-80, 80), rnd.uniform(-80, 80)) for k in range(300)]
    links = [(k, *(rnd.uniform(-90, 90) for _ in range(4))) for k in range(20)] + [(20, 1.0, 1.0, 1.0, 1.0)]

    def away(x, y, ax, ay, bx, by):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    got = L.near_links(spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(links, "link long, ax double, ay double, bx double, by double"), 4.0)
    assert sorted((r.k, r.link) for r in got.collect()) == sorted((k, n) for k, x, y in points for n, *ends in links if away(x, y, *ends) <= 4.0)


def test_regions_hold_points_by_their_corners(spark):
    rings = [(1, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]), (2, [(2.0, 2.0), (3.0, 2.0)]), (3, [(-60.0, -60.0), (60.0, -60.0), (60.0, 60.0), (-60.0, 60.0)])]
    regions = spark.createDataFrame(rings, "region long, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, 55.0, -55.0), (4, 70.0, 0.0)], "k long, x double, y double")
    assert sorted((r.k, r.region) for r in J.points_in_regions(points, regions).collect()) == [(1, 1), (1, 3), (2, 3), (3, 3)]
    with pytest.raises(Exception, match="too many buckets"):
        J.points_in_regions(points, regions, most=3).collect()


def told(spark, register, layers, made, sources):
    return {r.derived: r.status for r in REG.verified(register, REG.derived_entries(REG.layer_fingerprints(layers), made, sources)).collect()}


def test_a_register_tells_what_is_stale(spark):
    schema = "layer string, cx long, cy long, value double"
    rows = [(layer, x, y, float(x * y + (layer == "b"))) for layer in "ab" for x in range(9) for y in range(9)]
    layers = spark.createDataFrame(rows, schema)
    sums = REG.chunk_sums(layers, 4)
    made = spark.createDataFrame([("d", "p=1", 1), ("e", "p=1", 1)], "derived string, params string, version int")
    sources = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "b"), ("e", "gone")], "derived string, layer string")
    register = REG.derived_entries(REG.layer_fingerprints(sums), made, sources)
    again = REG.chunk_sums(spark.createDataFrame(rows[::-1], schema).repartition(5), 4)
    assert told(spark, register, again, made, sources) == {"d": "valid", "e": "valid"}
    one, other = spark.createDataFrame([rows[5]], schema), spark.createDataFrame([(*rows[5][:3], 99.0)], schema)
    changed = REG.changed_sums(sums, one, other, 4)
    assert told(spark, register, changed, made, sources) == {"d": "inputs", "e": "valid"}
    assert told(spark, register, REG.changed_sums(changed, other, one, 4), made, sources) == {"d": "valid", "e": "valid"}
    assert sorted(map(tuple, changed.collect())) == sorted(map(tuple, REG.chunk_sums(spark.createDataFrame([*rows[:5], (*rows[5][:3], 99.0), *rows[6:]], schema), 4).collect()))
    assert told(spark, register, sums, made.withColumn("params", F.lit("p=2")), sources) == {"d": "parameters", "e": "parameters"}
    assert told(spark, register, sums, made.withColumn("version", F.lit(2)), sources) == {"d": "version", "e": "version"}
    assert told(spark, register.where("derived = 'd'"), sums, made, sources) == {"d": "valid", "e": "unregistered"}
    assert told(spark, register, REG.changed_sums(sums, layers.where("layer = 'b'"), layers.limit(0), 4), made, sources) == {"d": "inputs", "e": "inputs"}


def plain_search(point, bounds, loss, first, least, most):
    names, at, tried = list(bounds), dict(point), 1
    steps = {n: (h - lo) * first for n, (lo, h) in bounds.items()}
    best = loss(at)
    while tried < most:
        moves = [{**at, n: at[n] + sign * steps[n]} for n in names for sign in (1, -1)]
        moves = [m for m in moves if all(lo <= m[n] <= h for n, (lo, h) in bounds.items())]
        tried += len(moves)
        found = min(((loss(m), k, m) for k, m in enumerate(moves)), key=lambda x: x[:2], default=(math.inf, 0, None))
        if found[0] < best - 2.0**-52:
            best, at = found[0], found[2]
            continue
        if not any(steps[n] > (h - lo) * least for n, (lo, h) in bounds.items()):
            break
        steps = {n: s / 2 if s > (bounds[n][1] - bounds[n][0]) * least else s for n, s in steps.items()}
    return at, best, tried


@pytest.mark.parametrize("most", [400, 23])
def test_search_along_coordinates(spark, most):
    bounds = {"a": (0.0, 4.0), "b": (-3.0, 3.0), "c": (1.0, 2.0)}
    groups = {k: (0.3 * k, 1.0 - 0.7 * k, 1.1 + 0.2 * k) for k in range(5)}
    start = spark.createDataFrame([(k, 2.0, 0.0, 1.5) for k in groups], "k int, a double, b double, c double")
    goals = spark.createDataFrame([(k, *g) for k, g in groups.items()], "k int, ga double, gb double, gc double")

    def score(asked):
        parts = [F.col(n) - F.col(f"g{n}") for n in "abc"]
        return asked.join(goals, "k").select("k", "candidate", (parts[0] * parts[0] + 2 * parts[1] * parts[1] + parts[2] * parts[2] + parts[0] * parts[1]).alias("loss"))

    got = {r.k: r for r in coordinate_search(start, "k", bounds, score, most=most).collect()}
    for k, g in groups.items():
        def loss(p, g=g):
            u, v, w = p["a"] - g[0], p["b"] - g[1], p["c"] - g[2]
            return u * u + 2 * v * v + w * w + u * v

        at, best, tried = plain_search({"a": 2.0, "b": 0.0, "c": 1.5}, bounds, loss, 0.15, 0.01, most)
        assert got[k].evaluations == tried and got[k].loss == pytest.approx(best, abs=1e-12) and all(got[k][n] == pytest.approx(at[n]) for n in bounds)


def test_sweep_fills_holes_at_edges_and_corners(spark):
    rng = random.Random(9)
    for density in (0.0, 0.2, 0.9):
        width, height = 7, 6
        grid = [[float(x + 10 * y) if rng.random() < density else rng.choice([None, math.nan]) for x in range(width)] for y in range(height)]
        got = {(r.cx, r.cy): r.value for r in R.swept(spark.createDataFrame([(x, y, grid[y][x]) for x in range(width) for y in range(height)], "cx long, cy long, value double").repartition(3)).collect()}
        known = [v for row in grid for v in row if v is not None and v == v]
        filled = [[v if v is not None and v == v else None for v in row] for row in grid]
        for y in range(height):
            for x in range(width):
                if filled[y][x] is None:
                    filled[y][x] = filled[y][x - 1] if x else filled[y - 1][x] if y else (known[0] if known else 0.0)
        assert got == {(x, y): filled[y][x] for x in range(width) for y in range(height)}


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_by_ranges(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(2)
        rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(400)]
        df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
        ranked = global_rank(df, [F.desc("v"), F.col("i")])
        assert "SinglePartition" not in ranked._jdf.queryExecution().toString()
        assert [r.i for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == [i for _, v, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
        grouped = global_rank(df, [F.col("v"), F.col("i")], "n", within="g").collect()
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
            assert [(r.n, r.i) for r in sorted((r for r in grouped if r.g == g), key=lambda r: r.n)] == [(k + 1, r[2]) for k, r in enumerate(own)]
        assert global_rank(df.limit(0), [F.col("v")]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_references_follow_their_outlines(spark):
    features = spark.createDataFrame([("m", 1, 0), ("m", 2, 2), ("m", 3, 1)], "set string, tag int, geom_ref long")
    outlines = spark.createDataFrame([("m", 0, "o0"), ("m", 1, "o1"), ("m", 2, "o2")], "set string, ref long, shape string")
    fresh = spark.createDataFrame([("m", 2, 70), ("m", 9, 5), ("n", 1, 4)], "set string, tag int, geom_ref long")
    drawn = spark.createDataFrame([("m", 5, "n5"), ("m", 70, "n70"), ("m", 30, "n30"), ("n", 4, "n4")], "set string, ref long, shape string")
    one, two = merged_regions(features, outlines, fresh, drawn)
    assert sorted(map(tuple, two.collect())) == [("m", 0, "o0"), ("m", 1, "o1"), ("m", 2, "o2"), ("m", 3, "n5"), ("m", 4, "n30"), ("m", 5, "n70"), ("n", 0, "n4")]
    assert sorted(map(tuple, one.collect())) == [("m", 1, 0), ("m", 2, 5), ("m", 3, 1), ("m", 9, 3), ("n", 1, 0)]
    with pytest.raises(Exception, match="no outline 6"):
        merged_regions(features, outlines, fresh.withColumn("geom_ref", F.lit(6).cast("long")), drawn)[0].collect()


@pytest.mark.parametrize("width", [0.5, 7.0, 1e9])
def test_as_of_in_pieces_of_any_width(spark, width):
    rng = random.Random(3)
    truth = [(run, float(t), i) for run in ("a", "b", None) for i, t in enumerate(rng.sample(range(-60, 60), 25))] + [("a", None, 99), ("d", 1.0, 0)]
    asked = [(run, rng.randrange(-140, 140) / 2, i) for run in ("a", "b", "c", None) for i in range(60)] + [("a", None, 60)]
    q = spark.createDataFrame(asked, "run string, t double, i int").repartition(3)
    t = spark.createDataFrame(truth, "run string, t double, k int").repartition(3)
    forward = {(r.run, r.i): r._t and r._t.k for r in J.as_of_forward(q, t, "run", "t", width).collect()}
    index = {(r.run, r.i): r._at for r in J.first_index_at(q, t, "run", "t", width).collect()}
    nearest = {late: {(r.run, r.i): r._t and r._t.k for r in J.as_of_nearest(q, t, "run", "t", None, late, width).collect()} for late in (True, False)}
    near = {(r.run, r.i) for r in J.as_of_nearest(q, t, "run", "t", 1.0, True, width).collect()}
    assert len(forward) == len(index) == len(nearest[True]) == len(asked)
    for run, at, i in asked:
        own = sorted((s, k) for r, s, k in truth if r == run and s is not None)
        if at is None or not own:
            assert forward[run, i] is None and nearest[True][run, i] is None and nearest[False][run, i] is None and (run, i) not in near
            assert index[run, i] == (None if at is None else -1)
            continue
        later = [k for s, k in own if s >= at]
        assert forward[run, i] == (later[0] if later else own[-1][1])
        assert index[run, i] == min(len(own) - len(later), len(own) - 1)
        for late, sign in ((True, -1), (False, 1)):
            assert nearest[late][run, i] == min(own, key=lambda p: (abs(p[0] - at), sign * p[0]))[1]
        assert ((run, i) in near) == (min(abs(s - at) for s, _ in own) <= 1.0)


@pytest.mark.parametrize("unit", [1.0, 1e6])
@pytest.mark.parametrize("width", [None, 3.0])
def test_as_of_ties_do_not_hang_on_the_order_of_rows(spark, unit, width):
    rng = random.Random(11)
    truth = [(run, rng.randrange(8) * unit, k, {"m": k}) for run in "ab" for k in rng.sample(range(100), 40)]
    asked = [("ab"[i % 2], rng.randrange(-4, 20) / 2 * unit, i) for i in range(60)]
    found = []
    for seed in range(3):
        for rows in (truth, asked):
            random.Random(seed).shuffle(rows)
        q = spark.createDataFrame(asked, "run string, t double, i int").repartition(1 + seed)
        t = spark.createDataFrame(truth, "run string, t double, k int, extra map<string,int>").repartition(3)
        step = width and width * unit
        got = [J.as_of_forward(q, t, "run", "t", step), J.as_of_nearest(q, t, "run", "t", None, True, step), J.as_of_nearest(q, t, "run", "t", None, False, step), J.as_of_forward(q, t.withColumn("o", -F.col("k")), "run", "t", step, ["o"])]
        found.append([{r.i: r._t.k for r in df.collect()} for df in got])
    assert found[0] == found[1] == found[2]
    for run, at, i in asked:
        own = sorted((s, k) for r, s, k, _ in truth if r == run)
        later = [p for p in own if p[0] >= at]
        assert found[0][0][i] == (later[0] if later else own[-1])[1]
        assert found[0][1][i] == min(own, key=lambda p: (abs(p[0] - at), -p[0], -p[1]))[1]
        assert found[0][2][i] == min(own, key=lambda p: (abs(p[0] - at), p[0], p[1]))[1]
        assert found[0][3][i] == (max(k for s, k in own if s == later[0][0]) if later else min(k for s, k in own if s == own[-1][0]))
    assert J.piece_width([q, t], "run", "t", rows=40) == pytest.approx(J.piece_width([q, t], "run", "t", rows=20) * 2)


@pytest.mark.parametrize("parts", [1, 2, 7, 32])
def test_quantiles_by_selection(spark, parts):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.randrange(9) / 4, rng.gauss(0, 50)])) for k in ("a", "b", None) for _ in range(rng.randrange(40, 90))]
    rows += [("a", None), ("c", 1.5), ("d", None), ("e", 2.0), ("e", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for keys in (["k"], []):
        want = {tuple(r[c] for c in keys): r for r in A.distribution(df, keys, "v").collect()}
        got = {tuple(r[c] for c in keys): r for r in A.distribution(df, keys, "v", parts).collect()}
        assert want.keys() == got.keys()
        for key, row in want.items():
            assert got[key].n == row.n and all(math.isclose(got[key][c], row[c], abs_tol=1e-9) for c in ("mean", "std", "min", "p05", "p50", "p95", "max"))
    assert A.distribution(df.limit(0), [], "v", parts).first().n == 0 and not A.distribution(df.limit(0), ["k"], "v", parts).count()


def test_large_groups_by_selection_and_small_ones_at_once(spark):
    rng = random.Random(15)
    rows = [(k, rng.choice([rng.randrange(9) / 4, rng.gauss(0, 50)])) for k, n in (("a", 90), ("b", 7), (None, 60), (None, 3)) for _ in range(n)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for keys in (["k"], []):
        want, got = ({tuple(r[c] for c in keys): r for r in A.distribution(df, keys, "v", **how).collect()} for how in ({}, {"parts": 5, "held": 20}))
        assert want.keys() == got.keys()
        assert all(math.isclose(got[key][c], row[c], abs_tol=1e-9) for key, row in want.items() for c in ("n", "mean", "std", "min", "p05", "p50", "p95", "max"))


def test_spectra_of_long_and_short_series(spark):
    rng = np.random.default_rng(4)
    series = {name: rng.normal(size=n) for name, n in (("a", 300), ("b", 2), ("c", 1), ("d", 64), (None, 130), ("e", 65))}
    df = spark.createDataFrame([(name, i, float(v)) for name, values in series.items() for i, v in enumerate(values)], "s string, i long, v double").repartition(5)
    found = {}
    for rows in (1 << 16, 64):
        for r in Z.spectrum(df, "s", "i", "v", 100.0, rows).collect():
            found.setdefault((rows, r.s), {})[r.bin] = (r.frequency_hz, r.magnitude)
    for name, values in series.items():
        n = len(values)
        if n < 2:
            assert (64, name) not in found and (1 << 16, name) not in found
            continue
        size = 1 << (n - 1).bit_length()
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        want = np.abs(np.fft.rfft(values * window, size)) * 2 / window.sum()
        for rows in (1 << 16, 64):
            got = found[rows, name]
            assert sorted(got) == list(range(size // 2 + 1))
            assert np.allclose([got[k][1] for k in sorted(got)], want) and np.allclose([got[k][0] for k in sorted(got)], np.arange(size // 2 + 1) * 100.0 / size)


@pytest.mark.parametrize("seed", [1, 2])
def test_regions_of_many_shapes_by_trying_all(spark, seed):
    rng = random.Random(seed)
    rings = []
    for k in range(30):
        cx, cy, n = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.randrange(3, 9)
        rings.append((k, [(cx + rng.uniform(2, 40) * math.cos(2 * math.pi * i / n), cy + rng.uniform(2, 40) * math.sin(2 * math.pi * i / n)) for i in range(n)]))
    points = [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(400)] + [(900 + k, *rings[k][1][0]) for k in range(30)]

    def holds(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    shapes = spark.createDataFrame(rings, "region long, ring array<struct<x: double, y: double>>")
    for size in (5.0, 30.0):
        got = J.points_in_regions(spark.createDataFrame(points, "k long, x double, y double"), shapes, size=size)
        assert sorted((r.k, r.region) for r in got.collect()) == sorted((i, k) for i, x, y in points for k, ring in rings if holds(ring, x, y))


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_autocorrelation_in_blocks(spark, block):
    rng = random.Random(6)
    series = {"long": [rng.gauss(0, 1) for _ in range(40)], "gaps": [rng.gauss(0, 1) if i % 7 else None for i in range(30)], "short": [1.0, 2.0], "flat": [4.0] * 9}
    rows = [(s, i, x) for s, xs in series.items() for i, x in enumerate(xs) if x is not None]
    got = {(r.series, r.lag): r.acf for r in A.autocorrelation(spark.createDataFrame(rows, "series string, i long, x double").repartition(3), "series", "i", "x", 6, block).collect()}
    for s, xs in series.items():
        known = [x for x in xs if x is not None]
        mean = sum(known) / len(known)
        dense = [None if x is None else x - mean for x in xs]
        sums = [sum(a * b for a, b in zip(dense, dense[k:]) if a is not None and b is not None) for k in range(7)]
        want = {0: 1.0} if s in ("short", "flat") else {k: sums[k] / sums[0] for k in range(7)}
        mine = {k: acf for (name, k), acf in got.items() if name == s}
        assert mine.keys() == want.keys() and all(math.isclose(mine[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("block", [1, 4, 256])
def test_nearest_vertex_by_blocks(spark, block):
    rng = random.Random(8)
    track = [(p, i, rng.randrange(12) / 2, rng.randrange(12) / 2, float(i)) for p in ("a", "b") for i in range(40)] + [("a", 40, None, 1.0, 40.0)]
    asked = [(k, rng.choice("abc"), rng.randrange(-20, 30) / 3, rng.randrange(-20, 30) / 3) for k in range(80)] + [(80, "a", None, 0.0), (81, None, 1.0, 1.0)]
    points = spark.createDataFrame(asked, "seq int, path_id string, x double, y double")
    got = {r.seq: (r.distance, r.arc) for r in J.projected(points, spark.createDataFrame(track, "path_id string, seq int, x double, y double, arc double"), ["seq"], block=block).collect()}
    want = {}
    for k, path, x, y in asked:
        near = [(round(math.hypot(vx - x, vy - y), 9), arc) for p, _, vx, vy, arc in track if p == path and None not in (x, vx)]
        if near:
            want[k] = min(near)
    assert got == want
