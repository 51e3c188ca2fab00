"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators import joins as J
from trackloom.operators import predicates as P
from trackloom.operators import windows as O
from trackloom.operators.ranking import merged_regions
from trackloom.plans.registry import q4, q6, query, r4, r6

_SIDES = ", t AS (SELECT run_id, time_s, event_id AS truth_id, speed AS truth_speed FROM samples WHERE NOT standing AND event_id % 2 = 0), q AS (SELECT run_id, time_s, event_id, speed FROM samples WHERE event_id % 3 = 0)"


def _sides(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    truth = samples.where("not standing and event_id % 2 = 0").select("run_id", "time_s", F.col("event_id").alias("truth_id"), F.col("speed").alias("truth_speed"))
    return samples.where("event_id % 3 = 0").select("run_id", "time_s", "event_id", "speed"), truth


_FORWARD = _SIDES + """
, f AS (SELECT q.event_id, min((t.time_s, t.truth_id)) AS m FROM q JOIN t ON t.run_id = q.run_id AND t.time_s >= q.time_s GROUP BY q.event_id),
z AS (SELECT run_id, max((time_s, truth_id)) AS m FROM t GROUP BY run_id),
j AS (SELECT q.*, coalesce(f.m, z.m)[2] AS truth_id FROM q LEFT JOIN f USING (event_id) LEFT JOIN z USING (run_id))"""


@query("samples", _FORWARD + " SELECT event_id, truth_id FROM j")
def jon_01_as_of_forward(samples: DataFrame) -> DataFrame:
    return J.as_of_forward(*_sides(samples), "run_id", "time_s").select("event_id", F.col("_t.truth_id").alias("truth_id"))


@query("samples", _SIDES + ", n AS (SELECT run_id, count(*) AS n FROM t GROUP BY run_id), e AS (SELECT q.event_id, count(t.truth_id) AS before FROM q LEFT JOIN t ON t.run_id = q.run_id AND t.time_s < q.time_s GROUP BY q.event_id) SELECT q.event_id, least(before, coalesce(n, 0) - 1) AS at FROM q JOIN e USING (event_id) LEFT JOIN n USING (run_id)")
def jon_03_first_index(samples: DataFrame) -> DataFrame:
    return J.first_index_at(*_sides(samples), "run_id", "time_s").select("event_id", F.col("_at").alias("at"))


@query("samples", _FORWARD + f", e AS (SELECT j.run_id, j.speed - t.truth_speed AS err FROM j JOIN t USING (truth_id) WHERE t.truth_speed >= 0.5) SELECT run_id, count(*) AS n, {q6('avg(err)')} AS mean, {q6('sqrt(avg(err * err))')} AS rms FROM e GROUP BY run_id")
def jon_04_fix_errors(samples: DataFrame) -> DataFrame:
    met = J.as_of_forward(*_sides(samples), "run_id", "time_s").where("_t.truth_speed >= 0.5").withColumn("err", F.col("speed") - F.col("_t.truth_speed"))
    return met.groupBy("run_id").agg(F.count("*").alias("n"), r6(F.avg("err")).alias("mean"), r6(F.sqrt(F.avg(F.col("err") * F.col("err")))).alias("rms"))


@query(("track", "polys"), "SELECT path_id, seq, region_id FROM track JOIN polys ON x >= x0 AND x < x0 + side AND y >= y0 AND y < y0 + side AND (triangle = 0 OR x < (x0 - (x0 + side)) * (y - y0) / (y0 + side - y0) + (x0 + side))")
def jon_05_points_in_regions(track: DataFrame, polys: DataFrame) -> DataFrame:
    return J.points_in_regions(track.select(*_POINT, "x", "y"), polys.select("region_id", P.poly_ring().alias("ring")), size=10.0).select("path_id", "seq", "region_id")


@query(("track", "cells"), f", p AS (SELECT path_id, seq, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy FROM track) SELECT path_id, seq, c.value IS NOT NULL AS loaded, {q6('c.value')} AS value, coalesce(c.blocked, true) AS blocked FROM p LEFT JOIN cells c USING (cx, cy)")
def jon_06_cell_report(track: DataFrame, cells: DataFrame) -> DataFrame:
    """Also PRJ-11, JON-28: outside the raster counts as blocked and as not loaded."""
    at = track.select("path_id", "seq", F.floor("x").alias("cx"), F.floor("y").alias("cy"))
    met = at.join(cells.withColumn("cx", F.col("cx").cast("long")), ["cx", "cy"], "left")
    return met.select("path_id", "seq", F.col("value").isNotNull().alias("loaded"), r6("value").alias("value"), F.coalesce("blocked", F.lit(True)).alias("blocked"))


_POINT = ["path_id", "seq"]
_AROUND = ", p AS (SELECT path_id, seq, x, y, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j FROM track), near AS (SELECT p.*, cells.* FROM p CROSS JOIN (SELECT unnest(range(-3, 4)) AS dx) CROSS JOIN (SELECT unnest(range(-3, 4)) AS dy) JOIN cells ON cx = i + dx AND cy = j + dy)"


@query(("track", "cells"), _AROUND + f", d AS (SELECT path_id, seq, min(sqrt(pow(cx + 0.5 - x, 2) + pow(cy + 0.5 - y, 2))) AS d FROM near WHERE blocked GROUP BY path_id, seq) SELECT path_id, seq, {q6('least(coalesce(d, 3.0), 3.0)')} AS clearance FROM p LEFT JOIN d USING (path_id, seq)")
def jon_08_clearance(track: DataFrame, cells: DataFrame) -> DataFrame:
    return J.distance_to_blocked(track, cells, _POINT, 1.0, 3.0).select(*_POINT, r6("clearance").alias("clearance"))


@query(("track", "cells"), _AROUND + f", d AS (SELECT path_id, seq, min((sqrt(pow(cx + 0.5 - x, 2) + pow(cy + 0.5 - y, 2)), cy, CAST(cx AS BIGINT))) AS m FROM near WHERE NOT blocked GROUP BY path_id, seq) SELECT path_id, seq, {q6('m[1]')} AS distance, m[2] AS cy, m[3] AS cx FROM d")
def jon_09_nearest_free(track: DataFrame, cells: DataFrame) -> DataFrame:
    return J.nearest_free(track, cells, _POINT, 1.0, 3.0).select(*_POINT, r6("distance").alias("distance"), "cy", "cx")


def _buckets(width: float) -> str:
    """Points in square buckets, and in each of the nine around their own."""
    i, j = (f"CAST(floor({c} / {width}) AS BIGINT)" for c in "xy")
    return f", own AS (SELECT path_id, seq, x, y, {i} AS i, {j} AS j FROM track), around AS (SELECT path_id, seq, x, y, {i} + dx AS i, {j} + dy AS j FROM track CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy))"


@query("track", _buckets(4.0) + f", m AS (SELECT a.path_id, a.seq, min((sqrt(pow(a.x - n.x, 2) + pow(a.y - n.y, 2)), n.path_id, n.seq)) AS m FROM around a JOIN own n USING (i, j) WHERE a.seq % 7 <> 0 AND n.seq % 7 = 0 AND sqrt(pow(a.x - n.x, 2) + pow(a.y - n.y, 2)) <= 4 GROUP BY a.path_id, a.seq) SELECT path_id, seq, {q6('m[1]')} AS distance, m[2] AS node_path, m[3] AS node_seq FROM m")
def jon_10_nearest_node(track: DataFrame) -> DataFrame:
    """Every seventh point is a node, all others ask."""
    nodes = track.where("seq % 7 = 0").select(F.struct(*_POINT).alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    met = J.nearest_node(track.where("seq % 7 <> 0"), nodes, _POINT, 4.0)
    return met.select(*_POINT, r6("distance").alias("distance"), F.col("node.path_id").alias("node_path"), F.col("node.seq").alias("node_seq"))


_PAIRS = _buckets(1.5) + ", e AS (SELECT a.path_id AS a_path_id, a.seq AS a_seq, b.path_id AS b_path_id, b.seq AS b_seq, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM around a JOIN own b USING (i, j) WHERE (a.path_id, a.seq) < (b.path_id, b.seq) AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.5)"


@query("track", _PAIRS + f" SELECT a_path_id, a_seq, b_path_id, b_seq, {q6('d')} AS distance FROM e")
def jon_11_radius_pairs(track: DataFrame) -> DataFrame:
    pairs = J.pairs_within(track.select(F.struct(*_POINT).alias("k"), "x", "y"), "k", 1.5, told=r6)
    return pairs.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in _POINT], "distance")


@query("track", _PAIRS + f" SELECT count(*) AS edges, {q6('avg(d)')} AS mean_length FROM e")
def agg_34_edges(track: DataFrame) -> DataFrame:
    return J.pair_totals(track, 1.5).select("edges", r6("mean_length").alias("mean_length"))


@query("polys", "SELECT a.region_id AS a, b.region_id AS b FROM polys a JOIN polys b ON a.region_id < b.region_id AND a.x0 <= b.x0 + b.side + 1e-6 AND b.x0 <= a.x0 + a.side + 1e-6 AND a.y0 <= b.y0 + b.side + 1e-6 AND b.y0 <= a.y0 + a.side + 1e-6")
def jon_12_touching_boxes(polys: DataFrame) -> DataFrame:
    boxes = polys.select("region_id", F.col("x0").alias("x_lo"), F.col("y0").alias("y_lo"), (F.col("x0") + F.col("side")).alias("x_hi"), (F.col("y0") + F.col("side")).alias("y_hi"))
    return J.touching_boxes(boxes, "region_id", 25.0)


_ARC = """
, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
v AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS arc FROM st),
g AS (SELECT *, lead(arc) OVER w AS narc, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY path_id ORDER BY arc, seq))"""


@query("track", _ARC + f"""
, q AS (SELECT path_id, k, k * 37.5 AS s FROM (SELECT DISTINCT path_id FROM track), (SELECT unnest(range(0, 10)) AS k)),
h AS (SELECT q.*, arg_max(g.seq, (g.arc, g.seq)) AS seq FROM q JOIN g ON g.path_id = q.path_id AND g.arc <= q.s GROUP BY ALL)
SELECT h.path_id, h.k, {q6('CASE WHEN narc IS NULL THEN x ELSE x + CASE WHEN narc > arc THEN least(greatest((s - arc) / (narc - arc), 0), 1) ELSE 0 END * (nx - x) END')} AS x FROM h JOIN g USING (path_id, seq)""")
def jon_13_position_at_arc(track: DataFrame) -> DataFrame:
    targets = track.select("path_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).withColumn("s", F.col("k") * 37.5)
    return J.at_arc(O.arc_lengths(track), targets).select("path_id", "k", r6("x").alias("x"))


@query("track", _ARC + f", m AS (SELECT q.path_id, q.k, min((round(sqrt(pow(v.x - q.k * 10, 2) + pow(v.y - q.k * 10, 2)), 9), v.seq, v.arc)) AS m FROM v JOIN (SELECT DISTINCT path_id, unnest(range(0, 10)) AS k FROM track) q USING (path_id) GROUP BY q.path_id, q.k) SELECT path_id, k, {q6('m[1]')} AS distance, {q4('m[3]')} AS arc FROM m")
def jon_14_project_to_path(track: DataFrame) -> DataFrame:
    points = track.select("path_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).withColumns({"x": F.col("k") * 10.0, "y": F.col("k") * 10.0})
    return J.projected(points, O.arc_lengths(track), ["path_id", "k"]).select("path_id", "k", r6("distance").alias("distance"), r4("arc").alias("arc"))


@query("candidates", ", r AS (SELECT od, idx, CAST(floor(length_m / 50) AS BIGINT) AS k, CAST(round(cost_equiv_m * 100000) AS BIGINT) AS c FROM candidates), l AS (SELECT od AS lib, k, min(c) AS c FROM r WHERE od % 2 <> 0 GROUP BY lib, k), b AS (SELECT *, c // 50000 AS i FROM l), q AS (SELECT od, idx, k, c, c // 50000 + d AS i FROM r CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) WHERE od % 2 = 0) SELECT q.od, q.idx, count(*) AS hits FROM q JOIN b USING (k, i) WHERE abs(q.c - b.c) <= 50000 GROUP BY ALL")
def jon_15_library_lookup(candidates: DataFrame) -> DataFrame:
    """Even groups ask, odd ones are the library; costs in hundred-thousandths, so that the tolerance is exact."""
    rows = candidates.select("od", "idx", F.floor(F.col("length_m") / 50).alias("k"), F.round(F.col("cost_equiv_m") * 100_000).cast("long").alias("c"))
    library = rows.where("od % 2 <> 0").groupBy("od", "k").agg(F.min("c").alias("c"))
    return J.counted_within(rows.where("od % 2 = 0"), library, ["od", "idx"], "k", "c", 50_000)


@query("polys", ", o AS (SELECT * FROM polys WHERE region_id % 7 = 0) SELECT region_id FROM polys p WHERE region_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM o WHERE p.x0 + 10 BETWEEN o.x0 AND o.x0 + o.side AND p.y0 + 10 BETWEEN o.y0 AND o.y0 + o.side) UNION ALL SELECT region_id FROM o")
def jon_16_overlay(polys: DataFrame) -> DataFrame:
    overlay = polys.where("region_id % 7 = 0")
    boxes = overlay.select(F.col("region_id").alias("over"), F.col("x0").alias("x_lo"), F.col("y0").alias("y_lo"), (F.col("x0") + F.col("side")).alias("x_hi"), (F.col("y0") + F.col("side")).alias("y_hi"))
    rest = polys.where("region_id % 7 <> 0").select("region_id", (F.col("x0") + 10).alias("x"), (F.col("y0") + 10).alias("y"))
    covered = J.points_in_boxes(rest, boxes).select("region_id").distinct()
    return rest.join(covered, "region_id", "left_anti").select("region_id").union(overlay.select("region_id"))


@query("signal", f", a AS (SELECT series, idx, value FROM signal WHERE event_type <> 'view'), b AS (SELECT series - 1 AS series, idx, value FROM signal WHERE event_type = 'view') SELECT series, idx, {q6('a.value - b.value')} AS difference FROM a JOIN b USING (series, idx)")
def jon_19_aligned_difference(signal: DataFrame) -> DataFrame:
    b = signal.where("event_type = 'view'").select((F.col("series") - 1).alias("series"), "idx", "value", F.col("event_id").alias("order"))
    return J.aligned_difference(signal.where("event_type <> 'view'"), b, ["series", "idx"], "value").select("series", "idx", r6("difference").alias("difference"))


@query("samples", f", m AS (SELECT run_id, avg(speed) AS v, count(*) AS n FROM samples GROUP BY run_id) SELECT a.run_id AS a, b.run_id AS b, {q6('b.v - a.v')} AS speed_delta, b.n - a.n AS rows_delta FROM m a JOIN m b ON b.run_id = a.run_id + 1")
def jon_20_compare_runs(samples: DataFrame) -> DataFrame:
    m = samples.groupBy("run_id").agg(F.avg("speed").alias("v"), F.count("*").alias("n"))
    b = m.select((F.col("run_id") - 1).alias("a"), F.col("run_id").alias("b"), F.col("v").alias("bv"), F.col("n").alias("bn"))
    return m.join(b, m.run_id == b.a).select("a", "b", r6(F.col("bv") - F.col("v")).alias("speed_delta"), (F.col("bn") - F.col("n")).alias("rows_delta"))


@query("samples", f"""
, o AS (SELECT run_id, 'speed' AS name, avg(speed) AS value FROM samples GROUP BY run_id UNION ALL SELECT run_id, 'stand', avg(speed) FROM samples WHERE standing AND event_id % 5 = 0 GROUP BY run_id),
t AS (SELECT * FROM (VALUES ('speed', 5.0, 0.5), ('stand', 4.0, 2.0)) t(name, target, tolerance)), m AS (SELECT r.run_id, t.*, o.value FROM (SELECT DISTINCT run_id FROM o) r CROSS JOIN t LEFT JOIN o ON o.run_id = r.run_id AND o.name = t.name)
SELECT run_id, {q4('sum(CASE WHEN value IS NULL THEN 1000 ELSE pow((value - target) / tolerance, 2) END)')} AS loss, count(*) - count(value) AS missing FROM m GROUP BY run_id""")
def jon_21_score_targets(samples: DataFrame) -> DataFrame:
    speed = samples.groupBy("run_id").agg(F.avg("speed").alias("value")).select("run_id", F.lit("speed").alias("name"), "value")
    stand = samples.where("standing and event_id % 5 = 0").groupBy("run_id").agg(F.avg("speed").alias("value")).select("run_id", F.lit("stand").alias("name"), "value")
    targets = samples.sparkSession.createDataFrame([("speed", 5.0, 0.5), ("stand", 4.0, 2.0)], "name string, target double, tolerance double")
    return J.scored(speed.union(stand), targets, "run_id").select("run_id", r4("loss").alias("loss"), F.when(F.col("worst") == float("inf"), 1).otherwise(0).cast("long").alias("missing"))


@query("part", f"""
, c AS (SELECT p_partkey AS cand, p_size / 10.0 AS a, p_retailprice / 500 AS b FROM part), t AS (SELECT * FROM (VALUES (0.5, 1.0, 2.0), (1.0, 0.5, 3.0)) t(ka, kb, target))
, l AS (SELECT cand, sum(pow(a * ka + b * kb - target, 2)) AS loss FROM c, t GROUP BY cand) SELECT cand, {q6('loss')} AS loss FROM l ORDER BY loss, cand LIMIT 20""")
def jon_22_parameter_sweep(part: DataFrame) -> DataFrame:
    candidates = part.select(F.col("p_partkey").alias("cand"), (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 500).alias("b"))
    targets = part.sparkSession.createDataFrame([(0.5, 1.0, 2.0), (1.0, 0.5, 3.0)], "ka double, kb double, target double")
    error = F.col("a") * F.col("ka") + F.col("b") * F.col("kb") - F.col("target")
    losses = candidates.crossJoin(F.broadcast(targets)).groupBy("cand").agg(F.sum(error * error).alias("loss"))
    return losses.orderBy("loss", "cand").limit(20).select("cand", r6("loss").alias("loss"))


@query("orders", ", n AS (SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderstatus = 'F') SELECT * FROM n UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def jon_24_upsert(orders: DataFrame) -> DataFrame:
    old = orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"))
    return J.upsert(old, new, ["o_orderkey"])


@query("polys", """
, o AS (SELECT region_id % 5 AS "set", row_number() OVER (PARTITION BY region_id % 5 ORDER BY region_id) - 1 AS ref, region_id AS tag, x0 FROM polys),
i AS (SELECT region_id % 5 AS "set", region_id * 10 + k * 3 AS old_ref, region_id + CASE WHEN region_id % 2 = 0 THEN 0 ELSE 1000 END AS tag, k, y0 FROM polys, (SELECT unnest([0, 1]) AS k) WHERE region_id % 3 = 0),
n AS (SELECT i.*, coalesce(h.last + 1, 0) + row_number() OVER (PARTITION BY i."set" ORDER BY old_ref) - 1 AS ref FROM i LEFT JOIN (SELECT "set", max(ref) AS last FROM o GROUP BY 1) h ON h."set" = i."set")
SELECT "set", tag, ref AS geom_ref, x0 AS corner FROM o WHERE ("set", tag) NOT IN (SELECT "set", tag FROM n) UNION ALL SELECT "set", tag, ref, y0 FROM n WHERE k = 1""")
def jon_24_merged_regions(polys: DataFrame) -> DataFrame:
    """Every third region comes anew with two outlines and names the second; half of them under tags of their own. Each feature with the corner of the outline that it names."""
    of_set = (F.col("region_id") % 5).alias("set")
    place = F.row_number().over(W.partitionBy(F.col("region_id") % 5).orderBy("region_id")).cast("long") - 1
    held = polys.select(of_set, place.alias("ref"), F.col("region_id").alias("tag"), F.col("x0").alias("corner"))
    fresh = polys.where("region_id % 3 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    fresh = fresh.select(of_set, (F.col("region_id") * 10 + F.col("k") * 3).alias("ref"), F.when(F.col("region_id") % 2 == 0, F.col("region_id")).otherwise(F.col("region_id") + 1000).alias("tag"), "k", F.col("y0").alias("corner"))
    features, outlines = merged_regions(held.select("set", "tag", F.col("ref").alias("geom_ref")), held.select("set", "ref", "corner"), fresh.where("k = 1").select("set", "tag", F.col("ref").alias("geom_ref")), fresh.select("set", "ref", "corner"))
    return features.join(outlines.withColumnRenamed("ref", "geom_ref"), ["set", "geom_ref"]).select("set", "tag", "geom_ref", "corner")


@query("samples", _SIDES + f"""
, p AS (SELECT q.event_id, min((abs(t.time_s - q.time_s), -t.time_s, -t.truth_id)) AS m FROM q JOIN t USING (run_id) GROUP BY q.event_id)
SELECT event_id, {q6('m[1]')} AS gap FROM p WHERE m[1] <= 50000""")
def jon_29_as_of_nearest(samples: DataFrame) -> DataFrame:
    met = J.as_of_nearest(*_sides(samples), "run_id", "time_s", 50_000.0)
    return met.select("event_id", r6(F.abs(F.col("_t.time_s") - F.col("time_s"))).alias("gap"))


@query("samples", _SIDES + f", p AS (SELECT q.event_id, min(abs(t.time_s - q.time_s)) AS m FROM q JOIN t USING (run_id) GROUP BY q.event_id) SELECT event_id, {q6('m')} AS gap FROM p")
def jon_30_nearest_without_limit(samples: DataFrame) -> DataFrame:
    met = J.as_of_nearest(*_sides(samples), "run_id", "time_s", None, later_wins=False)
    return met.select("event_id", r6(F.abs(F.col("_t.time_s") - F.col("time_s"))).alias("gap")).where("gap is not null")


def _legs(track: DataFrame) -> DataFrame:
    w = W.partitionBy("path_id").orderBy("seq")
    return track.select("path_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")


_ENTERED = """
, s AS (SELECT path_id, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)), l AS (SELECT * FROM s WHERE x1 IS NOT NULL),
k AS (SELECT path_id, seq, 0.0 AS t FROM l UNION SELECT path_id, seq, 1.0 FROM l
    UNION SELECT path_id, seq, (unnest(range(CAST(floor(least(x0, x1)) AS BIGINT) + 1, CAST(floor(greatest(x0, x1)) AS BIGINT) + 1)) - x0) / (x1 - x0) FROM l
    UNION SELECT path_id, seq, (unnest(range(CAST(floor(least(y0, y1)) AS BIGINT) + 1, CAST(floor(greatest(y0, y1)) AS BIGINT) + 1)) - y0) / (y1 - y0) FROM l),
m AS (SELECT path_id, seq, (t + lead(t) OVER (PARTITION BY path_id, seq ORDER BY t)) / 2 AS t FROM k UNION ALL SELECT path_id, seq, unnest([0.0, 1.0]) FROM l),
e AS (SELECT DISTINCT path_id, seq, CAST(floor(x0 + t * (x1 - x0)) AS BIGINT) AS cx, CAST(floor(y0 + t * (y1 - y0)) AS BIGINT) AS cy FROM m JOIN l USING (path_id, seq) WHERE t IS NOT NULL),
h AS (SELECT DISTINCT path_id, seq FROM e JOIN cells USING (cx, cy) WHERE blocked)"""


@query(("track", "cells"), _ENTERED + " SELECT l.path_id, l.seq, h.seq IS NULL AS clear FROM l LEFT JOIN h USING (path_id, seq)")
def jon_17_line_of_sight(track: DataFrame, cells: DataFrame) -> DataFrame:
    """Segments of the paths that enter no blocked cell."""
    legs = _legs(track)
    hit = J.blocked_segments(legs, cells.where("blocked"), _POINT)
    return legs.select("path_id", "seq").join(hit.withColumn("hit", F.lit(True)), ["path_id", "seq"], "left").select("path_id", "seq", F.col("hit").isNull().alias("clear"))


@query(("track", "cells"), _ENTERED + " SELECT path_id, seq FROM h")
def jon_32_blocked_segments(track: DataFrame, cells: DataFrame) -> DataFrame:
    """Segments that cross blocked cells."""
    return J.blocked_segments(_legs(track), cells.where("blocked"), _POINT)


@query(("track", "cells"), ", p AS (SELECT path_id, seq, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy FROM track) SELECT path_id, seq, NOT coalesce(c.blocked, true) AS passable FROM p LEFT JOIN cells c USING (cx, cy)")
def prj_11_passable(track: DataFrame, cells: DataFrame) -> DataFrame:
    at = track.select("path_id", "seq", F.floor("x").alias("cx"), F.floor("y").alias("cy")).join(cells, ["cx", "cy"], "left")
    return at.select("path_id", "seq", P.passable("blocked").alias("passable"))


@query(("track", "cells"), f", p AS (SELECT path_id, seq, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy FROM track) SELECT path_id, seq, CASE WHEN c.cx IS NULL THEN 'outside' WHEN c.blocked THEN 'forbidden' ELSE 'value' END AS state, {q6('CASE WHEN NOT c.blocked THEN c.value END')} AS value FROM p LEFT JOIN cells c USING (cx, cy)")
def jon_28_raster_points(track: DataFrame, cells: DataFrame) -> DataFrame:
    return J.raster_at(track, cells, 1.0).select("path_id", "seq", "state", r6("value").alias("value"))
