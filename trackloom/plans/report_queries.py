"""Queries that put several operators together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates as A
from trackloom.operators import joins as J
from trackloom.operators import links as L
from trackloom.operators import predicates as P
from trackloom.operators import rasters as R
from trackloom.operators import windows as O
from trackloom.operators.report import run_report
from trackloom.plans.geometry_queries import _LINES
from trackloom.plans.registry import q4, q6, query, r4, r6


_RATIO = ", st AS (SELECT path_id AS run_id, seq, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s, sqrt(pow(x - first(x) OVER w, 2) + pow(y - first(y) OVER w, 2)) AS r FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)), pr AS (SELECT run_id, sum(s) AS length_m, arg_max(r, seq) AS away, max(r) AS reach FROM st GROUP BY run_id), ratio AS (SELECT run_id, length_m, CASE WHEN (CASE WHEN away < 1 THEN 2 * reach ELSE away END) > 1e-9 THEN length_m / (CASE WHEN away < 1 THEN 2 * reach ELSE away END) ELSE 1 END AS ratio FROM pr)"
_LAG = ", dn AS (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY time_s, event_id) AS BIGINT) AS i, speed - avg(speed) OVER (PARTITION BY run_id) AS v FROM samples), ac AS (SELECT a.run_id, sum(a.v * b.v) / any_value(z.s) AS acf_1 FROM dn a JOIN dn b ON b.run_id = a.run_id AND b.i = a.i + 1 JOIN (SELECT run_id, sum(v * v) AS s FROM dn GROUP BY run_id) z ON z.run_id = a.run_id GROUP BY a.run_id)"


_REPORT = _LINES + _RATIO + """
, sp AS (SELECT run_id, count(*) AS speed_n, avg(speed) AS speed_mean, stddev_pop(speed) AS speed_std, quantile_cont(speed, 0.05) AS speed_p05, quantile_cont(speed, 0.5) AS speed_p50, quantile_cont(speed, 0.95) AS speed_p95 FROM samples WHERE NOT standing AND NOT turning AND speed >= 0.5 GROUP BY run_id),
tu AS (SELECT run_id, avg(speed * kappa_eff) AS turn_mean, stddev_pop(speed * kappa_eff) AS turn_std, quantile_cont(speed * kappa_eff, 0.95) AS turn_p95, avg(abs(kappa_eff)) AS mean_abs_curvature FROM samples WHERE NOT standing AND NOT turning GROUP BY run_id),
ex AS (SELECT run_id, max(time_s) - min(time_s) AS duration_s, max(speed) AS max_speed FROM samples GROUP BY run_id),
dn AS (SELECT run_id, row_number() OVER w - 1 AS i, time_s, speed, kappa_eff * 10 AS off, count(*) OVER (PARTITION BY run_id) AS n FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY time_s, event_id)),
fr AS (SELECT *, CASE WHEN n <= 5 THEN 0 ELSE least(greatest(i, 2), n - 3) - 2 END AS a, CASE WHEN n <= 5 THEN n ELSE least(greatest(i, 2), n - 3) + 3 END AS b FROM dn),
re AS (SELECT f.run_id, f.i, any_value(f.speed) - avg(d.speed) AS rs, any_value(f.off) - avg(d.off) AS ro FROM fr f JOIN dn d ON d.run_id = f.run_id AND d.i >= f.a AND d.i < f.b GROUP BY f.run_id, f.i),
me AS (SELECT *, rs - avg(rs) OVER (PARTITION BY run_id) AS vs, ro - avg(ro) OVER (PARTITION BY run_id) AS vo FROM re),
va AS (SELECT run_id, count(*) AS n, sum(vs * vs) AS zs, sum(vo * vo) AS zo FROM me GROUP BY run_id),
ac AS (SELECT a.run_id, CASE WHEN any_value(n) >= 3 AND any_value(zs / n) >= 1e-12 THEN sum(a.vs * b.vs) / any_value(zs) END AS speed_acf_1, CASE WHEN any_value(n) >= 3 AND any_value(zo / n) >= 1e-12 THEN sum(a.vo * b.vo) / any_value(zo) END AS position_acf_1 FROM me a JOIN me b ON b.run_id = a.run_id AND b.i = a.i + 1 JOIN va ON va.run_id = a.run_id GROUP BY a.run_id),
dy AS (SELECT DISTINCT run_id, CAST(floor(time_s / 86400) AS BIGINT) AS d FROM samples WHERE NOT standing), ga AS (SELECT run_id, count(*) / CAST(max(d) - min(d) + 1 AS DOUBLE) AS availability FROM dy GROUP BY run_id),
al AS (SELECT dn.run_id, time_s, sum(s) OVER (PARTITION BY dn.run_id ORDER BY i) AS arc FROM dn JOIN st ON st.run_id = dn.run_id AND st.seq = dn.i),
lx AS (SELECT run_id, max(time_s) AS stop, greatest(CAST(floor(max(arc) / 500) AS BIGINT), 1) - 1 AS last FROM al GROUP BY run_id), lp AS (SELECT run_id, least(CAST(floor(arc / 500) AS BIGINT), last) AS lap, min(time_s) AS t0 FROM al JOIN lx USING (run_id) GROUP BY ALL),
lt AS (SELECT lp.run_id, coalesce(lead(t0) OVER (PARTITION BY lp.run_id ORDER BY lap), stop) - t0 AS s FROM lp JOIN lx USING (run_id)), lv AS (SELECT run_id, count(*) AS laps, avg(s) AS lap_mean_s, CASE WHEN count(*) >= 2 THEN CASE WHEN abs(avg(s)) < 1e-9 THEN 0 ELSE stddev_pop(s) / abs(avg(s)) END END AS lap_cv FROM lt GROUP BY run_id),
ts AS (SELECT run_id, time_s, event_id, speed FROM samples WHERE NOT standing AND event_id % 2 = 0), qs AS (SELECT run_id, time_s, event_id, speed FROM samples WHERE event_id % 3 = 0),
fx AS (SELECT q.event_id, min((t.time_s, t.event_id)) AS m FROM qs q JOIN ts t ON t.run_id = q.run_id AND t.time_s >= q.time_s GROUP BY q.event_id), zx AS (SELECT run_id, max((time_s, event_id)) AS m FROM ts GROUP BY run_id),
er AS (SELECT q.run_id, q.speed - t.speed AS e, t.speed AS v FROM qs q LEFT JOIN fx USING (event_id) LEFT JOIN zx ON zx.run_id = q.run_id JOIN ts t ON t.event_id = coalesce(fx.m, zx.m)[2]),
fe AS (SELECT run_id, avg(abs(e)) AS fix_horizontal_mean, quantile_cont(abs(e), 0.95) AS fix_horizontal_p95, avg(e / 2) AS fix_vertical_mean, quantile_cont(e / 2, 0.95) AS fix_vertical_p95, avg(e) FILTER (v >= 0.5) AS fix_speed_mean, quantile_cont(CASE WHEN v >= 0.5 THEN e END, 0.95) AS fix_speed_p95 FROM er GROUP BY run_id),
su AS (SELECT series AS run_id, arg_max(hz, (m, -bin)) FILTER (hz >= 0.2) AS accel_dominant_hz, max(m) FILTER (hz BETWEEN 2 AND 3) AS accel_step, arg_min(m, (abs(hz - 5), bin)) AS accel_second FROM spec GROUP BY series)
"""
_REPORTED = ["speed_mean", "speed_std", "speed_p05", "speed_p50", "speed_p95", "turn_mean", "turn_std", "turn_p95", "mean_abs_curvature", "path_ratio", "length_m", "duration_s", "max_speed", "speed_acf_1", "position_acf_1", "availability", "lap_mean_s", "lap_cv"] + [f"fix_{c}_{m}" for c in ("horizontal", "vertical", "speed") for m in ("mean", "p95")] + ["accel_dominant_hz", "accel_step", "accel_second", "bounce_consistency"]


@query(("samples", "track", "signal"), _REPORT + "SELECT ex.run_id, speed_n, laps, CASE WHEN speed_acf_1 < exp(-1) THEN 1 WHEN speed_acf_1 IS NULL THEN 1 ELSE 2 END AS speed_memory, CASE WHEN position_acf_1 < exp(-1) THEN 1 WHEN position_acf_1 IS NULL THEN 1 ELSE 2 END AS position_memory, "
       + ", ".join(f"{q4({'path_ratio': 'ratio', 'bounce_consistency': f'accel_step / {0.05 * (2 * math.pi * 2.5) ** 2!r}e0'}.get(c, c))} AS {c}" for c in _REPORTED)
       + ", coalesce(ratio BETWEEN 1 AND 3 AND speed_mean > 0.5 AND speed_p95 < 8 AND abs(speed_acf_1) < 0.999, false) AS plausible FROM ex LEFT JOIN sp USING (run_id) LEFT JOIN tu USING (run_id) LEFT JOIN ratio USING (run_id) LEFT JOIN ac USING (run_id) LEFT JOIN ga USING (run_id) LEFT JOIN lv USING (run_id) LEFT JOIN fe USING (run_id) LEFT JOIN su USING (run_id)")
def agg_20_run_report(samples: DataFrame, track: DataFrame, signal: DataFrame) -> DataFrame:
    """The whole report of each run: fixes against truth, laps of 500 m, and the signal as its accelerometer."""
    paths = track.withColumnRenamed("path_id", "run_id")
    dense = samples.withColumn("seq", (F.row_number().over(W.partitionBy("run_id").orderBy("time_s", "event_id")) - 1).cast("long"))
    arcs = O.arc_lengths(paths, "run_id").select("run_id", "seq", F.col("arc").alias("arc_s"))
    timed = dense.select("run_id", "seq", "time_s").join(arcs, ["run_id", "seq"])
    days = moving_days(samples)
    truth = samples.where("not standing and event_id % 2 = 0").select("run_id", "time_s", F.col("event_id").alias("truth_id"), F.col("speed").alias("v"))
    met = J.as_of_forward(samples.where("event_id % 3 = 0").select("run_id", "time_s", "event_id", "speed"), truth, "run_id", "time_s", 86_400.0).where("_t is not null")
    error = F.col("speed") - F.col("_t.v")
    errors = met.select("run_id", F.abs(error).alias("horizontal"), (error / 2).alias("vertical"), F.when(F.col("_t.v") >= 0.5, error).alias("speed"))
    accel = signal.select(F.col("series").alias("run_id"), "idx", "value")
    report = run_report(samples.withColumn("offset_m", F.col("kappa_eff") * 10), paths, "run_id", ["time_s", "event_id"], 1.0, 500.0, 2.5, 0.05, accel=accel, errors=errors, availability=A.availability(days, O.gaps(days, "run_id", "d"), "run_id"), accel_rate=10.0, arcs=timed)
    plausible = P.plausible("path_ratio", "speed_mean", "speed_p95", "speed_acf_1")
    return report.select("run_id", "speed_n", "laps", "speed_memory", "position_memory", *[r4(c).alias(c) for c in _REPORTED], plausible.alias("plausible"))


def moving_days(samples: DataFrame) -> DataFrame:
    return samples.where("not standing").select("run_id", F.floor(F.col("time_s") / 86400).alias("d")).distinct()


@query(("samples", "track"), _RATIO + _LAG + " SELECT run_id, ratio BETWEEN 1 AND 3 AND avg(speed) > 0.5 AND quantile_cont(speed, 0.95) < 8 AND abs(any_value(acf_1)) < 0.999 AS plausible FROM samples JOIN ratio USING (run_id) JOIN ac USING (run_id) WHERE NOT standing AND NOT turning AND speed >= 0.5 GROUP BY run_id, ratio")
def prj_13_plausible(samples: DataFrame, track: DataFrame) -> DataFrame:
    report = A.distribution(samples.where(P.running()), ["run_id"], "speed")
    dense = samples.withColumn("idx", F.row_number().over(W.partitionBy("run_id").orderBy("time_s", "event_id")) - 1)
    acf = A.autocorrelation(dense, "run_id", "idx", "speed", 1).where("lag = 1")
    met = report.join(A.path_ratio(track.withColumnRenamed("path_id", "run_id"), "run_id"), "run_id").join(acf, "run_id")
    return met.select("run_id", P.plausible("ratio", "mean", "p95", "acf").alias("plausible"))


@query(("samples", "track"), _RATIO + f" SELECT run_id, {q4('any_value(max_time) - any_value(min_time)')} AS duration_s, {q6('any_value(top)')} AS max_speed, {q4('any_value(length_m)')} AS length_m FROM (SELECT run_id, max(time_s) AS max_time, min(time_s) AS min_time, max(speed) AS top FROM samples GROUP BY run_id) JOIN ratio USING (run_id) GROUP BY run_id")
def agg_32_run_extent(samples: DataFrame, track: DataFrame) -> DataFrame:
    got = A.run_extent(samples, track, "run_id", "path_id")
    return got.select("run_id", r4("duration_s").alias("duration_s"), r6("max_speed").alias("max_speed"), r4("length_m").alias("length_m"))


@query("cells", f"SELECT cy % 16 AS layer, {q6('avg(CAST(blocked AS INTEGER))')} AS forbidden_ratio FROM cells GROUP BY layer")
def agg_25_forbidden_ratio(cells: DataFrame) -> DataFrame:
    got = R.forbidden_ratio(cells.withColumn("layer", F.col("cy") % 16), ["layer"])
    return got.select("layer", r6("forbidden_ratio").alias("forbidden_ratio"))


@query("samples", "SELECT event_id FROM samples WHERE standing AND run_id % 2 = 0")
def prj_15_gait_filter(samples: DataFrame) -> DataFrame:
    rows = samples.withColumn("channel", F.when(F.col("run_id") % 2 == 0, "wrist").otherwise("pocket")).withColumn("activity", F.when(F.col("standing"), "Stand").otherwise("Jog"))
    return rows.where(P.of_gait("wrist", "STAND")).select("event_id")


@query("cells", """
, b AS (SELECT k, cx >> k AS nx, cy >> k AS ny, avg(value) AS mean, max(value) AS top FROM cells, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL), ok AS (SELECT * FROM b WHERE k = 0 OR top - mean <= 0.12)
SELECT 16 - o.k AS depth, CAST(o.nx AS BIGINT) AS nx, o.ny FROM ok o WHERE k <= 1 AND top <= 0.1 AND NOT EXISTS (SELECT 1 FROM ok u WHERE u.k > o.k AND (o.nx >> (u.k - o.k)) = u.nx AND (o.ny >> (u.k - o.k)) = u.ny)""")
def prj_18_admissible(cells: DataFrame) -> DataFrame:
    nodes = R.quadtree(cells, 3, 0.12)
    return nodes.where((F.col("depth") >= 15) & (F.col("top") <= 0.1)).select("depth", F.col("nx").cast("long").alias("nx"), "ny")


@query("signal", f"""
, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM signal), c AS (SELECT series, idx, event_id, value, n, CASE WHEN n <= 5 THEN 0 ELSE least(greatest(idx, 2), n - 3) - 2 END AS a, CASE WHEN n <= 5 THEN n ELSE least(greatest(idx, 2), n - 3) + 3 END AS b FROM n),
m AS (SELECT c.event_id, any_value(c.series) AS series, any_value(c.n) AS n, any_value(c.value) - avg(s.value) AS r FROM c JOIN signal s ON s.series = c.series AND s.idx >= c.a AND s.idx < c.b GROUP BY c.event_id)
SELECT series, CASE WHEN any_value(n) < 8 THEN 0.0 ELSE {q6('(max(r) - min(r)) / 2')} END AS ripple FROM m GROUP BY series""")
def agg_18_ripple(signal: DataFrame) -> DataFrame:
    rows = O.detrended(signal, "series", "idx", "value", 5)
    return rows.groupBy("series").agg(r6(F.when(F.count("*") < 8, 0.0).otherwise((F.max("residual") - F.min("residual")) / 2)).alias("ripple"))


@query("signal", f"SELECT series, {q4('sum(value) * 0.01')} AS turned, {q4('arg_max(value, idx) - arg_min(value, idx)')} AS change FROM signal GROUP BY series")
def agg_39_heading(signal: DataFrame) -> DataFrame:
    return signal.groupBy("series").agg(r4(F.sum("value") * 0.01).alias("turned"), r4(F.max_by("value", "idx") - F.min_by("value", "idx")).alias("change"))


@query("samples", f"""
, t AS (SELECT run_id, time_s, ln(1 + speed) AS speed FROM samples WHERE event_id % 2 = 0), q AS (SELECT run_id, time_s, event_id, ln(1 + speed) AS speed FROM samples WHERE event_id % 3 = 0),
f AS (SELECT q.event_id, arg_min(t.speed, t.time_s) AS s FROM q JOIN t ON t.run_id = q.run_id AND t.time_s >= q.time_s GROUP BY q.event_id), z AS (SELECT run_id, arg_max(speed, time_s) AS s FROM t GROUP BY run_id),
e AS (SELECT q.run_id, q.speed - coalesce(f.s, z.s) AS e FROM q LEFT JOIN f USING (event_id) LEFT JOIN z USING (run_id))
SELECT run_id, {q4('avg(e)')} AS bias, {q4('sqrt(avg(e * e))')} AS rms FROM e GROUP BY run_id""")
def agg_40_barometer_error(samples: DataFrame) -> DataFrame:
    samples = samples.withColumn("speed", F.log1p("speed"))
    truth = samples.where("event_id % 2 = 0").select("run_id", "time_s", F.col("speed").alias("true"))
    got = L.barometer_error(samples.where("event_id % 3 = 0").select("run_id", "time_s", "speed"), truth, "run_id", "time_s", "speed", "true")
    return got.select("run_id", r4("bias").alias("bias"), r4("rms").alias("rms"))


@query("samples", f"""
, t AS (SELECT run_id, time_s, event_id AS truth_id FROM samples WHERE event_id % 2 = 0), d AS (SELECT run_id, max(time_s) AS last FROM t GROUP BY run_id),
q AS (SELECT s.run_id, s.event_id, least(s.time_s + 1e6, d.last) AS at FROM samples s JOIN d USING (run_id) WHERE s.event_id % 3 = 0)
SELECT q.event_id, min((t.time_s, t.truth_id))[2] AS truth_id FROM q JOIN t ON t.run_id = q.run_id AND t.time_s >= q.at GROUP BY q.event_id""")
def jon_02_as_of_clamped(samples: DataFrame) -> DataFrame:
    truth = samples.where("event_id % 2 = 0").select("run_id", "time_s", F.col("event_id").alias("truth_id"))
    last = truth.groupBy("run_id").agg(F.max("time_s").alias("last"))
    asked = samples.where("event_id % 3 = 0").join(last, "run_id").select("run_id", F.least(F.col("time_s") + 1e6, "last").alias("time_s"), "event_id")
    return J.as_of_forward(asked, truth, "run_id", "time_s").select("event_id", F.col("_t.truth_id").alias("truth_id"))


@query(("track", "cells"), f"""
, p AS (SELECT *, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j FROM track), m AS (SELECT p.*, c.blocked AS b, c.cx IS NOT NULL AS known FROM p LEFT JOIN cells c ON c.cx = i AND c.cy = j),
d AS (SELECT path_id, seq, min(sqrt(pow(cx + 0.5 - x, 2) + pow(cy + 0.5 - y, 2))) AS d FROM p CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) JOIN cells ON cx = i + dx AND cy = j + dy WHERE blocked GROUP BY path_id, seq)
SELECT path_id, seq, CASE WHEN floor(x) > 69 OR floor(y) > 199 THEN 'outside' WHEN NOT known THEN 'unknown' WHEN b THEN 'forbidden' WHEN coalesce(d, 1) < 1 THEN 'too_close' ELSE 'ok' END AS reason FROM m LEFT JOIN d USING (path_id, seq)""")
def jon_07_feasibility(track: DataFrame, cells: DataFrame) -> DataFrame:
    return L.feasibility(track, cells, ["path_id", "seq"], 70, 200, 1.0).select("path_id", "seq", "reason")


@query("geo", "SELECT id, CASE WHEN CAST(floor((lon - floor(lon)) / 0.05) AS BIGINT) % 2 = 0 THEN CAST(floor((lon - floor(lon)) / 0.05) * 10 + floor((lat - floor(lat)) / 0.05) AS DOUBLE) END AS height FROM geo")
def jon_18_mosaic(geo: DataFrame) -> DataFrame:
    pixels = geo.select(S.tile_name("lat", "lon").alias("tile"), F.floor((F.col("lon") - F.floor("lon")) / 0.05).alias("px"), F.floor((F.col("lat") - F.floor("lat")) / 0.05).alias("py")).distinct()
    dem = pixels.where("px % 2 = 0").withColumn("height", (F.col("px") * 10 + F.col("py")).cast("double"))
    return L.mosaic_sample(geo, dem, ["id"], 0.05)


@query("cells", f"SELECT layer, chunk, {q6('CASE WHEN chunk % 5 = 0 THEN total + 1 ELSE total END')} AS total FROM (SELECT cy % 4 AS layer, cx // 16 * 100 + cy // 16 AS chunk, sum(value) AS total FROM cells GROUP BY ALL)")
def jon_25_patch(cells: DataFrame) -> DataFrame:
    chunk = (F.floor(F.col("cx") / 16) * 100 + F.floor(F.col("cy") / 16)).alias("chunk")
    base = cells.groupBy((F.col("cy") % 4).alias("layer"), chunk).agg(F.sum("value").alias("total"))
    patch = base.where("chunk % 5 = 0").withColumn("total", F.col("total") + 1)
    return L.patched(base, patch, ["layer", "chunk"], "a", "a", [9]).select("layer", "chunk", r6("total").alias("total"))


_LINKS = [(1, 10.0, 10.0, 60.0, 40.0), (2, 80.0, 20.0, 20.0, 80.0)]


@query("track")
def jon_26_traversals(track: DataFrame) -> DataFrame:
    return L.traversals(track, _LINKS, 25.0, 45.0)


@query("track", f"SELECT path_id, seq, link FROM track, (VALUES (1, 10.0, 10.0, 60.0, 40.0), (2, 80.0, 20.0, 20.0, 80.0)) l(link, ax, ay, bx, byy) WHERE sqrt(pow(x - (ax + least(greatest(((x - ax) * (bx - ax) + (y - ay) * (byy - ay)) / (pow(bx - ax, 2) + pow(byy - ay, 2)), 0), 1) * (bx - ax)), 2) + pow(y - (ay + least(greatest(((x - ax) * (bx - ax) + (y - ay) * (byy - ay)) / (pow(bx - ax, 2) + pow(byy - ay, 2)), 0), 1) * (byy - ay)), 2)) <= 5")
def jon_27_near_links(track: DataFrame) -> DataFrame:
    links = track.sparkSession.createDataFrame(_LINKS, "link int, ax double, ay double, bx double, by double")
    return L.near_links(track, links, 5.0).select("path_id", "seq", "link")


@query("track", f"SELECT path_id, seq, {q6('sqrt(9 + 16 + z * z)')} AS length_3d, {q6('5')} AS length_flat, {q6('sqrt(25 + z * z) * 1.3 + 6')} AS cost FROM track")
def sca_22_link_measures(track: DataFrame) -> DataFrame:
    links = track.select("path_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(0.0).alias("az"), (F.col("x") + 3).alias("bx"), (F.col("y") + 4).alias("by"), F.col("z").alias("bz"), F.lit(1.3).alias("unit_cost"), F.lit(2.0).alias("wait_s"))
    m = L.link_measures()
    return links.select("path_id", "seq", r6(m["length_3d"]).alias("length_3d"), r6(m["length_flat"]).alias("length_flat"), r6(m["cost"]).alias("cost"))


@query("embeddings", f"""
, e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), s AS (SELECT vec_id, (a + 0.5 * b) / sqrt(2) AS s0, (0.2 * a - b) / sqrt(2) AS s1 FROM e),
x AS (SELECT vec_id, exp(s0 - greatest(s0, s1)) AS e0, exp(s1 - greatest(s0, s1)) AS e1 FROM s), g AS (SELECT vec_id, least(greatest(e0 / (e0 + e1) * 2, 0.5), 2) AS g0, least(greatest(e1 / (e0 + e1) * 2, 0.5), 2) AS g1 FROM x)
SELECT vec_id, {q6('g0 / ((g0 + g1) / 2) * 0.6')} AS w0, {q6('g1 / ((g0 + g1) / 2) * 0.4')} AS w1 FROM g""")
def sca_11_attention_gate(embeddings: DataFrame) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    gate = S.attention_gate(z, [[1.0, 0.5], [0.2, -1.0]], [[1.0, 0.0], [0.0, 1.0]], [0.6, 0.4])
    return embeddings.select("vec_id", gate.alias("g")).select("vec_id", r6(F.col("g")[0]).alias("w0"), r6(F.col("g")[1]).alias("w1"))


@query("geo", f", b AS (SELECT min(lon) AS west, min(lat) AS south FROM geo) SELECT id, {q4('radians(lon - west) * 6371000.0 * cos(radians(south))')} AS x, {q4('radians(lat - south) * 6371000.0')} AS y FROM geo, b")
def sca_02_south_west(geo: DataFrame) -> DataFrame:
    corner = F.broadcast(geo.agg(F.min("lon").alias("west"), F.min("lat").alias("south")))
    x = F.radians(F.col("lon") - F.col("west")) * S.EARTH_RADIUS_M * F.cos(F.radians("south"))
    return geo.crossJoin(corner).select("id", r4(x).alias("x"), r4(F.radians(F.col("lat") - F.col("south")) * S.EARTH_RADIUS_M).alias("y"))


@query("track")
def sca_25_spatial_event(track: DataFrame) -> DataFrame:
    return track.select("path_id", "seq", S.spatial_event(7, "path_id", "seq", F.lit(0.3)).alias("e")).select("path_id", "seq", "e.*")


@query("tags", "SELECT way_id, CASE WHEN way_id % 7 = 0 THEN 'building' WHEN way_id % 5 = 0 THEN 'water' WHEN way_id % 3 = 0 AND highway IS NULL THEN 'green' END AS kind, CASE WHEN way_id % 4 = 0 THEN CAST(regexp_extract(width, '^([0-9.]+)', 1) AS DOUBLE) ELSE (way_id % 6 + 1) * 3.2 END AS height FROM tags")
def sca_30_area_kind(tags: DataFrame) -> DataFrame:
    """Also SCA-31."""
    way = F.col("way_id")
    made = F.create_map(F.lit("building"), F.when(way % 7 == 0, "yes"), F.lit("natural"), F.when(way % 5 == 0, "water"), F.lit("leisure"), F.when(way % 3 == 0, "park"), F.lit("highway"), F.col("highway"), F.lit("height"), F.when(way % 4 == 0, F.col("width")), F.lit("building:levels"), (way % 6 + 1).cast("string"))
    rows = tags.select("way_id", F.map_filter(made, lambda k, v: v.isNotNull()).alias("t"))
    return rows.select("way_id", S.area_kind(F.col("t")).alias("kind"), S.building_height(F.col("t")).alias("height"))


@query("tags", f"SELECT way_id, {q6("CASE WHEN way_id % 4 = 0 THEN CAST(regexp_extract(width, '^([0-9.]+)', 1) AS DOUBLE) ELSE (way_id % 6 + 1) * 3.2 END")} AS height FROM tags")
def sca_31_building_height(tags: DataFrame) -> DataFrame:
    way = F.col("way_id")
    made = F.create_map(F.lit("building"), F.lit("yes"), F.lit("height"), F.when(way % 4 == 0, F.col("width")), F.lit("building:levels"), (way % 6 + 1).cast("string"))
    return tags.select("way_id", r6(S.building_height(F.map_filter(made, lambda k, v: v.isNotNull()))).alias("height"))


@query("signal", ", b AS (SELECT series, idx, value - avg(value) OVER (PARTITION BY series) AS x FROM signal), s AS (SELECT a.series, sum(a.x * a.x) AS s0, sum(a.x * c.x) AS s1 FROM b a LEFT JOIN b c ON a.series = c.series AND c.idx = a.idx + 1 GROUP BY a.series) SELECT series, " + q4("CASE WHEN s1 / s0 > 0 AND s1 / s0 < 1 THEN -0.1 / ln(s1 / s0) END") + " AS tau FROM s")
def sca_36_ou_fit(signal: DataFrame) -> DataFrame:
    acf = A.autocorrelation(signal, "series", "idx", "value", 1).groupBy("series").agg(F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("a"))
    return acf.select("series", r4(S.ou_tau("a", 0.1)).alias("tau"))


_AHEAD = """
, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
v AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS arc FROM st),
h AS (SELECT path_id, arc, z, lead(arc) OVER w AS narc, lead(z) OVER w AS nz FROM v WINDOW w AS (PARTITION BY path_id ORDER BY arc, seq)),
o AS (SELECT path_id, seq, arc AS own, least(arc + 20, max(arc) OVER (PARTITION BY path_id)) AS far FROM v),
p AS (SELECT path_id, seq, 1 - 0.05 * k AS weight, side, greatest(own + (far - own) * k / 10.0 + side * 0.5, 0) AS s FROM o, (SELECT unnest(range(0, 11)) AS k), (SELECT unnest([-1, 1]) AS side)),
q AS (SELECT p.path_id, seq, weight, side * CASE WHEN narc > arc THEN z + (s - arc) / (narc - arc) * (nz - z) ELSE z END AS d FROM p ASOF JOIN h ON p.path_id = h.path_id AND p.s >= h.arc)"""


@query("track", _AHEAD + f" SELECT path_id, seq, {q6('2 * sum(d * weight) / sum(weight)')} AS grade FROM q GROUP BY path_id, seq")
def win_17_look_ahead_grade(track: DataFrame) -> DataFrame:
    return L.look_ahead_grade(track, 20.0).select("path_id", "seq", r6("grade").alias("grade"))


@query(("track", "polys"))
def grp_29_region_events(track: DataFrame, polys: DataFrame) -> DataFrame:
    """Entries of paths into regions, each decided by its keys, with start, direction and size."""
    boxes = polys.select("region_id", "p_loss", F.col("x0").alias("x_lo"), F.col("y0").alias("y_lo"), (F.col("x0") + F.col("side")).alias("x_hi"), (F.col("y0") + F.col("side")).alias("y_hi"))
    entered = J.box_entries(track, boxes, counted=True)
    return entered.withColumn("e", S.spatial_event(7, "region_id", "entry", "p_loss")).where("e.trigger").select("path_id", "region_id", "seq", "entry", "e.direction_rad", "e.magnitude", (5 + 10 * F.col("e.magnitude")).alias("duration_s"))


@query(("track", "polys"), ", s AS (SELECT path_id, region_id, seq FROM track JOIN polys ON x BETWEEN x0 AND x0 + side AND y BETWEEN y0 AND y0 + side), e AS (SELECT *, lag(seq) OVER (PARTITION BY path_id, region_id ORDER BY seq) AS b FROM s) SELECT path_id, region_id, seq FROM e WHERE b IS NULL OR seq > b + 1")
def win_13_region_entries(track: DataFrame, polys: DataFrame) -> DataFrame:
    boxes = polys.select("region_id", F.col("x0").alias("x_lo"), F.col("y0").alias("y_lo"), (F.col("x0") + F.col("side")).alias("x_hi"), (F.col("y0") + F.col("side")).alias("y_hi"))
    return J.box_entries(track, boxes).select("path_id", "region_id", "seq")


@query("track", f", v AS (SELECT path_id, max(seq) AS n FROM track GROUP BY path_id) SELECT path_id, k, {q6('least(greatest(k * 3.5, 0), n) * 2')} AS position FROM v, (SELECT unnest(range(0, 5)) AS k)")
def jon_31_time_to_arc(track: DataFrame) -> DataFrame:
    profile = track.select("path_id", "seq", F.col("seq").cast("double").alias("arc"), (F.col("seq") * 2.0).alias("x"), F.lit(0.0).alias("y"))
    targets = track.select("path_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("s", F.col("k") * 3.5)
    return J.at_arc(profile, targets).select("path_id", "k", r6("x").alias("position"))


@query("samples", f"SELECT run_id, {q6('(count(*) - 1) / (max(time_s) - min(time_s))')} AS rate FROM samples GROUP BY run_id HAVING count(*) > 1 AND max(time_s) > min(time_s)")
def agg_45_sample_rate(samples: DataFrame) -> DataFrame:
    span = F.max("time_s") - F.min("time_s")
    return samples.groupBy("run_id").agg(F.when((F.count("*") > 1) & (span > 0), (F.count("*") - 1) / span).alias("rate")).where("rate is not null").select("run_id", r6("rate").alias("rate"))
