"""Queries of spectra and path geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import geometry as G
from trackloom.operators import predicates as P
from trackloom.operators import signal as S
from trackloom.plans.registry import q4, q6, query, r4, r6

def _spectrum(bins: str, hz: float = 100) -> str:
    return f"""
, n AS (SELECT series, idx, value, count(*) OVER (PARTITION BY series) AS n FROM signal),
w AS (SELECT *, 0.5 - 0.5 * cos({2 * math.pi!r} * idx / n) AS w, pow(2, ceil(log2(n) - 1e-9)) AS size FROM n WHERE n >= 2),
b AS (SELECT *, k FROM w, LATERAL (SELECT unnest(range(0, {bins})) AS k) WHERE k <= size / 2),
spec AS (SELECT series, k AS bin, any_value(k * {hz} / size) AS hz, sqrt(pow(sum(value * w * cos({2 * math.pi!r} * k * idx / size)), 2) + pow(sum(value * w * sin({2 * math.pi!r} * k * idx / size)), 2)) * 2 / sum(w) AS m FROM b GROUP BY series, k)"""


_SPEC = _spectrum("12")
_WHOLE = _spectrum("CAST(size / 2 AS BIGINT) + 1")


@query("signal", _WHOLE + f" SELECT series, bin, {q4('hz')} AS frequency_hz, {q4('m')} AS magnitude FROM spec")
def grp_01_spectrum(signal: DataFrame) -> DataFrame:
    return S.spectrum(signal, "series", "idx", "value", 100.0).select("series", "bin", r4("frequency_hz").alias("frequency_hz"), r4("magnitude").alias("magnitude"))


@query("signal", _SPEC + f" SELECT series, bin, {q4('hz')} AS frequency_hz, {q4('m')} AS magnitude FROM spec")
def grp_01_dft_bins(signal: DataFrame) -> DataFrame:
    return S.dft_bins(signal, "series", "idx", "value", 100.0, 12).select("series", "bin", r4("frequency_hz").alias("frequency_hz"), r4("magnitude").alias("magnitude"))


_LINES = _spectrum("CAST(size / 2 AS BIGINT) + 1", 10) + """
, nb AS (SELECT *, lag(m) OVER w AS b, lead(m) OVER w AS a, lead(hz) OVER w - hz AS step FROM spec WINDOW w AS (PARTITION BY series ORDER BY bin)),
sh AS (SELECT *, CASE WHEN abs(b - 2 * m + a) > 1e-12 THEN least(greatest(0.5 * (b - a) / (b - 2 * m + a), -0.5), 0.5) ELSE 0 END AS shift FROM nb WHERE b IS NOT NULL AND a IS NOT NULL),
li AS (SELECT *, hz + shift * step AS line_hz, m - 0.25 * (b - a) * shift AS line FROM sh),
ba AS (SELECT series, arg_max(line_hz, (m, -bin)) AS cadence_hz, arg_max(line, (m, -bin)) AS amplitude FROM li WHERE hz BETWEEN 1.4 AND 3.6 GROUP BY series),
gait AS (SELECT series, cadence_hz, amplitude, coalesce(max(line) FILTER (abs(hz - 2 * cadence_hz) <= 0.1 * 2 * cadence_hz) / amplitude, 0) AS ratio_2, coalesce(max(line) FILTER (abs(hz - 3 * cadence_hz) <= 0.1 * 3 * cadence_hz) / amplitude, 0) AS ratio_3 FROM li JOIN ba USING (series) WHERE amplitude > 0 GROUP BY series, cadence_hz, amplitude)"""


@query("signal", _LINES + f" SELECT series, {q4('cadence_hz')} AS cadence_hz, {q4('amplitude')} AS amplitude, {q4('ratio_2')} AS ratio_2, {q4('ratio_3')} AS ratio_3 FROM gait")
def grp_02_gait_signature(signal: DataFrame) -> DataFrame:
    gait = S.gait_signature(S.spectrum(signal, "series", "idx", "value", 10.0), "series")
    return gait.select("series", *[r4(c).alias(c) for c in ("cadence_hz", "amplitude", "ratio_2", "ratio_3")])


@query("signal", _LINES + f" SELECT series, name, {q4('value')} AS value FROM (SELECT series, unnest(['cadence_hz', 'amplitude', 'ratio_2', 'ratio_3']) AS name, unnest([cadence_hz, amplitude, ratio_2, ratio_3]) AS value FROM gait)")
def grp_03_observables(signal: DataFrame) -> DataFrame:
    gait = S.gait_signature(S.spectrum(signal, "series", "idx", "value", 10.0), "series")
    return S.observables(gait, ["series"]).select("series", "name", r4("value").alias("value"))


@query("signal", _LINES + f" SELECT series, {q4('arg_max(hz, (m, -bin)) FILTER (hz >= 0.2)')} AS dominant_hz, {q4('max(m) FILTER (hz BETWEEN 2 AND 3)')} AS step_magnitude, {q4('arg_min(m, (abs(hz - 5), bin))')} AS second_magnitude FROM spec GROUP BY series")
def grp_04_spectrum_summary(signal: DataFrame) -> DataFrame:
    got = S.spectrum_summary(S.spectrum(signal, "series", "idx", "value", 10.0), "series", 2.5)
    return got.select("series", *[r4(c).alias(c) for c in ("dominant_hz", "step_magnitude", "second_magnitude")])


@query("signal", _SPEC + f" SELECT series, {q4('arg_min(m, (abs(hz - 6), bin))')} AS magnitude FROM spec GROUP BY series")
def srt_05_magnitude_at(signal: DataFrame) -> DataFrame:
    return S.magnitude_at(S.dft_bins(signal, "series", "idx", "value", 100.0, 12).withColumn("segment", F.lit(0)), "series", 6.0).select("series", r4("magnitude").alias("magnitude"))


@query("signal", f"""
, n AS (SELECT series, idx, value - avg(value) OVER (PARTITION BY series) AS v, count(*) OVER (PARTITION BY series) AS n FROM signal WHERE idx < 2048),
b AS (SELECT *, unnest(range(1, n // 2 + 1)) AS bin FROM n WHERE n >= 32)
SELECT series, bin, {q4('any_value(bin * 100.0 / n)')} AS frequency_hz, {q4(f'2 * sqrt(pow(sum(v * cos({2 * math.pi!r} * bin * idx / n)), 2) + pow(sum(v * sin({2 * math.pi!r} * bin * idx / n)), 2)) / any_value(n)')} AS magnitude FROM b GROUP BY series, bin""")
def grp_31_periodogram(signal: DataFrame) -> DataFrame:
    return S.periodogram(signal, "series", "idx", "value", 100.0).select("series", "bin", r4("frequency_hz").alias("frequency_hz"), r4("magnitude").alias("magnitude"))


_ARC = """
, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
v AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS arc FROM st),
g AS (SELECT *, lead(arc) OVER w AS narc, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY path_id ORDER BY arc, seq))"""


@query("track", _ARC + f"""
, t AS (SELECT path_id, max(arc) AS total, CAST(greatest(ceil(max(arc) / 100.0), 1) AS BIGINT) AS n FROM v GROUP BY path_id),
q AS (SELECT path_id, k, total * k / n AS s FROM t, LATERAL (SELECT unnest(range(0, n + 1)) AS k)),
h AS (SELECT q.path_id, q.k, q.s, arg_max(g.seq, (g.arc, g.seq)) AS seq FROM q JOIN g ON g.path_id = q.path_id AND g.arc <= q.s GROUP BY ALL)
SELECT h.path_id, h.k, {q4('CASE WHEN narc IS NULL THEN x ELSE x + CASE WHEN narc > arc THEN least(greatest((s - arc) / (narc - arc), 0), 1) ELSE 0 END * (nx - x) END')} AS x FROM h JOIN g USING (path_id, seq) WHERE k > 0""")
def grp_05_resample(track: DataFrame) -> DataFrame:
    return G.resample(track, 100.0).where("k > 0").select("path_id", "k", r4("x").alias("x"))


@query("track", _ARC + f", t AS (SELECT path_id, max(arc) AS total FROM v GROUP BY path_id HAVING max(arc) > 100) SELECT path_id, count(*) AS n, {q4('sum(s)')} AS arcs FROM (SELECT path_id, arc AS s FROM v WHERE arc > 100 AND arc < 900 UNION ALL SELECT path_id, 100 FROM t UNION ALL SELECT path_id, least(900, total) FROM t) GROUP BY path_id")
def grp_06_sub_path(track: DataFrame) -> DataFrame:
    return G.sub_path(track, 100.0, 900.0).groupBy("path_id").agg(F.count("*").alias("n"), r4(F.sum("s")).alias("arcs"))


@query("track")
def grp_07_simplify(track: DataFrame) -> DataFrame:
    return G.simplify(track, 15.0, 160.0, 0.5).select("path_id", "seq")


@query("track")
def grp_08_remove_spikes(track: DataFrame) -> DataFrame:
    return G.remove_spikes(track, 300.0, 10.0).select("path_id", "seq")


@query("track")
def grp_09_turns(track: DataFrame) -> DataFrame:
    return G.turns(track, 40.0, 60.0).select("path_id", r4("arc").alias("arc"), r6("turn").alias("turn"), "kind")


@query("polys")
def grp_10_stitched_rings(polys: DataFrame) -> DataFrame:
    corners = polys.select("region_id", P.poly_ring().alias("ring"))
    closed = corners.select("region_id", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
    halves = closed.select("region_id", F.explode(F.array(F.struct(F.lit(1).alias("f"), F.slice("ring", 1, 3).alias("p")), F.struct(F.lit(0).alias("f"), F.slice("ring", 3, 9).alias("p")))).alias("h"))
    fragments = halves.select("region_id", F.col("h.f").alias("fragment"), F.posexplode("h.p").alias("seq", "c")).select("region_id", "fragment", "seq", "c.x", "c.y")
    return G.stitched_rings(fragments, "region_id")


@query("track", "SELECT path_id, seq, x AS x0, lead(x) OVER w AS x1 FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq) QUALIFY x1 IS NOT NULL")
def grp_30_segments(track: DataFrame) -> DataFrame:
    return G.segments(track).select("path_id", "seq", "x0", "x1")


@query("track", ", a AS (SELECT path_id, count(*) AS n FROM track WHERE seq < 10 GROUP BY path_id), b AS (SELECT path_id, count(*) AS n FROM track WHERE seq >= 9 GROUP BY path_id) SELECT path_id, a.n + coalesce(b.n, 0) - CASE WHEN b.n IS NULL THEN 0 ELSE 1 END AS n FROM a LEFT JOIN b USING (path_id)")
def set_05_concatenate(track: DataFrame) -> DataFrame:
    points = track.select("path_id", "seq", "x", "y")
    rest = points.where("seq >= 9").withColumn("seq", F.col("seq") - 9)
    return G.concatenated(points.where("seq < 10"), rest).groupBy("path_id").agg(F.count("*").alias("n"))


@query("track", "SELECT path_id, path_id % 3 <> 0 OR count(*) < 5 AS same FROM track GROUP BY path_id")
def set_06_same_polyline(track: DataFrame) -> DataFrame:
    moved = track.withColumn("x", F.when((F.col("path_id") % 3 == 0) & (F.col("seq") == 4), F.col("x") + 1).otherwise(F.col("x") + 0.01))
    return G.same_polyline(track, moved)


@query("polys", f"SELECT region_id, x0 AS x_lo, x0 + side AS x_hi, CASE WHEN triangle = 1 THEN side * side / 2 ELSE side * side END AS area, {q6('CASE WHEN triangle = 1 THEN x0 + side / 3 ELSE x0 + side / 2 END')} AS cx, {q6('CASE WHEN triangle = 1 THEN y0 + side / 3 ELSE y0 + side / 2 END')} AS mean_y FROM polys")
def agg_36_ring_measures(polys: DataFrame) -> DataFrame:
    corners = polys.select("region_id", F.posexplode(P.poly_ring()).alias("seq", "c")).select("region_id", "seq", "c.x", "c.y")
    return G.ring_measures(corners, "region_id").select("region_id", "x_lo", "x_hi", "area", r6("cx").alias("cx"), r6("mean_y").alias("mean_y"))
