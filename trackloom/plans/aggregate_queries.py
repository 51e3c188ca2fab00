"""Queries of summaries, tests, fits, top-k and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators import aggregates as A
from trackloom.operators import predicates as P
from trackloom.operators import windows as O
from trackloom.operators.ranking import global_rank
from trackloom.plans.registry import q4, q6, query, r4, r6

_SUMMARY = "count(*) AS n, " + ", ".join(f"{q6(e)} AS {n}" for e, n in (("avg({v})", "mean"), ("stddev_pop({v})", "std"), ("min({v})", "min"), ("quantile_cont({v}, 0.05)", "p05"), ("quantile_cont({v}, 0.5)", "p50"), ("quantile_cont({v}, 0.95)", "p95"), ("max({v})", "max")))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "p05", "p50", "p95", "max")])


@query("signal", f"SELECT series, {_SUMMARY.format(v='value')} FROM signal GROUP BY series")
def agg_01_distribution(signal: DataFrame) -> DataFrame:
    return _rounded(A.distribution(signal, ["series"], "value", parts=32), "series")


@query("signal", f"SELECT series, {q6('CASE WHEN abs(avg(value)) < 1e-9 THEN 0 ELSE stddev_pop(value) / abs(avg(value)) END')} AS cv FROM signal GROUP BY series")
def agg_02_variation(signal: DataFrame) -> DataFrame:
    return A.variation(signal, ["series"], "value").select("series", r6("cv").alias("cv"))


_KS = """
, c AS (SELECT {k} value, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type <> 'view') AS b FROM signal GROUP BY {k} value),
s AS (SELECT {k} sum(a) OVER ({p} ORDER BY value) AS ca, sum(b) OVER ({p} ORDER BY value) AS cb, sum(a) OVER ({p}) AS na, sum(b) OVER ({p}) AS nb FROM c),
d AS (SELECT {k} max(CASE WHEN na > 0 AND nb > 0 THEN abs(ca / na - cb / nb) ELSE 1 END) AS d, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM s {g})"""


@query("signal", _KS.format(k="series,", p="PARTITION BY series", g="GROUP BY series") + f" SELECT series, {q6('d')} AS d, n_a, n_b FROM d")
def agg_03_ks_by_series(signal: DataFrame) -> DataFrame:
    rows = signal.withColumn("is_a", F.col("event_type") == "view")
    return A.ks_statistic(rows, "value", "is_a", ["series"]).select("series", r6("d").alias("d"), "n_a", "n_b")


@query("signal", _KS.format(k="", p="", g="") + f" SELECT {q6('d')} AS d, n_a, n_b FROM d")
def agg_03_ks_of_all(signal: DataFrame) -> DataFrame:
    rows = signal.withColumn("is_a", F.col("event_type") == "view")
    return A.ks_statistic(rows, "value", "is_a", buckets=16).select(r6("d").alias("d"), "n_a", "n_b")


@query("signal", _KS.format(k="series,", p="PARTITION BY series", g="GROUP BY series") + f"""
, l AS (SELECT *, (sqrt(n_a * n_b / CAST(n_a + n_b AS DOUBLE)) + 0.12 + 0.11 / sqrt(n_a * n_b / CAST(n_a + n_b AS DOUBLE))) * d AS lam FROM d),
k AS (SELECT unnest(range(1, 101)) AS i),
t AS (SELECT series, any_value(n_a) AS n_a, any_value(n_b) AS n_b, any_value(lam) AS lam, sum(exp(-(2 * i - 1) * (2 * i - 1) * {math.pi**2!r} / (8 * lam * lam))) AS low, sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * lam * lam)) AS high FROM l, k GROUP BY series)
SELECT series, {q6(f'CASE WHEN n_a = 0 OR n_b = 0 OR lam <= 0 THEN 1 ELSE least(greatest(CASE WHEN lam < 1 THEN 1 - {math.sqrt(2 * math.pi)!r} / lam * low ELSE 2 * high END, 0), 1) END')} AS p FROM t""")
def agg_04_ks_p_value(signal: DataFrame) -> DataFrame:
    rows = signal.withColumn("is_a", F.col("event_type") == "view")
    return A.ks_statistic(rows, "value", "is_a", ["series"]).select("series", r6(A.ks_p_value("d", "n_a", "n_b")).alias("p"))


_ACF = """
, b AS (SELECT series, idx, value - avg(value) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n, var_pop(value) OVER (PARTITION BY series) AS v FROM signal),
s AS (SELECT a.series, c.idx - a.idx AS lag, sum(a.x * c.x) AS s, any_value(a.n) AS n, any_value(a.v) AS v FROM b a JOIN b c ON a.series = c.series AND c.idx >= a.idx AND c.idx <= a.idx + 10 GROUP BY ALL),
acf AS (SELECT s.series, s.lag, CASE WHEN s.n < 3 OR s.v < 1e-12 THEN 1 ELSE s.s / z.s END AS acf FROM s JOIN s z ON s.series = z.series AND z.lag = 0 WHERE s.lag = 0 OR NOT (s.n < 3 OR s.v < 1e-12))"""


@query("signal", _ACF + f" SELECT series, CAST(lag AS INTEGER) AS lag, {q6('acf')} AS acf FROM acf")
def agg_05_autocorrelation(signal: DataFrame) -> DataFrame:
    return A.autocorrelation(signal, "series", "idx", "value", 10).select("series", "lag", r6("acf").alias("acf"))


@query("signal", _ACF + f" SELECT series, coalesce(min(lag) FILTER (acf < {math.exp(-1)!r}), count(*)) AS lag FROM acf GROUP BY series")
def agg_06_correlation_time(signal: DataFrame) -> DataFrame:
    return A.correlation_time(A.autocorrelation(signal, "series", "idx", "value", 10), "series")


@query("samples", f"SELECT run_id, {_SUMMARY.format(v='(speed * kappa_eff)')} FROM samples WHERE NOT standing AND NOT turning GROUP BY run_id")
def agg_07_turn_rate(samples: DataFrame) -> DataFrame:
    return _rounded(A.distribution(samples.where(P.moving()).withColumn("rate", F.col("speed") * F.col("kappa_eff")), ["run_id"], "rate"), "run_id")


@query("samples", f"SELECT run_id, {_SUMMARY.format(v='speed')} FROM samples WHERE NOT standing AND NOT turning AND speed >= 0.5 GROUP BY run_id")
def agg_08_running_speed(samples: DataFrame) -> DataFrame:
    return _rounded(A.distribution(samples.where(P.running()), ["run_id"], "speed"), "run_id")


@query("track", f"""
, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS s, sqrt(pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2)) AS r FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
g AS (SELECT path_id, coalesce(sum(s), 0) AS l, arg_max(r, seq) AS e, max(r) AS reach FROM s GROUP BY path_id), b AS (SELECT *, CASE WHEN e < 1 THEN 2 * reach ELSE e END AS base FROM g)
SELECT path_id, {q4('l')} AS length_m, {q4('CASE WHEN base > 1e-9 THEN l / base ELSE 1 END')} AS ratio FROM b""")
def agg_09_path_ratio(track: DataFrame) -> DataFrame:
    return A.path_ratio(track, "path_id").select("path_id", r4("length_m").alias("length_m"), r4("ratio").alias("ratio"))


_LAPS = """
, a AS (SELECT run_id, time_s, event_id, row_number() OVER (PARTITION BY run_id ORDER BY time_s, event_id) * 7.0 AS arc FROM samples),
t AS (SELECT *, greatest(floor(max(arc) OVER (PARTITION BY run_id) / 50.0), 1) - 1 AS last FROM a),
l AS (SELECT run_id, least(floor(arc / 50.0), last) AS lap, min(time_s) AS t0, max(time_s) AS t1 FROM t GROUP BY ALL),
laps AS (SELECT run_id, CAST(lap AS BIGINT) AS lap, coalesce(lead(t0) OVER (PARTITION BY run_id ORDER BY lap), max(t1) OVER (PARTITION BY run_id)) - t0 AS seconds FROM l)"""


def _laps(samples: DataFrame) -> DataFrame:
    arc = samples.withColumn("arc", F.row_number().over(W.partitionBy("run_id").orderBy("time_s", "event_id")) * 7.0)
    return A.lap_times(arc, "run_id", "arc", "time_s", 50.0)


@query("samples", _LAPS + f" SELECT run_id, lap, {q4('seconds')} AS seconds FROM laps")
def agg_10_lap_times(samples: DataFrame) -> DataFrame:
    return _laps(samples).select("run_id", "lap", r4("seconds").alias("seconds"))


@query("samples", _LAPS + f" SELECT run_id, {q6('CASE WHEN count(*) >= 2 THEN CASE WHEN abs(avg(seconds)) < 1e-9 THEN 0 ELSE stddev_pop(seconds) / abs(avg(seconds)) END END')} AS cv FROM laps WHERE lap > 0 GROUP BY run_id")
def agg_11_lap_variation(samples: DataFrame) -> DataFrame:
    return A.lap_variation(_laps(samples), "run_id", standing_start=True).select("run_id", r6("cv").alias("cv"))


@query("samples", f"""
, e AS (SELECT DISTINCT run_id, CAST(floor(time_s / 86400) AS BIGINT) AS d FROM samples), n AS (SELECT run_id, d, lead(d) OVER (PARTITION BY run_id ORDER BY d) AS nx FROM e)
SELECT run_id, {q6('count(*) / CAST(count(*) + sum(CASE WHEN nx > d + 1 THEN nx - d - 1 ELSE 0 END) AS DOUBLE)')} AS availability FROM n GROUP BY run_id""")
def agg_12_availability(samples: DataFrame) -> DataFrame:
    days = samples.select("run_id", F.floor(F.col("time_s") / 86400).alias("d")).distinct()
    return A.availability(days, O.gaps(days, "run_id", "d"), "run_id").select("run_id", r6("availability").alias("availability"))


_FIT = ", g AS (SELECT od, count(*) AS n, var_pop(length_m) AS vx, var_pop(sqrt(cost_equiv_m)) AS vy, covar_pop(length_m, sqrt(cost_equiv_m)) AS c, avg(length_m) AS mx, avg(sqrt(cost_equiv_m)) AS my FROM candidates GROUP BY od)"


@query("candidates", _FIT + f" SELECT od, n, CASE WHEN n >= 3 AND vx > 1e-12 THEN {q4('c / vx')} END AS slope, CASE WHEN n >= 3 AND vx > 1e-12 THEN {q4('my - c / vx * mx')} END AS intercept, CASE WHEN n >= 3 AND vx > 1e-12 THEN CASE WHEN vy <= 1e-12 THEN 1.0 ELSE {q4('least(greatest(c * c / (vx * vy), 0), 1)')} END END AS r2 FROM g")
def agg_13_linear_fit(candidates: DataFrame) -> DataFrame:
    return A.linear_fit(candidates.withColumn("root", F.sqrt("cost_equiv_m")), ["od"], "length_m", "root").select("od", "n", *[r4(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("candidates", _FIT + f" SELECT od, n, CASE WHEN n >= 2 THEN CASE WHEN vx <= 1e-12 THEN 0.0 ELSE {q4('c / vx')} END END AS slope, CASE WHEN n >= 2 THEN {q4('my - CASE WHEN vx <= 1e-12 THEN 0 ELSE c / vx END * mx')} END AS intercept, CASE WHEN n >= 2 THEN CASE WHEN vy <= 1e-12 OR vx <= 1e-12 THEN 0.0 ELSE {q4('least(greatest(c * c / (vx * vy), 0), 1)')} END END AS r2 FROM g")
def agg_14_chart_fit(candidates: DataFrame) -> DataFrame:
    return A.linear_fit(candidates.withColumn("root", F.sqrt("cost_equiv_m")), ["od"], "length_m", "root", for_chart=True).select("od", "n", *[r4(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("samples", f", m AS (SELECT run_id, avg(speed) AS v, count(*) / 60.0 AS cadence FROM samples GROUP BY run_id) SELECT {q6('regr_slope(v, cadence)')} AS slope, {q6('regr_r2(v, cadence)')} AS r2 FROM m")
def agg_15_cadence_fit(samples: DataFrame) -> DataFrame:
    runs = samples.groupBy("run_id").agg(F.avg("speed").alias("v"), (F.count("*") / 60.0).alias("cadence"))
    return A.linear_fit(runs, [], "cadence", "v").select(r6("slope").alias("slope"), r6("r2").alias("r2"))


@query("candidates", f", k AS (SELECT unnest(range(0, 9)) AS idx) SELECT k.idx, {q6('count(c.idx) / (SELECT count(*) FROM candidates)')} AS share FROM k LEFT JOIN candidates c USING (idx) GROUP BY k.idx")
def agg_16_choice_frequency(candidates: DataFrame) -> DataFrame:
    return A.choice_frequencies(candidates, "idx", 9).select("idx", r6("share").alias("share"))


@query("candidates", f"SELECT idx, count(*) AS n, {q6('count(*) / sum(count(*)) OVER ()')} AS share FROM candidates GROUP BY idx")
def agg_17_choice_share(candidates: DataFrame) -> DataFrame:
    return A.choice_shares(candidates, "idx").select(F.col("idx").cast("long").alias("idx"), "n", r6("share").alias("share"))


@query("samples", f"SELECT run_id, {q6('coalesce(avg(abs(kappa_eff)) FILTER (NOT standing AND NOT turning), 0)')} AS curvature, {q6('max(time_s) - min(time_s)')} AS duration_s, {q6('max(speed)')} AS top FROM samples GROUP BY run_id")
def agg_19_curvature_and_extent(samples: DataFrame) -> DataFrame:
    kept = F.when(P.moving(), F.abs("kappa_eff"))
    return samples.groupBy("run_id").agg(r6(F.coalesce(F.avg(kept), F.lit(0.0))).alias("curvature"), r6(F.max("time_s") - F.min("time_s")).alias("duration_s"), r6(F.max("speed")).alias("top"))


@query("signal", ", b AS (SELECT unnest(range(0, 20)) AS bin) SELECT b.bin, count(s.value) AS n FROM b LEFT JOIN signal s ON s.value >= 50 AND s.value < 450 AND least(floor((s.value - 50) * 20 / 400), 19) = b.bin GROUP BY b.bin")
def agg_21_histogram(signal: DataFrame) -> DataFrame:
    return A.histogram(signal, "value", 20, 50.0, 450.0)


@query("signal", f"""
, r AS (SELECT series, min(value) AS lo, max(value) AS hi, count(*) AS n FROM signal GROUP BY series), w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 12 ELSE 1 END AS width FROM r)
SELECT series, CAST(least(floor((value - lo) / width), 11) AS BIGINT) AS bin, count(*) AS n, {q6('count(*) / (any_value(w.n) * any_value(width))')} AS density FROM signal JOIN w USING (series) GROUP BY series, bin""")
def agg_22_auto_histogram(signal: DataFrame) -> DataFrame:
    return A.auto_histogram(signal, ["series"], "value", 12).select("series", "bin", "n", r6("density").alias("density"))


@query("signal", "SELECT series, coalesce(min(value), 0) AS low, coalesce(max(value), 0) AS high FROM signal GROUP BY series")
def agg_23_extent(signal: DataFrame) -> DataFrame:
    return A.extent(signal, ["series"], "value")


@query("cells", f"SELECT cy % 16 AS layer, {q4('min(value)')} AS low, {q4('max(value)')} AS high, {q4('avg(value)')} AS mean, {q4('avg(CAST(blocked AS INTEGER))')} AS forbidden, {q4('count(value) / CAST(count(*) AS DOUBLE)')} AS coverage FROM cells GROUP BY layer")
def agg_24_layer_statistics(cells: DataFrame) -> DataFrame:
    stats = (F.min("value"), F.max("value"), F.avg("value"), F.avg(F.col("blocked").cast("int")), F.count("value") / F.count("*"))
    return cells.groupBy((F.col("cy") % 16).alias("layer")).agg(*[r4(c).alias(n) for c, n in zip(stats, ("low", "high", "mean", "forbidden", "coverage"), strict=True)])


@query("samples", f"SELECT {_SUMMARY.format(v='speed')} FROM samples WHERE NOT standing AND NOT turning AND speed >= 0.5")
def agg_26_pooled_speeds(samples: DataFrame) -> DataFrame:
    return _rounded(A.distribution(samples.where(P.running()), [], "speed", parts=32))


@query("polys", f"SELECT CAST(x0 AS BIGINT) AS cell, {q6('1 - product(1 - least(greatest(p_loss, 0), 1))')} AS p_loss FROM polys GROUP BY cell")
def agg_30_combined_loss(polys: DataFrame) -> DataFrame:
    return A.combined_loss(polys.withColumn("cell", F.col("x0").cast("long")), ["cell"], "p_loss").select("cell", r6("p_loss").alias("p_loss"))


@query("track", "SELECT path_id, CASE greatest(var_pop(x), var_pop(y), var_pop(z)) WHEN var_pop(x) THEN 0 WHEN var_pop(y) THEN 1 ELSE 2 END AS axis FROM track GROUP BY path_id")
def agg_31_gait_axis(track: DataFrame) -> DataFrame:
    return A.gait_axis(track, ["path_id"], ["x", "y", "z"])


@query("samples", f"SELECT run_id, {q6('least(greatest(avg(speed) FILTER (speed > 0.3) / 3.0, 0.5), 1.5)')} AS ratio FROM samples GROUP BY run_id")
def agg_35_pace_ratio(samples: DataFrame) -> DataFrame:
    mean = F.avg(F.when(F.col("speed") > 0.3, F.col("speed")))
    return samples.groupBy("run_id").agg(r6(F.least(F.greatest(mean / 3.0, F.lit(0.5)), F.lit(1.5))).alias("ratio"))


@query("task_events", "SELECT task_id, count(*) FILTER (type NOT IN ('done', 'error')) AS active FROM task_events GROUP BY task_id")
def agg_38_active(task_events: DataFrame) -> DataFrame:
    return task_events.groupBy("task_id").agg(F.count_if(~F.col("type").isin("done", "error")).alias("active"))


@query("candidates", f"SELECT {q6('corr(length_m, cost_equiv_m)')} AS r FROM candidates")
def agg_41_pearson(candidates: DataFrame) -> DataFrame:
    return candidates.agg(r6(F.corr("length_m", "cost_equiv_m")).alias("r"))


@query("signal", f"SELECT event_type, {_SUMMARY.format(v='value')} FROM signal GROUP BY event_type")
def agg_42_population(signal: DataFrame) -> DataFrame:
    return _rounded(A.distribution(signal, ["event_type"], "value", parts=32), "event_type")


@query("samples", f", o AS (SELECT run_id, speed, standing, row_number() OVER (PARTITION BY run_id ORDER BY speed, event_id) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM samples) SELECT run_id, {q6('avg(CAST(NOT standing AS INTEGER))')} AS usable, {q6('max(speed) FILTER (p = least(floor(0.95 * n) + 1, n))')} AS p95 FROM o GROUP BY run_id")
def agg_43_usability(samples: DataFrame) -> DataFrame:
    rows = samples.withColumn("p", F.row_number().over(W.partitionBy("run_id").orderBy("speed", "event_id"))).withColumn("n", F.count("*").over(W.partitionBy("run_id")))
    at = F.least(F.floor(0.95 * F.col("n")) + 1, F.col("n"))
    return rows.groupBy("run_id").agg(r6(F.avg((~F.col("standing")).cast("int"))).alias("usable"), r6(F.max(F.when(F.col("p") == at, F.col("speed")))).alias("p95"))


@query("samples", f", d AS (SELECT run_id, speed, time_s, (speed - lag(speed) OVER w) / nullif(time_s - lag(time_s) OVER w, 0) AS a FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY time_s, event_id)) SELECT run_id, {q6('max(abs(a))')} AS top_acceleration, {q6('max(greatest(speed - 6, 0))')} AS excess, {q6('CASE WHEN count(*) > 1 AND max(time_s) > min(time_s) THEN (count(*) - 1) / (max(time_s) - min(time_s)) ELSE 100 END')} AS rate FROM d GROUP BY run_id")
def agg_44_profile(samples: DataFrame) -> DataFrame:
    w = W.partitionBy("run_id").orderBy("time_s", "event_id")
    dt = F.nullif(F.col("time_s") - F.lag("time_s").over(w), F.lit(0.0))
    rows = samples.withColumn("a", (F.col("speed") - F.lag("speed").over(w)) / dt)
    span = F.max("time_s") - F.min("time_s")
    return rows.groupBy("run_id").agg(r6(F.max(F.abs("a"))).alias("top_acceleration"), r6(F.max(F.greatest(F.col("speed") - 6, F.lit(0.0)))).alias("excess"), r6(F.when((F.count("*") > 1) & (span > 0), (F.count("*") - 1) / span).otherwise(100.0)).alias("rate"))


# --- sorts, limits and sets ------------------------------------------------------------------


@query("signal", "SELECT series, event_id, CAST(row_number() OVER (PARTITION BY series ORDER BY value DESC, event_id) AS INTEGER) AS place FROM signal QUALIFY place <= 5")
def srt_01_top_k(signal: DataFrame) -> DataFrame:
    w = W.partitionBy("series").orderBy(F.desc("value"), "event_id")
    return signal.withColumn("place", F.row_number().over(w)).where("place <= 5").select("series", "event_id", "place")


@query("signal", "SELECT series, arg_max(idx, (value, -idx)) AS idx, max(value) AS value FROM (SELECT * FROM signal WHERE idx BETWEEN 3 AND 30) GROUP BY series")
def srt_02_peak_in_band(signal: DataFrame) -> DataFrame:
    return signal.where(F.col("idx").between(3, 30)).groupBy("series").agg(F.max_by("idx", F.struct("value", -F.col("idx"))).cast("long").alias("idx"), F.max("value").alias("value"))


@query("samples", ", p AS (SELECT event_id, speed FROM samples ORDER BY speed DESC, event_id LIMIT 50 OFFSET 100) SELECT p.*, t.total FROM p, (SELECT count(*) AS total FROM samples) t")
def srt_03_page(samples: DataFrame) -> DataFrame:
    page = samples.select("event_id", "speed").orderBy(F.desc("speed"), "event_id").offset(100).limit(50)
    return page.crossJoin(F.broadcast(samples.agg(F.count("*").alias("total"))))


@query("polys", "SELECT region_id, CAST(rank() OVER (ORDER BY CASE WHEN triangle = 1 THEN side * side / 2 ELSE side * side END DESC, region_id) AS INTEGER) AS paint FROM polys")
def srt_04_largest_first(polys: DataFrame) -> DataFrame:
    area = F.when(F.col("triangle") == 1, F.col("side") * F.col("side") / 2).otherwise(F.col("side") * F.col("side"))
    return global_rank(polys.select("region_id", area.alias("area")), [F.desc("area"), F.col("region_id")], "paint").select("region_id", F.col("paint").cast("int").alias("paint"))


@query("part", f", s AS (SELECT p_brand, p_partkey, pow((p_size - 20) / 10.0, 2) + pow((p_retailprice - 1000) / 100, 2) AS loss FROM part) SELECT p_brand, arg_min(p_partkey, (loss, p_partkey)) AS best, {q6('min(loss)')} AS loss FROM s GROUP BY p_brand")
def srt_06_best_candidate(part: DataFrame) -> DataFrame:
    loss = F.pow((F.col("p_size") - 20) / 10.0, F.lit(2)) + F.pow((F.col("p_retailprice") - 1000) / 100, F.lit(2))
    return part.withColumn("loss", loss).groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("loss", "p_partkey")).alias("best"), r6(F.min("loss")).alias("loss"))


@query("samples", "SELECT channel, count(*) AS n FROM (SELECT 'gnss' AS channel FROM samples UNION ALL SELECT 'baro' FROM samples WHERE standing UNION ALL SELECT 'accel' FROM samples WHERE turning) GROUP BY channel")
def set_01_channels(samples: DataFrame) -> DataFrame:
    parts = [samples.select(F.lit("gnss").alias("channel"), "speed"), samples.where("standing").select(F.lit("baro").alias("channel"), "kappa_eff"), samples.where("turning").select(F.lit("accel").alias("channel"), "time_s")]
    table = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return table.groupBy("channel").agg(F.count("*").alias("n"))


@query("track", "SELECT DISTINCT CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy FROM track")
def set_02_distinct_cells(track: DataFrame) -> DataFrame:
    return track.select(F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy")).distinct()


@query("track", "SELECT DISTINCT CAST(floor(x / 10) AS BIGINT) AS cx FROM track WHERE y < 50 EXCEPT SELECT CAST(floor(x / 10) AS BIGINT) FROM track WHERE z > 9.5")
def set_03_difference(track: DataFrame) -> DataFrame:
    cell = F.floor(F.col("x") / 10).alias("cx")
    return track.where("y < 50").select(cell).subtract(track.where("z > 9.5").select(cell))


@query("signal", "SELECT series, count(DISTINCT event_type) AS sources FROM signal GROUP BY series")
def set_04_sources(signal: DataFrame) -> DataFrame:
    return signal.groupBy("series").agg(F.count_distinct("event_type").alias("sources"))
