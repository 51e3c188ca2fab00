"""Queries of the ordered operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import windows as O
from trackloom.plans.registry import q4, q6, query, r4, r6

_STEP = "coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0)"


@query("track", f", s AS (SELECT *, {_STEP} AS step FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, seq, {q4('sum(step) OVER (PARTITION BY path_id ORDER BY seq)')} AS arc FROM s")
def win_01_arc_length(track: DataFrame) -> DataFrame:
    return O.arc_lengths(track).select("path_id", "seq", r4("arc").alias("arc"))


@query("track", f"""
, n AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS bb FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
l AS (SELECT *, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS a, sqrt(pow(bx - x, 2) + pow(bb - y, 2)) AS b, sqrt(pow(bx - ax, 2) + pow(bb - ay, 2)) AS c FROM n),
k AS (SELECT *, CASE WHEN ax IS NULL OR bx IS NULL THEN NULL WHEN a < 1e-3 OR b < 1e-3 OR c < 1e-3 THEN 0 ELSE least(greatest(2 * ((x - ax) * (bb - y) - (y - ay) * (bx - x)) / (a * b * c), -5), 5) END AS k FROM l)
SELECT path_id, seq, {q6('coalesce(k, lead(k) OVER w, lag(k) OVER w, 0)')} AS kappa FROM k WINDOW w AS (PARTITION BY path_id ORDER BY seq)""")
def win_02_curvature(track: DataFrame) -> DataFrame:
    return O.curvatures(track).select("path_id", "seq", r6("kappa").alias("kappa"))


@query("track", f"""
, n AS (SELECT *, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT path_id, {q6('max(abs(atan2(ux * vy - uy * vx, ux * vx + uy * vy)))')} AS sharpest FROM n GROUP BY path_id""")
def win_03_turn_angle(track: DataFrame) -> DataFrame:
    return O.turn_angles(track).groupBy("path_id").agg(r6(F.max(F.abs("turn"))).alias("sharpest"))


_KEPT = ", k AS (SELECT path_id, seq, x AS kx, y AS ky, true AS kept FROM track WHERE seq = 0 UNION ALL SELECT t.path_id, t.seq, CASE WHEN sqrt(pow(t.x - kx, 2) + pow(t.y - ky, 2)) > 30 THEN t.x ELSE kx END, CASE WHEN sqrt(pow(t.x - kx, 2) + pow(t.y - ky, 2)) > 30 THEN t.y ELSE ky END, sqrt(pow(t.x - kx, 2) + pow(t.y - ky, 2)) > 30 FROM k JOIN track t ON t.path_id = k.path_id AND t.seq = k.seq + 1)"


@query("track", _KEPT + " SELECT path_id, seq, x, y FROM track JOIN k USING (path_id, seq) WHERE kept")
def win_04_deduplicate(track: DataFrame) -> DataFrame:
    return O.deduplicate(track, 30.0).select("path_id", "seq", "x", "y")


@query("track", _KEPT + " SELECT path_id, seq, z, z / 2 AS link_speed FROM track JOIN k USING (path_id, seq) WHERE kept")
def win_05_deduplicate_channels(track: DataFrame) -> DataFrame:
    return O.deduplicate(track.withColumn("link_speed", F.col("z") / 2), 30.0).select("path_id", "seq", "z", "link_speed")


def _average_sql(width: int) -> str:
    low, high = width // 2, width - width // 2
    return f""", n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM signal),
c AS (SELECT series, idx, event_id, value, CASE WHEN n <= {width} THEN 0 ELSE least(greatest(idx, {low}), n - {high}) - {low} END AS a, CASE WHEN n <= {width} THEN n ELSE least(greatest(idx, {low}), n - {high}) + {high} END AS b FROM n),
m AS (SELECT c.event_id, any_value(c.value) AS value, avg(s.value) AS smooth FROM c JOIN signal s ON s.series = c.series AND s.idx >= c.a AND s.idx < c.b GROUP BY c.event_id)"""


@query("signal", _average_sql(4) + f" SELECT event_id, {q6('smooth')} AS smooth FROM m")
def win_06_moving_average(signal: DataFrame) -> DataFrame:
    return O.moving_average(signal, "series", "idx", "value", 4).select("event_id", r6("smooth").alias("smooth"))


@query("signal", _average_sql(5) + f" SELECT event_id, {q6('value - smooth')} AS residual FROM m")
def win_07_residual(signal: DataFrame) -> DataFrame:
    return O.detrended(signal, "series", "idx", "value", 5).select("event_id", r6("residual").alias("residual"))


@query("signal", f"SELECT event_id, {q6('coalesce((lead(value) OVER w - lag(value) OVER w) / 0.02, (lead(value) OVER w - value) / 0.01, (value - lag(value) OVER w) / 0.01, 0)')} AS rate FROM signal WINDOW w AS (PARTITION BY series ORDER BY idx)")
def win_08_derivative(signal: DataFrame) -> DataFrame:
    return O.differentiate(signal, "series", "idx", "value", 0.01).select("event_id", r6("rate").alias("rate"))


def _second(i: int, j: int, k: int) -> str:
    def at(c: str, n: int) -> str:
        return c if n == 0 else f"lag({c}, {-n}) OVER w" if n < 0 else f"lead({c}, {n}) OVER w"

    t, v = [at("idx2", n) for n in (i, j, k)], [at("value", n) for n in (i, j, k)]
    return f"2 * (({v[2]} - {v[1]}) / ({t[2]} - {t[1]}) - ({v[1]} - {v[0]}) / ({t[1]} - {t[0]})) / ({t[2]} - {t[0]})"


@query("signal", f", u AS (SELECT *, idx + (idx % 3) * 0.2 AS idx2 FROM signal) SELECT event_id, {q6(f'coalesce({_second(-1, 0, 1)}, {_second(0, 1, 2)}, {_second(-2, -1, 0)}, 0)')} AS acceleration FROM u WINDOW w AS (PARTITION BY series ORDER BY idx2)")
def win_09_acceleration(signal: DataFrame) -> DataFrame:
    uneven = signal.withColumn("t", F.col("idx") + (F.col("idx") % 3) * 0.2)
    return O.second_differences(uneven, "series", "t", "value").select("event_id", r6("acceleration").alias("acceleration"))


@query("signal", f", t AS (SELECT *, coalesce(-round((value - lag(value) OVER w) / {2 * math.pi!r}), 0) AS turns FROM signal WINDOW w AS (PARTITION BY series ORDER BY idx)) SELECT event_id, {q6(f'value + {2 * math.pi!r} * sum(turns) OVER (PARTITION BY series ORDER BY idx)')} AS unwrapped FROM t")
def win_10_unwrap(signal: DataFrame) -> DataFrame:
    return O.unwrap(signal, "series", "idx", "value").select("event_id", r6("unwrapped").alias("unwrapped"))


@query("signal", f"SELECT a.event_id, {q6('sum(CASE WHEN b.idx = 0 THEN pow(0.8, a.idx) * b.value ELSE 0.2 * pow(0.8, a.idx - b.idx) * b.value END)')} AS low FROM signal a JOIN signal b ON b.series = a.series AND b.idx <= a.idx GROUP BY a.event_id")
def win_11_low_pass(signal: DataFrame) -> DataFrame:
    rows = signal.select("series", "idx", "event_id", "value")
    return O.low_pass(rows, "series", "idx", "value", 0.1, 0.5).select("event_id", r6("low").alias("low"))


@query("samples", ", d AS (SELECT run_id, CAST(floor(time_s / 86400) AS BIGINT) AS d, standing FROM samples), e AS (SELECT DISTINCT run_id, d FROM d WHERE NOT standing UNION SELECT run_id, min(d) - 4 FROM d GROUP BY run_id UNION SELECT run_id, max(d) + 3 FROM d GROUP BY run_id), n AS (SELECT run_id, d, lead(d) OVER (PARTITION BY run_id ORDER BY d) AS nx FROM e) SELECT run_id, d + 1 AS from_s, nx - 1 AS to_s FROM n WHERE nx > d + 1")
def win_12_gaps(samples: DataFrame) -> DataFrame:
    """Days without a sample that moves, from three days before a run's first sample to two after its last."""
    days = samples.withColumn("d", F.floor(F.col("time_s") / 86400))
    runs = days.groupBy("run_id").agg((F.min("d") - 3).alias("first"), (F.max("d") + 2).alias("last"))
    return O.gaps(days.where("not standing"), "run_id", "d", runs)


@query("samples", ", f AS (SELECT *, speed > 5 AS fast FROM samples), e AS (SELECT *, fast AND NOT coalesce(lag(fast) OVER (PARTITION BY run_id ORDER BY time_s, event_id), false) AS enters FROM f) SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY time_s, event_id) - 1 AS entry FROM e WHERE enters")
def win_13_entries(samples: DataFrame) -> DataFrame:
    return O.entries(samples.withColumn("fast", F.col("speed") > 5), ["run_id"], ["time_s", "event_id"], "fast").select("run_id", "event_id", "entry")


@query("task_events", "SELECT task_id, event_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY at_ms DESC, event_id DESC) AS INTEGER) AS place FROM task_events")
def win_14_newest_first(task_events: DataFrame) -> DataFrame:
    return O.newest_first(task_events, ["task_id"], "at_ms", "event_id").select("task_id", "event_id", "place")


@query("task_events", "SELECT event_id FROM task_events QUALIFY type NOT IN ('done', 'error') OR row_number() OVER (PARTITION BY task_id, type IN ('done', 'error') ORDER BY at_ms DESC, event_id DESC) <= 3")
def win_15_retention(task_events: DataFrame) -> DataFrame:
    return O.retained(task_events, ["task_id"], "at_ms", "event_id", F.col("type").isin("done", "error"), 3).select("event_id")


@query("candidates")
def win_16_draw(candidates: DataFrame) -> DataFrame:
    return O.drawn(candidates, "od", "idx", "path_size", 7)


@query("track", f", s AS (SELECT *, {_STEP} AS step FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, seq, {q6('coalesce(CASE WHEN lead(step) OVER w > 0 THEN (lead(z) OVER w - z) / lead(step) OVER w END, 0)')} AS grade FROM s WINDOW w AS (PARTITION BY path_id ORDER BY seq)")
def win_18_grade(track: DataFrame) -> DataFrame:
    return O.grades(track).select("path_id", "seq", r6("grade").alias("grade"))


_D = f"(value / 50 - lag(value / 50) OVER w + {math.pi!r})"


@query("signal", f"SELECT event_id, {q6(f'coalesce(({_D} - floor({_D} / {2 * math.pi!r}) * {2 * math.pi!r} - {math.pi!r}) / (idx - lag(idx) OVER w), 0)')} AS rate FROM signal WINDOW w AS (PARTITION BY series ORDER BY idx)")
def win_19_turn_rate(signal: DataFrame) -> DataFrame:
    return O.turn_rates(signal.withColumn("yaw", F.col("value") / 50), "series", "idx", "yaw").select("event_id", r6("rate").alias("rate"))


@query("samples", "SELECT event_id, bool_and(NOT standing AND NOT turning AND speed > 0.5) OVER (PARTITION BY run_id ORDER BY time_s, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS settled FROM samples")
def win_20_settled(samples: DataFrame) -> DataFrame:
    good = ~F.col("standing") & ~F.col("turning") & (F.col("speed") > 0.5)
    return O.settled(samples, "run_id", ["time_s", "event_id"], good, 2, 1).select("event_id", "settled")


@query("signal", "SELECT event_id FROM signal WINDOW w AS (PARTITION BY series ORDER BY idx) QUALIFY value >= lag(value) OVER w AND value >= lead(value) OVER w AND idx >= 2")
def win_21_local_maxima(signal: DataFrame) -> DataFrame:
    return O.local_maxima(signal, "series", "idx", "value", 2).select("event_id")


@query("task_events", "SELECT event_id, lead(at_ms) OVER (PARTITION BY task_id ORDER BY at_ms, event_id) - at_ms AS duration_ms FROM task_events")
def win_22_stage_durations(task_events: DataFrame) -> DataFrame:
    return O.stage_durations(task_events, "task_id", "at_ms", "event_id").select("event_id", "duration_ms")
