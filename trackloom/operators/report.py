"""AGG-20: all measures of a run in one row."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.scalars import predicted_fundamental
from trackloom.operators import aggregates as A
from trackloom.operators import predicates as P
from trackloom.operators import signal as S
from trackloom.operators import windows as O


def _renamed(df: DataFrame, run: str, **names: str) -> DataFrame:
    return df.select(run, *[F.col(old).alias(new) for new, old in names.items()])


def residual_memory(samples: DataFrame, run: str, order: list[str], value: str, rate: float, trend_s: float = 5.0, lag_s: float = 1.0) -> DataFrame:
    """(run, acf_1, lag): the autocorrelation at one row, and the first lag below 1/e, of ``value`` less its moving average.

    The average spans ``trend_s`` and lags reach to ``lag_s``, both told in rows by ``rate``.
    """
    width, most = max(3, round(trend_s * rate)), max(1, round(lag_s * rate))
    rows = samples.select(run, value, (F.row_number().over(W.partitionBy(run).orderBy(*order)) - 1).alias("_i"))
    acf = A.autocorrelation(O.detrended(rows, run, "_i", value, width), run, "_i", "residual", most)
    first = acf.where("lag = 1").select(run, F.col("acf").alias("acf_1"))
    return A.correlation_time(acf, run).join(first, run, "left")


def residual_memories(samples: DataFrame, run: str, order: list[str], values: dict[str, str], rate: float, trend_s: float = 5.0, lag_s: float = 1.0) -> tuple[DataFrame, dict[str, Column]]:
    """``residual_memory`` of several columns at once, by name: rows, and aggregates <name>_acf_1 and <name>_memory of their grouping by run, which others may share.

    Rows are sorted once for all columns; each lag is a column, so lags should be few.
    """
    width, most = max(3, round(trend_s * rate)), max(1, round(lag_s * rate))
    rows = samples.withColumn("_i", F.row_number().over(W.partitionBy(run).orderBy(*order)) - 1)
    for name, value in values.items():
        rows = O.detrended(rows, run, "_i", value, width, f"_r_{name}")
    whole, w, lags = W.partitionBy(run), W.partitionBy(run).orderBy("_i"), range(most + 1)
    rows = rows.withColumns({f"_x_{name}": F.col(f"_r_{name}") - F.avg(f"_r_{name}").over(whole) for name in values})
    rows = rows.withColumns({f"_p_{name}_{k}": F.col(f"_x_{name}") * F.lead(f"_x_{name}", k).over(w) for name in values for k in lags})
    out, n = {}, F.count("*")
    for name in values:
        flat = (n < 3) | (F.var_pop(f"_r_{name}") < 1e-12)
        acf = [F.sum(f"_p_{name}_{k}") / F.sum(f"_p_{name}_0") for k in lags]
        below = [F.when((acf[k] < math.exp(-1)) & (n > k), k) for k in lags]
        out[f"{name}_acf_1"] = F.when(flat, None).otherwise(acf[1])
        out[f"{name}_memory"] = F.when(flat, 1).otherwise(F.coalesce(*below, F.least(F.lit(most + 1), n))).cast("long")
    return rows, out


def fix_errors(errors: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """(run, <column>_mean, <column>_p95 ..) of fixes' errors; nulls take no part."""
    told = {c: A.summaries(F.col(c)) for c in columns}
    return errors.groupBy(run).agg(*[told[c][m].alias(f"{c}_{m}") for c in columns for m in ("mean", "p95")])


def run_report(
    samples: DataFrame, track: DataFrame, run: str, order: list[str], rate: float, lap_length: float, step_hz: float, bounce_m: Column | float,
    accel: DataFrame | None = None, baro: DataFrame | None = None, errors: DataFrame | None = None, availability: DataFrame | None = None, accel_rate: float = 100.0, baro_rate: float = 10.0, standing_start: bool = False,
    arcs: DataFrame | None = None,
) -> DataFrame:
    """One row a run of ``samples(run, time_s, speed, kappa_eff, offset_m, arc_s, standing, turning)``, of measures that are each grouped by run.

    Running speeds and turn rates as distributions, path ratio, length and duration of ``track(run, seq, x, y)``, memory of the speed and of the
    lateral offset, curvature of moving rows, laps by arc; of ``accel`` and ``baro(run, idx, value)`` the
    dominant line, that of the step and its harmonic, the bounce, and how the step's line compares with what ``bounce_m`` predicts; of
    ``errors(run, horizontal, vertical, speed)`` means and upper quantiles; ``availability(run, availability)``. What has no data is null.
    The laps take their times and arcs from ``arcs(run, time_s, arc_s)`` where that is given. What hangs on the samples alone is told in one
    grouping, by one sort of them; the measures' rows, one a run, meet in another.
    """
    rows, memory = residual_memories(samples, run, order, {"speed": "speed", "position": "offset_m"}, rate)
    moving = P.moving()
    speed, turn = A.summaries(F.when(P.running(), F.col("speed"))), A.summaries(F.when(moving, F.col("speed") * F.col("kappa_eff")))
    extent = {"duration_s": F.max("time_s") - F.min("time_s"), "max_speed": F.max("speed")}
    own = {f"speed_{c}": speed[c] for c in ("n", "mean", "std", "p05", "p50", "p95")} | {f"turn_{c}": turn[c] for c in ("mean", "std", "p95")} | {"mean_abs_curvature": F.avg(F.when(moving, F.abs("kappa_eff")))} | memory
    told = rows.groupBy(run).agg(*[c.alias(n) for n, c in (extent | own).items()])
    named = F.col(run).isNotNull()  # rows without a run have an extent, but meet no measure
    told = told.select(run, F.lit(True).alias("_run"), *extent, *[F.when(named, F.col(n)).alias(n) for n in own])
    laps = A.lap_times(samples if arcs is None else arcs, run, "arc_s", "time_s", lap_length)
    parts = [
        A.path_ratio(track, run).withColumnRenamed("ratio", "path_ratio"),
        laps.groupBy(run).agg(F.count("*").alias("laps"), F.avg("seconds").alias("lap_mean_s"), A.lap_cv(standing_start).alias("lap_cv")),
    ]
    if errors is not None:
        columns = ["horizontal", "vertical", "speed"]
        parts.append(fix_errors(errors, run, columns).select(run, *[F.col(f"{c}_{m}").alias(f"fix_{c}_{m}") for c in columns for m in ("mean", "p95")]))
    if availability is not None:
        parts.append(availability.select(run, "availability"))
    if accel is not None:
        lines = S.spectrum_summary(S.spectrum(accel, run, "idx", "value", accel_rate), run, step_hz)
        measured = lines.withColumn("bounce_consistency", F.col("step_magnitude") / predicted_fundamental(bounce_m if isinstance(bounce_m, Column) else F.lit(bounce_m), F.lit(step_hz)))
        parts.append(_renamed(measured, run, accel_dominant_hz="dominant_hz", accel_step="step_magnitude", accel_second="second_magnitude", bounce_consistency="bounce_consistency"))
    if baro is not None:
        parts.append(_renamed(S.spectrum_summary(S.spectrum(baro, run, "idx", "value", baro_rate), run, step_hz), run, baro_dominant_hz="dominant_hz", baro_bounce_m="step_magnitude"))
    met = functools.reduce(lambda a, b: a.unionByName(b.where(named), allowMissingColumns=True), parts, told)
    report = met.groupBy(run).agg(*[F.max(c).alias(c) for c in met.columns if c != run]).where("_run").drop("_run")
    return report.withColumn("length_m", F.coalesce("length_m", F.lit(0.0)))


def compared_runs(report: DataFrame, samples: DataFrame, pairs: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """JON-20: for each of ``pairs(a, b)`` of runs how much each of the report's ``columns`` is more for b, null unless both have it, and the Kolmogorov-Smirnov test of their running speeds.

    Pairs without a report of both are left out; a run without running speeds has statistic 1 and p-value 1.
    """
    one = report.select(F.col(run).alias("a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    two = report.select(F.col(run).alias("b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    delta = pairs.join(one, "a").join(two, "b").select("a", "b", *[(F.col(f"_b_{c}") - F.col(f"_a_{c}")).alias(f"{c}_delta") for c in columns])
    speeds = samples.where(P.running()).select(F.col(run).alias("_run"), "speed")
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("run"), F.lit(True).alias("is_a")), F.struct(F.col("b").alias("run"), F.lit(False).alias("is_a")))).alias("_s")).select("a", "b", F.col("_s.run").alias("_run"), F.col("_s.is_a").alias("_is_a"))
    test = A.ks_statistic(sides.join(speeds, "_run"), "speed", "_is_a", ["a", "b"])
    out = delta.join(test, ["a", "b"], "left").withColumns({"d": F.coalesce("d", F.lit(1.0)), "n_a": F.coalesce("n_a", F.lit(0)), "n_b": F.coalesce("n_b", F.lit(0))})
    return out.withColumn("p_value", A.ks_p_value("d", "n_a", "n_b"))


def recovered_turns(rates: DataFrame, truth: DataFrame, run: str, idx: str, rate: str, heading: str, hertz: float) -> DataFrame:
    """AGG-39: (run, turned, change, error): the yaw rate summed from the second row on over its rate, against the truth's last heading less its first."""
    first = F.min(idx).over(W.partitionBy(run))
    turned = rates.select(run, F.when(F.col(idx) > first, F.col(rate)).otherwise(0.0).alias("_r")).groupBy(run).agg((F.sum("_r") / hertz).alias("turned"))
    change = truth.groupBy(run).agg((F.max_by(heading, idx) - F.min_by(heading, idx)).alias("change"))
    return turned.join(change, run).withColumn("error", F.abs(F.col("turned") - F.col("change")))
