"""Summaries, tests and fits over groups of rows."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.sources.shared import settled


def finite(value) -> Column:
    """PRJ-03"""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def distribution(df: DataFrame, keys: list[str], value: str, parts: int = 0, held: int = 1_000_000) -> DataFrame:
    """AGG-01: count, mean, population std, min, p05, p50, p95, max by linear rank; no rows of a group or no keys and no rows give zeros.

    A group's distinct values are held by one task, unless ``parts`` splits them (``exact_quantiles``). Only
    groups of more than ``held`` values pay for that: a job counts them first, and the values of all others are
    ordered as they are. Both ways give the same quantiles.
    """
    v, wanted = F.col(value), [0.05, 0.5, 0.95]
    plain = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}

    def at_once(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in plain.items()], F.percentile(v, F.array(*map(F.lit, wanted))).alias("q"))

    def selected(rows: DataFrame) -> DataFrame:
        own = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in plain.items()]).withColumn("_k", F.struct(F.lit(0), *keys))
        return own.join(exact_quantiles(rows.select(F.struct(F.lit(0), *keys).alias("_k"), v.alias("_v")), "_k", "_v", wanted, parts), "_k", "left").drop("_k")

    big = df.groupBy(*keys).agg(F.count(v).alias("_n")).where(F.col("_n") > held).select(*[F.col(k).alias(f"_big_{k}") for k in keys])
    if not parts or big.limit(1).count() == 0:
        out = at_once(df)
    elif not keys:
        out = selected(df)
    else:
        big = settled(big, "large")
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_big_{k}")) for k in keys])
        out = at_once(df.join(big, same, "left_anti")).unionByName(selected(df.join(big, same, "left_semi")))
    zero = F.lit(0.0)
    return out.select(*keys, "n", *[F.coalesce(c, zero).alias(n) for c, n in ((F.col("mean"), "mean"), (F.col("std"), "std"), (F.col("min"), "min"), (F.col("q")[0], "p05"), (F.col("q")[1], "p50"), (F.col("q")[2], "p95"), (F.col("max"), "max"))])


def summaries(value: Column) -> dict[str, Column]:
    """AGG-01 as aggregates that may share a grouping: n, mean, std, p05, p50 and p95 of the values that are not null, all null without any."""
    n, q = F.count(value), F.percentile(value, F.array(*map(F.lit, [0.05, 0.5, 0.95])))
    return {"n": F.when(n > 0, n), "mean": F.avg(value), "std": F.stddev_pop(value), "p05": q[0], "p50": q[1], "p95": q[2]}


def exact_quantiles(df: DataFrame, key: str, value: str, wanted: list[float], parts: int) -> DataFrame:
    """AGG-01: (key, q) with the quantiles of each key by linear rank, nulls left out, by selection: no task holds a key's values.

    Equal values are counted first. Approximate cuts deal a key's distinct values to ``parts`` ranges, sums
    over the ranges tell which of them hold the ranks wanted, and only those are ordered. Cuts decide how
    even the ranges are, never the result.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = counted.groupBy(key).agg(F.percentile_approx("_v", [i / parts for i in range(1, max(parts, 2))], 1000).alias("_cuts"))
    placed = counted.join(cuts, key).select(key, "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part"))
    upto, whole = W.partitionBy(key).orderBy("_part"), W.partitionBy(key)
    sums = placed.groupBy(key, "_part").agg(F.sum("_c").alias("_s"))
    sums = sums.select(key, "_part", F.sum("_s").over(whole).alias("_n"), F.sum("_s").over(upto).alias("_end"), (F.sum("_s").over(upto) - F.col("_s")).alias("_below"))
    ranks = [(F.col("_n") - 1) * p for p in wanted]
    ends = [(F.floor(r), F.ceil(r)) for r in ranks]
    held = [(r >= F.col("_below")) & (r < F.col("_end")) for pair in ends for r in pair]
    chosen = sums.where(F.exists(F.array(*held), lambda h: h)).drop("_end")
    running = F.sum("_c").over(W.partitionBy(key, "_part").orderBy("_v")) + F.col("_below")
    rows = placed.join(chosen, [key, "_part"]).withColumn("_end", running).withColumn("_below", F.col("_end") - F.col("_c"))
    at = [F.max(F.when((r >= F.col("_below")) & (r < F.col("_end")), F.col("_v"))) for pair in ends for r in pair]
    found = rows.groupBy(key).agg(F.array(*at).alias("_at"), F.max("_n").alias("_n"))
    between = [F.when(r == low, F.col("_at")[2 * i]).otherwise((high - r) * F.col("_at")[2 * i] + (r - low) * F.col("_at")[2 * i + 1]) for i, (r, (low, high)) in enumerate(zip(ranks, ends))]
    return found.select(key, F.array(*between).alias("q"))


def variation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-02: std over mean, 0 for a mean near 0."""
    mean = F.avg(value)
    return df.groupBy(*keys).agg(F.when(F.abs(mean) < 1e-9, 0.0).otherwise(F.stddev_pop(value) / F.abs(mean)).alias("cv"))


def ks_statistic(df: DataFrame, value: str, is_a: str, keys: list[str] = (), buckets: int = 0) -> DataFrame:
    """AGG-03: largest gap of two samples' distributions, ties together, non-finite values dropped; 1 if a side is empty.

    Equal values are counted first. With ``buckets`` the running counts of one huge pair are split:
    sums of value ranges are carried into the ranges above, so no task holds all values.
    """
    keys = list(keys)
    counted = df.where(finite(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(is_a).alias("_a"), F.count_if(~F.col(is_a)).alias("_b"))
    if buckets > 1:
        cuts = counted.agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()["c"] or []
        part = F.lit(0)
        for c in cuts:
            part = part + (F.col("_v") > c).cast("int")
        counted = counted.withColumn("_part", part)
        sums = counted.groupBy(*keys, "_part").agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"))
        before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*keys)
        sums = sums.select(*keys, "_part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}0") for s in ("_sa", "_sb")], F.sum("_sa").over(whole).alias("_na"), F.sum("_sb").over(whole).alias("_nb"))
        counted = counted.join(F.broadcast(sums) if not keys else sums, [*keys, "_part"])
        upto = W.partitionBy(*keys, "_part").orderBy("_v")
        steps = counted.select(*keys, "_na", "_nb", (F.col("_sa0") + F.sum("_a").over(upto)).alias("_ca"), (F.col("_sb0") + F.sum("_b").over(upto)).alias("_cb"))
    else:
        upto, whole = W.partitionBy(*keys).orderBy("_v"), W.partitionBy(*keys)
        steps = counted.select(*keys, F.sum("_a").over(upto).alias("_ca"), F.sum("_b").over(upto).alias("_cb"), F.sum("_a").over(whole).alias("_na"), F.sum("_b").over(whole).alias("_nb"))
    gap = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb"))).otherwise(1.0)
    return steps.groupBy(*keys).agg(F.coalesce(F.max(gap), F.lit(1.0)).alias("d"), F.coalesce(F.max("_na"), F.lit(0)).alias("n_a"), F.coalesce(F.max("_nb"), F.lit(0)).alias("n_b"))


def ks_p_value(d, n_a, n_b) -> Column:
    """AGG-04: by the theta series below lambda 1 and the alternating one above, within [0, 1]."""
    d, n_a, n_b = F.col(d), F.col(n_a).cast("double"), F.col(n_b).cast("double")
    root = F.sqrt(n_a * n_b / (n_a + n_b))
    lam = (root + 0.12 + 0.11 / root) * d
    k = F.sequence(F.lit(1), F.lit(100))
    low = F.aggregate(k, F.lit(0.0), lambda s, i: s + F.exp(-(2 * i - 1) * (2 * i - 1) * (math.pi**2) / (8.0 * lam * lam)))
    high = F.aggregate(k, F.lit(0.0), lambda s, i: s + F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * lam * lam))
    p = F.when(lam < 1, 1.0 - math.sqrt(2 * math.pi) / lam * low).otherwise(2.0 * high)
    return F.when((n_a == 0) | (n_b == 0) | (lam <= 0), 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def autocorrelation(df: DataFrame, series: str, idx: str, value: str, max_lag: int, block: int = 4096) -> DataFrame:
    """AGG-05: (series, lag, acf) for lags 0 to ``max_lag`` (below the length), all divided by the sum at lag 0.

    Under 3 rows or variance under 1e-12 only lag 0 is given, as 1. A series is read in blocks of
    ``block`` indices, or of ``max_lag`` if that is more, each with the first ``max_lag`` rows of the next one,
    so that a row is shuffled once or twice and products are summed where they are formed.
    """
    size = max(block, max_lag, 1)
    whole = df.groupBy(series).agg(F.avg(value).alias("_mean"), F.count("*").alias("_n"), F.var_pop(value).alias("_var"))
    flat = (F.col("_n") < 3) | (F.col("_var") < 1e-12)
    base = df.select(series, F.col(idx).cast("long").alias("_i"), F.col(value).alias("_v")).join(whole, series)
    base = base.select(series, "_i", (F.col("_v") - F.col("_mean")).alias("_x"), flat.alias("_flat"), F.when(flat, 0).otherwise(F.least(F.lit(max_lag), F.col("_n") - 1)).alias("_most"), F.floor(F.col("_i") / size).alias("_own"))
    spread = base.withColumn("_block", F.explode(F.when(F.col("_i") - F.col("_own") * size < max_lag, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))))
    ahead = F.collect_list(F.struct("_i", "_x")).over(W.partitionBy(series, "_block").orderBy("_i").rangeBetween(0, max_lag))
    pairs = spread.withColumn("_a", ahead).where("_block = _own").select(series, "_i", "_x", "_flat", "_most", F.explode("_a").alias("_a"))
    lag = (F.col("_a._i") - F.col("_i")).cast("int")
    sums = pairs.where(lag <= F.col("_most")).groupBy(series, lag.alias("lag")).agg(F.sum(F.col("_x") * F.col("_a._x")).alias("_s"), F.first("_flat").alias("_flat"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(W.partitionBy(series))
    return sums.select(series, "lag", F.when(F.col("_flat"), 1.0).otherwise(F.col("_s") / zero).alias("acf"))


def correlation_time(acf: DataFrame, series: str) -> DataFrame:
    """AGG-06: first lag below 1/e, else the number of lags."""
    return acf.groupBy(series).agg(F.coalesce(F.min(F.when(F.col("acf") < math.exp(-1), F.col("lag").cast("long"))), F.count("*")).alias("lag"))


def path_ratio(track: DataFrame, path: str) -> DataFrame:
    """AGG-09: length over the distance of the ends; a closed loop (ends within 1 m) uses twice its reach from the start."""
    w = W.partitionBy(path).orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    first = F.first(F.struct("x", "y")).over(w)
    rows = track.select(path, "seq", "x", "y", step.alias("_s"), F.hypot(F.col("x") - first["x"], F.col("y") - first["y"]).alias("_r"))
    got = rows.groupBy(path).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length_m"), F.max_by("_r", "seq").alias("_end"), F.max("_r").alias("_reach"))
    base = F.when(F.col("_end") < 1.0, 2 * F.col("_reach")).otherwise(F.col("_end"))
    return got.select(path, "length_m", F.when(base > 1e-9, F.col("length_m") / base).otherwise(1.0).alias("ratio"))


def run_extent(samples: DataFrame, track: DataFrame, run: str, path: str, time: str = "time_s", speed: str = "speed") -> DataFrame:
    """AGG-32: duration_s, max_speed and length_m of each run; the path's vertices are in order of seq."""
    step = F.hypot(*[F.col(c) - F.lag(c).over(W.partitionBy(path).orderBy("seq")) for c in "xy"])
    length = track.select(F.col(path).alias(run), step.alias("_s")).groupBy(run).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length_m"))
    own = samples.groupBy(run).agg((F.max(time) - F.min(time)).alias("duration_s"), F.max(speed).alias("max_speed"))
    return own.join(length, run, "left").select(run, "duration_s", "max_speed", F.coalesce("length_m", F.lit(0.0)).alias("length_m"))


def lap_times(df: DataFrame, run: str, arc: str, time: str, lap_length: float) -> DataFrame:
    """AGG-10: (run, lap, seconds) from the first sample in each lap to the next lap's, the last to the run's end; laps without samples are skipped."""
    total = F.max(arc).over(W.partitionBy(run))
    last = F.greatest(F.floor(total / lap_length), F.lit(1).cast("long")) - 1
    rows = df.select(run, F.col(time).alias("_t"), F.least(F.floor(F.col(arc) / lap_length), last).alias("lap"))
    laps = rows.groupBy(run, "lap").agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    end = F.max("_t1").over(W.partitionBy(run))
    return laps.select(run, "lap", (F.coalesce(F.lead("_t0").over(W.partitionBy(run).orderBy("lap")), end) - F.col("_t0")).alias("seconds"))


def lap_variation(laps: DataFrame, run: str, standing_start: bool = False) -> DataFrame:
    """AGG-11: variation of lap times, null for under two laps; a standing start drops the first lap."""
    used = laps.where("lap > 0") if standing_start else laps
    return used.groupBy(run).agg(lap_cv().alias("cv"))


def lap_cv(standing_start: bool = False) -> Column:
    """AGG-11 as an aggregate of ``laps(lap, seconds)``."""
    used = F.col("lap") > 0 if standing_start else F.lit(True)
    seconds = F.when(used, F.col("seconds"))
    mean = F.avg(seconds)
    return F.when(F.count_if(used) >= 2, F.when(F.abs(mean) < 1e-9, 0.0).otherwise(F.stddev_pop(seconds) / F.abs(mean)))


def availability(fixes: DataFrame, gaps: DataFrame, run: str) -> DataFrame:
    """AGG-12: fixes over fixes and missing epochs of 1 s; a point gap is one epoch, none at all gives 1."""
    span = F.col("to_s") - F.col("from_s")
    missing = gaps.groupBy(run).agg(F.sum(F.when(span <= 0, F.lit(1).cast("long")).otherwise(F.round(span).cast("long") + 1)).alias("_missing"))
    had = fixes.groupBy(run).agg(F.count("*").alias("_had"))
    both = had.join(missing, run, "full").select(run, F.coalesce("_had", F.lit(0)).alias("_had"), F.coalesce("_missing", F.lit(0)).alias("_missing"))
    total = F.col("_had") + F.col("_missing")
    return both.select(run, F.when(total == 0, 1.0).otherwise(F.col("_had") / total).alias("availability"))


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str, least_rows: int = 3, for_chart: bool = False) -> DataFrame:
    """AGG-13, AGG-14: slope, intercept and r2 within [0, 1].

    The statistic needs ``least_rows`` rows and variance in x, else it is null, and takes r2 = 1 for
    a constant y; the chart form takes two rows, a level line for a constant x and r2 = 0 for a constant y.
    """
    n, vx, vy, cov = F.count("*"), F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(n.alias("n"), vx.alias("_vx"), vy.alias("_vy"), cov.alias("_c"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    level, flat = F.col("_vx") <= 1e-12, F.col("_vy") <= 1e-12
    slope = F.col("_c") / F.col("_vx")
    r2 = F.least(F.greatest(F.col("_c") * F.col("_c") / (F.col("_vx") * F.col("_vy")), F.lit(0.0)), F.lit(1.0))
    if for_chart:
        ok = F.col("n") >= 2
        slope = F.when(ok, F.when(level, 0.0).otherwise(slope))
        return got.select(*keys, "n", slope.alias("slope"), F.when(ok, F.col("_my") - slope * F.col("_mx")).alias("intercept"), F.when(ok, F.when(flat | level, 0.0).otherwise(r2)).alias("r2"))
    ok = (F.col("n") >= least_rows) & ~level
    return got.select(*keys, "n", F.when(ok, slope).alias("slope"), F.when(ok, F.col("_my") - slope * F.col("_mx")).alias("intercept"), F.when(ok, F.when(flat, 1.0).otherwise(r2)).alias("r2"))


def choice_frequencies(choices: DataFrame, chosen: str, k: int) -> DataFrame:
    """AGG-16: share of each index below ``k`` in all choices, also those out of range; 0 for unused ones."""
    counts = choices.groupBy(F.col(chosen).alias("idx")).count()
    total = counts.agg(F.sum("count").alias("_total"))
    spine = choices.sparkSession.range(k).withColumnRenamed("id", "idx")
    return spine.join(counts, "idx", "left").crossJoin(F.broadcast(total)).select("idx", F.coalesce(F.col("count") / F.col("_total"), F.lit(0.0)).alias("share"))


def choice_shares(choices: DataFrame, chosen: str) -> DataFrame:
    """AGG-17: share of each index seen."""
    counts = choices.groupBy(F.col(chosen).alias("idx")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("idx", "n", (F.col("n") / F.col("_total")).alias("share"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """AGG-21: counts in equal bins of [low, high); values outside and non-finite ones are left out."""
    at = F.floor((F.col(value) - low) * bins / (high - low))
    counts = df.where(finite(value) & (F.col(value) >= low) & (F.col(value) < high)).groupBy(F.least(at, F.lit(bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def auto_histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """AGG-22: bins from least to largest, the top edge in the last; a constant sample has width 1; with densities."""
    kept = df.where(finite(value))
    range_ = kept.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    joined = kept.join(range_, keys) if keys else kept.crossJoin(F.broadcast(range_))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1).cast("long"))
    return joined.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), (F.count("*") / (F.first("_n") * F.first(width))).alias("density"))


def extent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-23: least and largest finite value, 0 and 0 for none."""
    v = F.when(finite(value), F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(F.max(v), F.lit(0.0)).alias("high"))


def combined_loss(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """AGG-30: chance that any of the independent losses strikes."""
    return df.groupBy(*keys).agg((1 - F.product(1 - F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)))).alias("p_loss"))


def gait_axis(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """AGG-31: number of the axis with the largest variance, the first of equals."""
    spread = [F.var_pop(a) for a in axes]
    top = F.greatest(*spread)
    pick = F.when(spread[0] == top, 0)
    for i, s in enumerate(spread[1:], 1):
        pick = pick.when(s == top, i)
    return df.groupBy(*keys).agg(pick.alias("axis"))
