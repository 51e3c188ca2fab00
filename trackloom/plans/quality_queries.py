"""Queries of the data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import predicates as P
from trackloom.operators import quality as Q
from trackloom.plans.registry import q6, query, r6


@query("samples", "SELECT event_id FROM samples QUALIFY time_s <= lag(time_s) OVER (PARTITION BY run_id ORDER BY event_id)")
def dqc_01_time_order(samples: DataFrame) -> DataFrame:
    return Q.not_increasing(samples, ["run_id"], "time_s", "event_id").select("event_id")


@query("track", f"SELECT path_id, seq, {q6('sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))')} AS step FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq) QUALIFY step > 60")
def dqc_02_leaps(track: DataFrame) -> DataFrame:
    return Q.leaps(track, 60.0).select("path_id", "seq", r6("step").alias("step"))


@query("track", f"SELECT path_id, seq, {q6('sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (seq - lag(seq) OVER w)')} AS rate FROM track WINDOW w AS (PARTITION BY path_id ORDER BY seq) QUALIFY rate > z * 8 + 0.6 AND z > 2")
def dqc_03_too_fast(track: DataFrame) -> DataFrame:
    rows = track.withColumn("speed", F.col("z") * 8)
    return Q.too_fast(rows, "path_id", ["seq"], "seq", "speed", F.col("z") > 2, 0.6).select("path_id", "seq", r6("rate").alias("rate"))


@query(("track", "cells"), "SELECT path_id, seq FROM track LEFT JOIN cells ON cx = CAST(floor(x) AS BIGINT) AND cy = CAST(floor(y) AS BIGINT) WHERE coalesce(blocked, true)")
def dqc_04_off_ground(track: DataFrame, cells: DataFrame) -> DataFrame:
    return Q.off_ground(track, cells).select("path_id", "seq")


@query("task_events", ", c AS (SELECT task_id, count(*) FILTER (type = 'state') AS state, count(*) FILTER (type = 'stage') AS stage, count(*) FILTER (type = 'log') AS log FROM task_events GROUP BY task_id) SELECT task_id, state, stage FROM c WHERE state <> stage OR log = 0")
def dqc_05_counts(task_events: DataFrame) -> DataFrame:
    return Q.count_mismatches(task_events, "task_id", "type", ["state", "stage"], ["log"]).select("task_id", "state", "stage")


@query("track", "SELECT path_id, seq FROM track WHERE seq % 2 = 0 AND abs(sqrt(x * x + y * y + z * z) - 9.81) > 0.8 AND x < 20")
def dqc_06_restless(track: DataFrame) -> DataFrame:
    return Q.restless(track.withColumn("standing", (F.col("seq") % 2 == 0) & (F.col("x") < 20)), "standing", "x", "y", "z").select("path_id", "seq")


@query("samples", f", r AS (SELECT run_id, avg(speed) AS mean, max(speed) AS top FROM samples WHERE NOT standing AND NOT turning GROUP BY run_id), l AS (SELECT run_id, 'mean' AS name, mean AS value, 4.5 AS lo, 5.5 AS hi FROM r UNION ALL SELECT run_id, 'top', top, 0, 9.7 FROM r) SELECT run_id, name, {q6('value')} AS value FROM l WHERE value NOT BETWEEN lo AND hi")
def dqc_07_bands(samples: DataFrame) -> DataFrame:
    report = samples.where(P.moving()).groupBy("run_id").agg(F.avg("speed").alias("mean"), F.max("speed").alias("top"))
    return Q.out_of_band(report, "run_id", {"mean": (4.5, 5.5), "top": (0.0, 9.7)}).select("run_id", "name", r6("value").alias("value"))


@query("candidates", ", p AS (SELECT od, idx, count(*) AS n FROM candidates WHERE idx % 3 <> 1 GROUP BY od, idx) SELECT od, idx FROM candidates LEFT JOIN p USING (od, idx) WHERE coalesce(n, 0) < 1 OR cost_equiv_m > 90")
def dqc_08_candidates(candidates: DataFrame) -> DataFrame:
    points = candidates.where("idx % 3 <> 1").select("od", "idx", F.explode(F.array(F.lit(1), F.lit(2))))
    costs = candidates.withColumn("cost", F.when(F.col("cost_equiv_m") > 90, float("inf")).otherwise(F.col("cost_equiv_m")))
    return Q.broken_candidates(points, costs, ["od", "idx"], "cost")


@query(("orders", "customer"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def dqc_09_dangling(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return Q.dangling(orders, customer.where("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("customer", "SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS value FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 9000 UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey NOT BETWEEN 1 AND 20")
def dqc_10_parameters(customer: DataFrame) -> DataFrame:
    report = customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return Q.out_of_band(report, "c_custkey", {"c_acctbal": (0.0, 9000.0), "nation": (1.0, 20.0)})
