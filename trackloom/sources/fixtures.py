"""Views of the driver tables as runs, tracks, rasters, regions and routes, in Spark SQL and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name: (text for both engines, or for Spark; text for DuckDB where it differs)
VIEWS: dict[str, tuple[str, ...]] = {
    "signal": ("SELECT user_id AS series, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, ts, event_id, event_type, value FROM events",),
    "track": ("SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, (event_id * 7919) % 1000 / 1e1 AS x, (event_id * 104729) % 1000 / 1e1 AS y, (event_id * 31) % 100 / 1e1 AS z FROM events",),
    "samples": (
        "SELECT user_id AS run_id, unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS time_s, event_id, value / 5e1 AS speed, (event_id % 21 - 10) / 1e2 AS kappa_eff, event_type = 'signup' AS standing, event_type = 'error' AS turning FROM events",
        "SELECT user_id AS run_id, epoch_us(ts) / 1e6 AS time_s, event_id, value / 5e1 AS speed, (event_id % 21 - 10) / 1e2 AS kappa_eff, event_type = 'signup' AS standing, event_type = 'error' AS turning FROM events",
    ),
    "cells": (
        "SELECT vec_id AS cy, CAST(cx AS BIGINT) AS cx, CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) > 2e-1 AS blocked FROM embeddings LATERAL VIEW posexplode(embedding) e AS cx, v",
        "SELECT cy, cx, CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) > 2e-1 AS blocked FROM (SELECT vec_id AS cy, generate_subscripts(embedding, 1) - 1 AS cx, unnest(embedding) AS v FROM embeddings)",
    ),
    "polys": ("SELECT s_suppkey AS region_id, (s_suppkey * 37) % 80 / 1e0 AS x0, (s_suppkey * 53) % 80 / 1e0 AS y0, 2e1 AS side, s_suppkey % 2 AS triangle, (s_suppkey % 10) / 1e1 AS p_loss FROM supplier",),
    "candidates": ("SELECT l_orderkey AS od, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS idx, l_extendedprice / 1e3 AS cost_equiv_m, l_quantity * 1e1 AS length_m, 1e0 / l_linenumber AS path_size FROM lineitem",),
    "geo": ("SELECT c_custkey AS id, 106e0 + c_custkey % 1000 / 1e4 AS lon, 29e0 + c_nationkey / 1e2 AS lat FROM customer",),
    "tags": ("SELECT p_partkey AS way_id, CASE p_partkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'steps' WHEN 4 THEN 'track' END AS highway, CASE p_partkey % 5 WHEN 0 THEN 'gravel' WHEN 1 THEN 'asphalt' WHEN 2 THEN 'tartan' END AS surface, CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lit, concat(CAST(p_size AS STRING), ' m') AS width FROM part",),
    "task_events": (
        "SELECT user_id AS task_id, unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms, event_id, CASE event_type WHEN 'view' THEN 'state' WHEN 'click' THEN 'stage' WHEN 'purchase' THEN 'log' WHEN 'signup' THEN 'done' ELSE 'error' END AS type FROM events",
        "SELECT user_id AS task_id, epoch_us(ts) // 1000 AS at_ms, event_id, CASE event_type WHEN 'view' THEN 'state' WHEN 'click' THEN 'stage' WHEN 'purchase' THEN 'log' WHEN 'signup' THEN 'done' ELSE 'error' END AS type FROM events",
    ),
}
_TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view of them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name][0]
    used = [t for t in _TABLES if re.search(rf"\bFROM {t}\b", text)]
    return spark.sql(re.sub(r"\bFROM (\w+)", r"FROM {\1}", text), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(body: str) -> str:
    """``body`` (a SELECT, or further CTEs that begin with a comma) after the views that it names."""
    used = [f"{name} AS ({texts[-1]})" for name, texts in VIEWS.items() if re.search(rf"\b{name}\b", body)]
    body = body.strip()
    if body.startswith(","):
        return "WITH RECURSIVE " + ", ".join([*used, body[1:]])
    return ("WITH " + ", ".join(used) + " " if used else "") + body
