"""Queries of readers and sinks on views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.registry import query, r6
from trackloom.sources import readers as R
from trackloom.sources import writers as S


@query("signal", "SELECT event_id FROM signal WHERE idx < 20 AND series IN (SELECT DISTINCT series FROM signal ORDER BY series LIMIT 30)")
def src_09_capped(signal: DataFrame) -> DataFrame:
    return R.capped(signal, "series", "idx", 20, 30).select("event_id")


_TEXTS = ", ".join(f"printf('%.{n}f', {e}) AS {c}" for c, e, n in (("time_s", "time_s", 3), ("z", "speed", 4), ("terrain_z", "CAST(0.5 AS DOUBLE)", 4), ("bounce_z", "speed - 0.5", 5), ("speed", "speed", 4), ("kappa_eff", "kappa_eff", 6)))


@query("samples", f"SELECT {_TEXTS}, CAST(CAST(standing AS INTEGER) AS VARCHAR) AS standing, CAST(CAST(turning AS INTEGER) AS VARCHAR) AS turning FROM samples")
def src_12_stream_table(samples: DataFrame) -> DataFrame:
    rows = samples.select("event_id", "time_s", F.col("speed").alias("z"), F.lit(0.5).alias("terrain_z"), "speed", "kappa_eff", "standing", "turning")
    return S.stream_table(rows, "truth")


_STILL = """string_agg('{"event_id":' || event_id || '}', ',' ORDER BY event_id) FILTER (standing)"""
_SPEED = "CASE WHEN speed > 0 AND speed < 1e-3 THEN printf('%.1fE-4', speed * 1e4) ELSE CAST(speed AS VARCHAR) END"
_DOCUMENT = """'{"run_id":' || run_id || ',"manifest":{"rows":' || count(*) || '},"truth":[' || string_agg('{"event_id":' || event_id || ',"speed":' || """ + _SPEED + """ || '}', ',' ORDER BY event_id) || ']' || coalesce(',"standing":[' || """ + _STILL + """ || ']', '') || '}'"""


@query("samples", f"SELECT run_id, {_DOCUMENT} AS document FROM samples GROUP BY run_id")
def src_13_run_documents(samples: DataFrame) -> DataFrame:
    manifest = samples.groupBy("run_id").agg(F.count("*").alias("rows"))
    return S.run_documents(manifest, {"truth": samples.select("run_id", "event_id", "speed"), "standing": samples.where("standing").select("run_id", "event_id")}, "run_id", "event_id")


_FEATURE = """'{"type":"Feature","properties":{"run":' || path_id || ',"coordinates":"local_metres"},"geometry":{"type":"LineString","coordinates":[' || string_agg('[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']', ',' ORDER BY seq) || ']}}'"""


@query("track", f"SELECT path_id, {_FEATURE} AS feature FROM track GROUP BY path_id")
def src_14_geojson(track: DataFrame) -> DataFrame:
    return S.geojson_lines(track, "path_id", "seq", "x", "y", degrees=False)


@query("samples", "SELECT 'truth' AS stream, count(*) AS n, count(speed) AS speeds FROM samples UNION ALL SELECT 'gnss', count(*), 0 FROM samples WHERE standing")
def src_16_stitched(samples: DataFrame) -> DataFrame:
    table = S.stitched({"truth": samples.select("event_id", "speed"), "gnss": samples.where("standing").select("event_id", "kappa_eff")})
    return table.groupBy("stream").agg(F.count("*").alias("n"), F.count("speed").alias("speeds"))


@query("cells")
def src_18_chunk_payloads(cells: DataFrame) -> DataFrame:
    return S.chunk_payloads(cells, 16)


@query("geo", "SELECT id AS key, format('Copernicus_DSM_COG_10_N{:02d}_00_E{:03d}_00_DEM', la, lo) AS tile FROM geo, LATERAL (SELECT unnest(range(CAST(floor(lat - 0.9) AS BIGINT), CAST(floor(lat + 0.05) AS BIGINT) + 1)) AS la), LATERAL (SELECT unnest(range(CAST(floor(lon - 0.05) AS BIGINT), CAST(floor(lon + 0.05) AS BIGINT) + 1)) AS lo)")
def src_19_tiles(geo: DataFrame) -> DataFrame:
    box = geo.select(F.col("id").alias("key"), (F.col("lat") - 0.9).alias("south"), (F.col("lat") + 0.05).alias("north"), (F.col("lon") - 0.05).alias("west"), (F.col("lon") + 0.05).alias("east"))
    return R.tiles_for(box)


@query("task_events", "SELECT task_id, count(*) AS rows, count(*) FILTER (type = 'log') AS log, count(*) FILTER (type = 'done') AS done FROM task_events GROUP BY task_id")
def src_20_run_summaries(task_events: DataFrame) -> DataFrame:
    return S.run_summaries(task_events, "task_id", "type", ["log", "done"]).drop("summary")


@query("samples", "SELECT event_id, CASE WHEN standing THEN 'baro' ELSE 'gnss' END AS channel, CASE WHEN standing THEN NULL ELSE round(speed, 6) + 0.0 END AS speed_mps FROM samples")
def src_02_sensor_rows(samples: DataFrame) -> DataFrame:
    gnss = samples.where("not standing").select("event_id", F.lit("gnss").alias("channel"), r6("speed").alias("speed_mps"))
    return gnss.unionByName(samples.where("standing").select("event_id", F.lit("baro").alias("channel")), allowMissingColumns=True)
