"""Schemas of the stored tables and files."""

from __future__ import annotations

XY = "struct<x: double, y: double>"
TRUTH = f"time_s double, position {XY}, position_low {XY}, z double, terrain_z double, speed double, heading_rad double, head_heading_rad double, pitch_rad double, roll_rad double, kappa_eff double, offset_m double, grade double, standing boolean, turning boolean, velocity array<double>, acceleration array<double>"
SENSOR = "time_s double, channel string, v array<double>, latitude_deg double, longitude_deg double, altitude_m double, speed_mps double, heading_rad double, valid boolean, satellites int, pressure_pa double"
CHANNELS = ["gnss", "accel", "gyro", "mag", "baro"]
EVENT = "at_ms long, event struct<type: string, state: string, stage: string, progress: double, elapsed_s: double, level: string, message: string, kind: string, summary_url: string>"
_VERTICES = "array<struct<lat: double, lon: double>>"
_FIELDS = ("type string", "id long", "tags map<string, string>", f"geometry {_VERTICES}", f"members array<struct<type: string, role: string, geometry: {_VERTICES}>>")
OSM_ELEMENT = ", ".join(_FIELDS)
OSM = f"elements array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _FIELDS)}>>"
