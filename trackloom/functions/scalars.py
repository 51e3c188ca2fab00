"""Column functions: geodesy, angles, limits, sensors, codes and tags."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
EARTH_RADIUS_M = 6_371_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, low, high) -> Column:
    """SCA-09"""
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def lerp(a, b, t) -> Column:
    """SCA-09"""
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def smoothstep(x) -> Column:
    """SCA-09"""
    t = clamp(x, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def to_local(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """SCA-01: degrees to metres east and north of an origin on a sphere."""
    scale = max(abs(math.cos(math.radians(lat0))), 1e-9)
    return F.radians(_c(lon) - lon0) * (EARTH_RADIUS_M * scale), F.radians(_c(lat) - lat0) * EARTH_RADIUS_M


def to_geo(x, y, lon0: float, lat0: float) -> tuple[Column, Column]:
    """SCA-01: metres back to degrees."""
    scale = max(abs(math.cos(math.radians(lat0))), 1e-9)
    return F.degrees(_c(x) / (EARTH_RADIUS_M * scale)) + lon0, F.degrees(_c(y) / EARTH_RADIUS_M) + lat0


# Fixed values of the GCJ-02 datum: semi-major axis, eccentricity squared, and the polynomials' factors.
_GCJ_A, _GCJ_EE = 6_378_245.0, 0.00669342162296594323


def _waves(x: Column, terms: list[tuple[float, float]]) -> Column:
    out = None
    for factor, amount in terms:
        term = F.sin(x * (math.pi * factor)) * amount
        out = term if out is None else out + term
    return out * (2.0 / 3.0)


def gcj02_to_wgs84(lon, lat, steps: int = 5) -> Column:
    """SCA-03: struct(lon, lat) by fixed-point steps; unchanged outside the box of the datum."""
    lon, lat = _c(lon), _c(lat)

    def shifted(p: Column) -> Column:
        x, y = p["lon"] - 105.0, p["lat"] - 35.0
        root, both = F.sqrt(F.abs(x)), _waves(x, [(6.0, 20.0), (2.0, 20.0)])
        north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + both + _waves(y, [(1.0, 20.0), (1 / 3, 40.0)]) + _waves(y, [(1 / 12, 160.0), (1 / 30, 320.0)])
        east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + both + _waves(x, [(1.0, 20.0), (1 / 3, 40.0)]) + _waves(x, [(1 / 12, 150.0), (1 / 30, 300.0)])
        rad = F.radians(p["lat"])
        magic = 1.0 - _GCJ_EE * F.sin(rad) * F.sin(rad)
        d_lat = F.degrees(north) / ((_GCJ_A * (1.0 - _GCJ_EE)) / (magic * F.sqrt(magic)))
        d_lon = F.degrees(east) / (_GCJ_A / F.sqrt(magic) * F.cos(rad))
        return F.struct((lon - d_lon).alias("lon"), (lat - d_lat).alias("lat"))

    start = F.struct(lon.alias("lon"), lat.alias("lat"))
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda p, _: shifted(p))
    inside = lon.between(72.004, 137.8347) & lat.between(0.8293, 55.8271)
    return F.when(inside, moved).otherwise(start)


def tile_name(lat, lon) -> Column:
    """SCA-04: name of the one-degree elevation tile that holds a position."""
    row, column = F.floor(_c(lat)), F.floor(_c(lon))
    return F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", F.when(row < 0, "S").otherwise("N"), F.abs(row), F.when(column < 0, "W").otherwise("E"), F.abs(column))


def cell_of(x, origin: float, resolution: float, count: int) -> Column:
    """SCA-05: index of the grid cell along an axis, clamped to the grid."""
    return clamp(F.floor((_c(x) - origin) / resolution), F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def cell_center(cell, origin: float, resolution: float) -> Column:
    """SCA-05"""
    return origin + (_c(cell) + 0.5) * resolution


def _spread(x: Column) -> Column:
    x = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_encode(x, y) -> Column:
    """SCA-06: bits of x at even places, of y at odd ones."""
    return _spread(_c(x)).bitwiseOR(F.shiftleft(_spread(_c(y)), 1))


def morton_decode(code) -> tuple[Column, Column]:
    """SCA-06"""
    code = _c(code)
    return _gather(code), _gather(F.shiftrightunsigned(code, 1))


def node_key(x, y, depth: int) -> Column:
    """SCA-06: quadtree key that also holds the depth, as one leading bit."""
    return F.lit(1 << (2 * depth)).cast("long").bitwiseOR(morton_encode(x, y))


def angle_difference(a, b) -> Column:
    """SCA-07: a - b in [-pi, pi)."""
    return F.pmod(_c(a) - _c(b) + math.pi, F.lit(TAU)) - math.pi


def cross2(ax, ay, bx, by) -> Column:
    """SCA-08"""
    return _c(ax) * _c(by) - _c(ay) * _c(bx)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """SCA-08: distance to a segment, to its point where both ends are equal."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, clamp(((px - ax) * dx + (py - ay) * dy) / square, 0.0, 1.0)).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _told_once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row: what a lambda names from outside is computed again at each of its elements."""
    return F.transform(F.array(value), f)[0]


def softmax(values, temperature: float = 1.0) -> Column:
    """SCA-10: over an array, shifted by its largest; uniform where the sum vanishes."""

    def shares(v: Column, e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return _told_once(total, lambda t: F.when(t > 0, F.transform(e, lambda x: x / t)).otherwise(F.transform(v, lambda x: 1.0 / F.size(v))))

    def of(v: Column) -> Column:
        e = _told_once(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / temperature)))
        return _told_once(e, lambda e: shares(v, e))

    return _told_once(_c(values), of)


def attention_gate(context, keys: list[list[float]], projection: list[list[float]], prior: list[float], low: float = 0.5, high: float = 2.0) -> Column:
    """SCA-11: prior weights times gates from softmax((W z) . k / sqrt(d)), clipped to [low, high] times the uniform share and brought to a mean of 1."""
    z, d = _c(context), len(projection)

    def dot(row: list[float], vector: Column) -> Column:
        return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    def weighed(gate: Column) -> Column:
        mean = F.aggregate(gate, F.lit(0.0), lambda a, x: a + x) / len(keys)
        return _told_once(mean, lambda m: F.zip_with(F.transform(gate, lambda g: g / m), F.array(*map(F.lit, prior)), lambda g, p: g * p))

    scores = _told_once(F.array(*[dot(row, z) for row in projection]), lambda query: F.array(*[dot(k, query) / math.sqrt(d) for k in keys]))
    return _told_once(F.transform(softmax(scores), lambda s: clamp(s * len(keys), low, high)), weighed)


# Cost of running by grade (J per kg and m), fifth power first, after Minetti.
_MINETTI = (155.4, -30.4, -43.3, 46.3, 19.5, 3.6)
_GRADE_LIMIT = 0.25


def minetti_cost(grade) -> Column:
    """SCA-12"""
    i = clamp(grade, -_GRADE_LIMIT, _GRADE_LIMIT)
    out = F.lit(_MINETTI[0])
    for factor in _MINETTI[1:]:
        out = out * i + factor
    return out


def slope_speed(target, grade) -> Column:
    """SCA-12: speed along the ground at the metabolic rate of ``target`` on the level."""
    g = _c(grade)
    return _c(target) * _MINETTI[-1] / F.greatest(minetti_cost(g), F.lit(0.1)) * F.sqrt(1.0 + g * g)


def curvature_speed_limit(a_lat_max: float, curvature) -> Column:
    """SCA-13"""
    k = F.abs(_c(curvature))
    return F.when(k < 1e-6, F.lit(math.inf)).otherwise(F.sqrt(a_lat_max / k))


def downhill_cap(target, k_down: float, grade) -> Column:
    """SCA-13"""
    return F.when(_c(grade) < 0, k_down * _c(target)).otherwise(F.lit(math.inf))


def speed_limit(target, grade, curvature, fatigue, a_lat_max: float, k_down: float) -> Column:
    """SCA-13: the least of the limits by slope, curvature, fatigue and descent."""
    return F.least(slope_speed(target, grade), curvature_speed_limit(a_lat_max, curvature), _c(fatigue), downhill_cap(target, k_down, grade))


def effective_curvature(curvature, offset) -> Column:
    """SCA-14"""
    k = _c(curvature)
    return k / F.greatest(1.0 - _c(offset) * k, F.lit(0.3))


def allowed_inner_offset(curvature, speed, a_lat_max: float) -> Column:
    """SCA-14: null where the centre line is too fast already."""
    k = F.abs(_c(curvature))
    margin = 1.0 - _c(speed) * _c(speed) * k / a_lat_max
    return F.when(k < 1e-9, F.lit(math.inf)).when(margin > 0, margin / k)


def fatigue_speed(t, v0: float, v_crit: float, tau: float) -> Column:
    """SCA-15"""
    return v_crit + (v0 - v_crit) * F.exp(-_c(t) / max(tau, 1e-6))


def pacing_factor(tau, amplitude: float, strategy: str) -> Column:
    """SCA-15: even, positive or negative split."""
    t = clamp(tau, 0.0, 1.0)
    return {"even": F.lit(1.0), "positive": 1.0 + amplitude * (1.0 - 2.0 * t), "negative": 1.0 + amplitude * (2.0 * t - 1.0)}[strategy]


SCALE_HEIGHT_M = 8434.0


def pressure_at(altitude, reference: float = 101_325.0) -> Column:
    """SCA-16"""
    return reference * F.exp(-_c(altitude) / SCALE_HEIGHT_M)


def altitude_at(pressure, reference: float = 101_325.0) -> Column:
    """SCA-16"""
    return -F.log(F.greatest(_c(pressure) / reference, F.lit(1e-6))) * SCALE_HEIGHT_M


def magnitude(x, y, z) -> Column:
    """SCA-17"""
    x, y, z = map(_c, (x, y, z))
    return F.sqrt(x * x + y * y + z * z)


def earth_field(strength, declination_deg, inclination_deg) -> tuple[Column, Column, Column]:
    """SCA-18: east, north, up."""
    d, i = F.radians(_c(declination_deg)), F.radians(_c(inclination_deg))
    flat = _c(strength) * F.cos(i)
    return flat * F.sin(d), flat * F.cos(d), -_c(strength) * F.sin(i)


GRAVITY = 9.81


def body_to_world(yaw, pitch, roll, x, y, z) -> tuple[Column, Column, Column]:
    """SCA-19: a vector turned by roll, then pitch, then yaw."""
    yaw, pitch, roll, x, y, z = map(_c, (yaw, pitch, roll, x, y, z))
    y1, z1 = y * F.cos(roll) - z * F.sin(roll), y * F.sin(roll) + z * F.cos(roll)
    x2, z2 = x * F.cos(pitch) + z1 * F.sin(pitch), z1 * F.cos(pitch) - x * F.sin(pitch)
    return x2 * F.cos(yaw) - y1 * F.sin(yaw), x2 * F.sin(yaw) + y1 * F.cos(yaw), z2


def world_to_body(yaw, pitch, roll, x, y, z) -> tuple[Column, Column, Column]:
    """SCA-19: the inverse turn."""
    yaw, pitch, roll, x, y, z = map(_c, (yaw, pitch, roll, x, y, z))
    x1, y1 = x * F.cos(yaw) + y * F.sin(yaw), y * F.cos(yaw) - x * F.sin(yaw)
    x2, z2 = x1 * F.cos(pitch) - z * F.sin(pitch), x1 * F.sin(pitch) + z * F.cos(pitch)
    return x2, y1 * F.cos(roll) + z2 * F.sin(roll), z2 * F.cos(roll) - y1 * F.sin(roll)


def quantise(value, scale: float, bias: float) -> Column:
    """SCA-20: raw integer of a value; 0 where the scale is 0."""
    return F.lit(0).cast("long") if scale == 0 else F.round((_c(value) - bias) / scale).cast("long")


def dequantise(raw, scale: float, bias: float) -> Column:
    """SCA-20"""
    return _c(raw) * scale + bias


def pack_direction(angle, strength, sectors: int = 256) -> Column:
    """SCA-21: angle index times 256 plus strength in 255 steps."""
    index = F.pmod(F.round(_c(angle) / TAU * sectors).cast("long"), F.lit(sectors))
    return index * 256 + F.round(clamp(strength, 0.0, 1.0) * 255).cast("long")


def unpack_direction(packed, sectors: int = 256) -> tuple[Column, Column]:
    """SCA-21"""
    packed = _c(packed)
    return F.floor(packed / 256) * (TAU / sectors), (packed % 256) / 255.0


def predicted_fundamental(amplitude, frequency) -> Column:
    """SCA-23"""
    return _c(amplitude) * F.pow(TAU * _c(frequency), F.lit(2.0))


def envelope(t, start, duration) -> Column:
    """SCA-24: raised cosine within an event, 0 outside."""
    t, start, duration = map(_c, (t, start, duration))
    return F.when((t > start) & (t < start + duration), 0.5 - 0.5 * F.cos((t - start) / duration * TAU)).otherwise(0.0)


def spatial_event(seed: int, region, entry, p) -> Column:
    """SCA-25: struct(trigger, direction_rad, magnitude) decided by hashes of the keys, the same on every run."""

    def unit(salt: int) -> Column:
        bits = F.xxhash64(F.lit(seed), F.lit(salt), _c(region), _c(entry))
        return F.shiftrightunsigned(bits, 11) / float(1 << 53)

    return F.struct((unit(0) < _c(p)).alias("trigger"), (unit(1) * TAU).alias("direction_rad"), unit(2).alias("magnitude"))


def rfc3339(ms) -> Column:
    """SCA-26: whole seconds, UTC session."""
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(text) -> Column:
    """SCA-26: Unix milliseconds, null for other text."""
    return F.unix_millis(F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]X")))


def slug(text) -> Column:
    """SCA-27: lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def leading_metres(text) -> Column:
    """SCA-28: the positive number that a length tag begins with, else null."""
    number = F.regexp_extract(F.trim(_c(text)), "^([0-9.]+)", 1).try_cast("double")
    return F.when(number > 0, number)


# Fixed values. Surfaces in the order of their ids, with resistance, then ways: surface, half width, traffic, crowding, lighting.
SURFACES = ["asphalt", "paving", "track", "gravel", "ground", "grass", "steps", "water", "building"]
RESISTANCE = [0.35, 0.45, 0.10, 0.65, 0.80, 0.85, 1.00, 1.00, 1.00]
WAYS = {
    "motorway": ("asphalt", 8.0, 0.95, 0.10, 0.90), "motorway_link": ("asphalt", 8.0, 0.95, 0.10, 0.90), "trunk": ("asphalt", 8.0, 0.95, 0.10, 0.90), "trunk_link": ("asphalt", 8.0, 0.95, 0.10, 0.90),
    "primary": ("asphalt", 6.0, 0.85, 0.15, 0.90), "primary_link": ("asphalt", 6.0, 0.85, 0.15, 0.90),
    "secondary": ("asphalt", 5.0, 0.70, 0.20, 0.85), "secondary_link": ("asphalt", 5.0, 0.70, 0.20, 0.85),
    "tertiary": ("asphalt", 4.0, 0.50, 0.25, 0.80), "tertiary_link": ("asphalt", 4.0, 0.50, 0.25, 0.80),
    "residential": ("asphalt", 3.5, 0.35, 0.30, 0.75), "unclassified": ("asphalt", 3.5, 0.35, 0.30, 0.75),
    "service": ("asphalt", 2.5, 0.15, 0.30, 0.65), "living_street": ("asphalt", 3.0, 0.10, 0.45, 0.70), "pedestrian": ("paving", 3.0, 0.0, 0.60, 0.70),
    "footway": ("paving", 1.2, 0.0, 0.35, 0.45), "path": ("paving", 1.2, 0.0, 0.35, 0.45), "cycleway": ("paving", 1.2, 0.0, 0.35, 0.45), "bridleway": ("paving", 1.2, 0.0, 0.35, 0.45),
    "steps": ("steps", 1.5, 0.0, 0.40, 0.45), "track": ("gravel", 2.0, 0.0, 0.10, 0.30),
}
SURFACE_TAGS = {
    "asphalt": ["asphalt", "chipseal"],
    "paving": ["concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "unhewn_cobblestone", "cobblestone", "bricks", "wood", "metal", "rubber"],
    "track": ["tartan"],
    "gravel": ["gravel", "fine_gravel", "pebblestone", "compacted", "crushed_limestone"],
    "ground": ["dirt", "earth", "mud", "sand", "ground"],
    "grass": ["grass", "soil", "grass_paver", "artificial_turf", "turf"],
}
AREA_CHANNELS = {"track": (0.0, 0.05, 0.60), "steps": (0.0, 0.40, 0.45), "asphalt": (0.15, 0.30, 0.70)}
OPEN_CHANNELS = (0.0, 0.15, 0.5)
VENUES = ["track", "pitch", "sports_centre", "stadium", "sports_hall"]
VENUE_CHANNELS = {"track": ("track", 5.0, 0.0, 0.10, 0.60), "ground": ("ground", 5.0, 0.0, 0.20, 0.40), "playground": ("paving", 5.0, 0.0, 0.35, 0.45)}
GREEN = {
    "leisure": ["park", "garden", "nature_reserve", "common", "golf_course", "recreation_ground", "village_green", "dog_park"],
    "natural": ["wood", "scrub", "grass", "grassland", "heath", "wetland", "fell"],
    "landuse": ["grass", "forest", "meadow", "recreation_ground", "village_green", "allotments", "orchard"],
}
STOREY_HEIGHT_M = 3.2


def lookup(key, table: dict) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[_c(key)]


def surface_category(tag) -> Column:
    """SCA-35"""
    return lookup(tag, {tag: name for name, tags in SURFACE_TAGS.items() for tag in tags})


def resistance(surface) -> Column:
    """SCA-35"""
    return lookup(surface, dict(zip(SURFACES, RESISTANCE, strict=True)))


def area_channels(surface) -> tuple[Column, Column, Column]:
    """SCA-35: traffic, crowding, lighting that an area of a surface paints."""
    return tuple(F.coalesce(lookup(surface, {k: v[i] for k, v in AREA_CHANNELS.items()}), F.lit(OPEN_CHANNELS[i])) for i in range(3))


def _runs(tags: Column) -> Column:
    sports = F.transform(F.split(tags["sport"], ";"), lambda s: F.trim(s))
    return F.coalesce(F.arrays_overlap(sports, F.array(F.lit("running"), F.lit("athletics"))), F.lit(False))


def is_running_venue(tags: Column) -> Column:
    """SCA-29: a sports venue whose list of sports holds running or athletics."""
    return F.coalesce(tags["leisure"].isin(*VENUES), F.lit(False)) & _runs(tags)


def classify_way(tags: Column) -> Column:
    """SCA-29: struct(surface, traffic, crowding, lighting, half_width_m) of a way; null for kinds not modelled and below ground.

    The highway tag decides, else leisure, else sport; the tags surface (tartan is a track only
    at running venues, else ground), paved, lit and width refine the class.
    """
    leisure, sport = tags["leisure"], tags["sport"]
    venue = F.when(is_running_venue(tags), "track").when(leisure.isin(*VENUES), "ground").when(leisure == "playground", "playground")
    kind = F.when(tags["highway"].isNotNull(), tags["highway"]).when(leisure.isNotNull(), F.concat(F.lit("leisure:"), venue))
    kind = kind.when(sport.isNotNull(), F.when(_runs(tags), "leisure:track").otherwise("leisure:ground"))
    classes = WAYS | {f"leisure:{k}": v for k, v in VENUE_CHANNELS.items()}
    way, half, traffic, crowding, lighting = (lookup(kind, {k: v[i] for k, v in classes.items()}) for i in range(5))
    below = F.coalesce(tags["tunnel"] != "no", F.lit(False)) | F.coalesce(F.trim(tags["layer"]).try_cast("int") < 0, F.lit(False))
    named = surface_category(tags["surface"])
    named = F.when((named == "track") & ~is_running_venue(tags), "ground").otherwise(named)
    surface = F.coalesce(named, way)
    surface = F.when((tags["paved"] == "yes") & surface.isin("gravel", "ground"), "asphalt").when((tags["paved"] == "no") & (surface == "asphalt"), "gravel").otherwise(surface)
    lit = F.when(tags["lit"] == "yes", F.greatest(lighting, F.lit(0.85))).when(tags["lit"].isin("no", "disused"), F.least(lighting, F.lit(0.15))).otherwise(lighting)
    width = leading_metres(F.coalesce(tags["width"], tags["est_width"]))
    half = F.when(width.isNotNull(), clamp(width * 0.5, 0.5, 12.0)).otherwise(half)
    found = F.struct(surface.alias("surface"), traffic.alias("traffic"), crowding.alias("crowding"), lit.alias("lighting"), half.alias("half_width_m"))
    return F.when(way.isNotNull() & ~below, found)


def area_kind(tags: Column, green: dict[str, list[str]] = GREEN) -> Column:
    """SCA-30: building, water, green or null; a highway on green ground stays a way."""
    building = F.coalesce(tags["building"] != "no", F.lit(False))
    water = F.coalesce(tags["natural"] == "water", F.lit(False)) | F.coalesce(tags["landuse"] == "reservoir", F.lit(False)) | F.coalesce(tags["waterway"].isin("riverbank", "canal", "dock"), F.lit(False))
    planted = F.lit(False)
    for key, values in green.items():
        planted = planted | F.coalesce(tags[key].isin(*values), F.lit(False))
    return F.when(building, "building").when(water, "water").when(tags["highway"].isNull() & planted, "green")


def building_height(tags: Column) -> Column:
    """SCA-31: the height tag, else storeys."""
    levels = F.trim(tags["building:levels"]).try_cast("double")
    return F.coalesce(leading_metres(tags["height"]), F.when(levels > 0, levels * STOREY_HEIGHT_M))


def laps_for(length, speed, duration) -> Column:
    """SCA-32: whole laps that fit, one at least."""
    return F.greatest(F.floor(_c(duration) * _c(speed) / _c(length)), F.lit(1).cast("long"))


def edge_key(ax, ay, bx, by) -> Column:
    """SCA-33: undirected key of a segment on half a metre."""
    a, b = (F.struct(F.round(_c(x) * 2).cast("long").alias("x"), F.round(_c(y) * 2).cast("long").alias("y")) for x, y in ((ax, ay), (bx, by)))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def white_noise_band(n, z: float = 1.96) -> Column:
    """SCA-34"""
    return z / F.sqrt(_c(n).cast("double"))


def ou_decay(dt: float, tau) -> Column:
    """SCA-36: share of a deviation left after ``dt``."""
    return F.exp(-dt / _c(tau))


def ou_tau(acf1, dt: float) -> Column:
    """SCA-36: correlation time from the lag-one autocorrelation, null unless in (0, 1)."""
    a = _c(acf1)
    return F.when((a > 0) & (a < 1), -dt / F.log(a))
