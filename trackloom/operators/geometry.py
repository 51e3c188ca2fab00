"""Path geometry: resampling, cutting, simplifying, folds and turns, ring stitching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.joins import at_arc, segment_cells
from trackloom.operators.windows import arc_lengths


def resample(track: DataFrame, spacing: float, path: str = "path_id") -> DataFrame:
    """GRP-05: points at even arc steps of at most ``spacing`` (1 mm at least), both ends included."""
    with_arc = arc_lengths(track, path)
    total = with_arc.groupBy(path).agg(F.max("arc").alias("_total"))
    steps = F.greatest(F.ceil(F.col("_total") / max(spacing, 1e-3)), F.lit(1).cast("long"))
    targets = total.withColumn("_n", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    return at_arc(with_arc, targets.select(path, "k", (F.col("_total") * F.col("k") / F.col("_n")).alias("s")), path)


def sub_path(track: DataFrame, start: float, end: float, path: str = "path_id") -> DataFrame:
    """GRP-06: the part of each path between two arcs, cut points included, numbered anew."""
    with_arc = arc_lengths(track, path)
    inner = with_arc.where((F.col("arc") > start) & (F.col("arc") < end)).select(path, F.col("arc").alias("s"), "x", "y")
    total = with_arc.groupBy(path).agg(F.max("arc").alias("_total")).where(F.col("_total") > start)
    cuts = total.withColumn("s", F.explode(F.array(F.lit(float(start)), F.least(F.lit(float(end)), F.col("_total"))))).select(path, "s")
    rows = inner.unionByName(at_arc(with_arc, cuts, path).select(path, "s", "x", "y"))
    return rows.withColumn("seq", F.row_number().over(W.partitionBy(path).orderBy("s", "x", "y")) - 1)


def concatenated(a: DataFrame, b: DataFrame, path: str = "path_id", slack: float = 1e-6) -> DataFrame:
    """SET-05: b's points after a's; b's first is left out where it is a's last."""
    last = a.groupBy(path).agg(F.max("seq").alias("_n"), F.max_by(F.struct("x", "y"), "seq").alias("_e"))
    joined = b.join(last, path, "left")
    same = (F.col("seq") == 0) & F.coalesce(F.hypot(F.col("x") - F.col("_e.x"), F.col("y") - F.col("_e.y")) <= slack, F.lit(False))
    rest = joined.where(~same).withColumn("seq", F.col("seq") + F.coalesce(F.col("_n") + 1, F.lit(0)))
    w = W.partitionBy(path).orderBy("seq")
    return a.unionByName(rest.select(a.columns)).withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def same_polyline(a: DataFrame, b: DataFrame, path: str = "path_id", slack: float = 0.05) -> DataFrame:
    """SET-06: whether two versions of a path have the same number of vertices, each within ``slack``."""
    other = b.select(path, "seq", F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = a.join(other, [path, "seq"], "full")
    off = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return met.groupBy(path).agg(F.every(F.coalesce(off <= slack, F.lit(False))).alias("same"))


def segments(track: DataFrame, path: str = "path_id") -> DataFrame:
    """GRP-30: a row for each leg between neighbouring points."""
    w = W.partitionBy(path).orderBy("seq")
    rows = track.select(path, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return rows.where("x1 is not null")


def _points(rows: pa.Table) -> np.ndarray:
    """x and y of each row, NaN where there is none."""
    return np.column_stack([rows.column(c).cast(pa.float64()).to_numpy() for c in "xy"])


def _per_path(track: DataFrame, path: str, keep) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        return rows.take(pa.array(keep(_points(rows)), pa.int64()))

    return track.groupBy(path).applyInArrow(run, track.schema)


#: Fixed values of the rules of simplification and of folds. A shortcut spans 65 vertices at most, and turns by no
#: more than an angle of this cosine; a fold comes back within half a metre, at every half metre up to three.
_SPAN, _STRAIGHT = 65, 0.966
_FOLD_ARCS, _FOLD_GAP = np.arange(1, 7) * 0.5, 0.5
_PROBE = 0.1


def _shortcuts(p: np.ndarray, tolerance: float, span: float, cosine: float, shut: frozenset, resolution: float) -> list[int]:
    """Places of the points that stay."""
    n = len(p)
    if n < 3:
        return list(range(n))
    steps = np.diff(p, axis=0)
    lengths = np.hypot(*steps.T)
    arc = np.concatenate([[0.0], np.cumsum(lengths)])
    way = np.divide(steps, lengths[:, None], out=np.zeros_like(steps), where=lengths[:, None] > 0)
    open_to = np.array([tuple(c) not in shut for c in np.floor(p / resolution).astype(int).tolist()]) if shut else np.ones(n, dtype=bool)
    kept, i = [0], 0
    while i < n - 1:
        furthest = i + 1
        for j in range(i + 1, min(n, i + 1 + _SPAN)):
            along = arc[j] - arc[i]
            if not open_to[j] or along > span:
                break
            if along <= 0:
                continue
            chord, inner = p[j] - p[i], p[i + 1 : j] - p[i]
            size = math.hypot(*chord)
            away = np.abs(inner[:, 0] * chord[1] - inner[:, 1] * chord[0]) / size if size > 1e-9 else np.hypot(*inner.T)
            if len(away) and away.max() > tolerance:
                break  # what a longer one would leave out lies as far away
            before = way[i - 1] if i else np.zeros(2)
            after = way[j] if j < n - 1 else np.zeros(2)
            straight = not before.any() or not after.any() or float(before @ after) >= cosine
            if straight and not (shut and _entered(p[i], p[j], resolution) & shut):
                furthest = j
        kept.append(furthest)
        i = furthest
    return kept


def simplify(track: DataFrame, tolerance: float, span: float = 64.0, cosine: float = _STRAIGHT, path: str = "path_id", blocked: DataFrame | None = None, resolution: float = 1.0) -> DataFrame:
    """GRP-07: from each kept point the furthest shortcut over at most ``span`` metres of the path.

    The vertices that it leaves out lie within ``tolerance`` of it, the directions into its beginning and out of its
    end have a cosine of ``cosine`` at least, and, with cells ``blocked(cx, cy)``, no vertex up to its end lies and no part
    of it runs in one. A shortcut lies within the tolerance of what it replaces, so only blocked cells
    so near to a path go to its task.
    """
    none = frozenset()
    if blocked is None:
        return _per_path(track, path, lambda p: _shortcuts(p, tolerance, span, cosine, none, resolution))
    size = tolerance + 2 * resolution
    w = W.partitionBy(path).orderBy("seq")
    legs = track.select(path, *[F.col(c).alias(f"{c}0") for c in "xy"], *[F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"{c}1") for c in "xy"])
    met = segment_cells(legs, size).select(path, F.col("cx").alias("_bx"), F.col("cy").alias("_by")).distinct()
    return track.groupBy(path).cogroup(_near(met, blocked, path, size, resolution).groupBy("_path")).applyInPandas(lambda rows, cells: _kept(rows, cells, lambda p, shut: _shortcuts(p, tolerance, span, cosine, shut, resolution)), track.schema)


def _near(touched: DataFrame, blocked: DataFrame, path: str, size: float, resolution: float) -> DataFrame:
    """(_path, cx, cy): blocked cells in the buckets (_bx, _by) of ``size`` that a path touches, or beside one."""
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    touched = touched.select(path, "_bx", "_by", around.alias("_o")).select(path, (F.col("_bx") + F.col("_o.dx")).alias("_bx"), (F.col("_by") + F.col("_o.dy")).alias("_by")).distinct()
    shut = blocked.select("cx", "cy", *[F.floor((F.col(c) + 0.5) * resolution / size).alias(b) for c, b in (("cx", "_bx"), ("cy", "_by"))])
    return touched.join(shut, ["_bx", "_by"]).select(F.col(path).alias("_path"), "cx", "cy")


def _kept(rows: pd.DataFrame, cells: pd.DataFrame, keep) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    return rows.iloc[keep(rows[["x", "y"]].to_numpy(dtype=float), frozenset(zip(cells["cx"].astype(int), cells["cy"].astype(int), strict=True)))]


def _entered(a: np.ndarray, b: np.ndarray, resolution: float) -> set[tuple[int, int]]:
    """Cells that the straight way from a to b enters: between two crossings of grid lines it lies in one."""
    a, b = a / resolution, b / resolution
    cuts = [0.0, 1.0]
    for s, e in zip(a, b, strict=True):
        lines = np.arange(math.floor(min(s, e)) + 1, math.floor(max(s, e)) + 1)
        cuts += ((lines - s) / (e - s)).tolist() if s != e else []
    t = np.unique(cuts)
    t = np.concatenate([t[:1], (t[1:] + t[:-1]) / 2, t[-1:]])
    return {tuple(c) for c in np.floor(a + t[:, None] * (b - a)).astype(int).tolist()}


def _without_folds(p: np.ndarray, reach: float, gap: float, blocked: frozenset, resolution: float) -> list[int]:
    """Places of the points that stay.

    Points of one place behind one another have the same folds ahead: one asks for all of them. It looks no further than
    ``reach``, and asks again only where something has gone from what it saw.
    """
    first = np.flatnonzero(np.concatenate([np.ones(min(len(p), 1), dtype=bool), (p[1:] != p[:-1]).any(axis=1)]))
    at, behind = p[first], np.append(first[1:], len(p))
    alone = np.zeros(len(first), dtype=bool)  # the others of its place are gone
    seen = np.full(len(first), len(first))

    def fold_end(i: int, rest: np.ndarray, r: int) -> int | None:
        """The first place of ``rest`` from the r-th on where a fold that begins at i has come back."""
        look, asked = 16, 0
        while True:
            ahead = rest[r : r + look]
            way = at[ahead] - at[i]
            steps = way.copy()
            steps[1:] -= way[:-1]
            arc = np.hypot(steps[:, 0], steps[:, 1]).cumsum()
            within = int(arc.searchsorted(reach, side="right"))
            direct = np.hypot(way[:within, 0], way[:within, 1])
            for j in ((direct < gap) & (arc[:within] > 2 * direct + 0.5)).nonzero()[0].tolist():
                if j >= asked and (not blocked or not _entered(at[i], at[ahead[j]], resolution) & blocked):
                    return r + j
            if within < len(ahead) or r + look >= len(rest):
                seen[i] = ahead[within] if within < len(ahead) else len(first) - 1
                return None
            look, asked = 4 * look, len(ahead)

    kept, stale = np.arange(len(first)), np.ones(len(first), dtype=bool)
    while stale.any():
        stays = np.ones(len(kept), dtype=bool)
        r = 0
        while r < len(kept):
            i = int(kept[r])
            r += 1
            while stale[i] and (j := fold_end(i, kept, r)) is not None:
                alone[i], stays[r:j], r = True, False, j
        gone = np.zeros(len(first) + 1, dtype=int)
        gone[kept[~stays] + 1] = 1
        kept, upto = kept[stays], np.cumsum(gone)
        stale = np.zeros(len(first), dtype=bool)
        stale[kept] = upto[np.minimum(seen[kept] + 1, len(first))] > upto[kept + 1]
    return [n for i in kept.tolist() for n in range(first[i], first[i] + 1 if alone[i] else behind[i])]


def remove_spikes(track: DataFrame, reach: float = 12.0, gap: float = 1.0, path: str = "path_id", blocked: DataFrame | None = None, resolution: float = 1.0) -> DataFrame:
    """GRP-08: without folds, which leave and come back within ``gap``: arc above twice the direct way and half a metre, at most ``reach`` long.

    From each point the first fold goes, again and again until none is left anywhere. With cells
    ``blocked(cx, cy)`` a fold stays where the direct way enters one; only those near a path go to its task.
    """
    none = frozenset()
    if blocked is None:
        return _per_path(track, path, lambda p: _without_folds(p, reach, gap, none, resolution))
    size = gap + resolution
    touched = track.select(path, F.floor(F.col("x") / size).alias("_bx"), F.floor(F.col("y") / size).alias("_by")).distinct()
    near = _near(touched, blocked, path, size, resolution)
    return track.groupBy(path).cogroup(near.groupBy("_path")).applyInPandas(lambda rows, cells: _kept(rows, cells, lambda p, shut: _without_folds(p, reach, gap, shut, resolution)), track.schema)


class _Line:
    """A polyline by arc length; beyond its ends it stands still."""

    def __init__(self, p: np.ndarray):
        steps = np.diff(p, axis=0)
        self.p, self.lengths = p, np.hypot(*steps.T)
        self.arc = np.concatenate([[0.0], np.cumsum(self.lengths)])
        self.total = float(self.arc[-1])
        self.angles = np.where(self.lengths > 1e-12, np.arctan2(steps[:, 1], steps[:, 0]), 0.0)

    def leg(self, s: np.ndarray) -> np.ndarray:
        held = np.minimum(np.maximum(s, 0.0), self.total)
        return np.minimum(self.arc.searchsorted(held, side="right") - 1, len(self.p) - 2)

    def heading(self, s: np.ndarray) -> np.ndarray:
        return self.angles[self.leg(s)]

    def at(self, s: np.ndarray) -> np.ndarray:
        k = self.leg(s)
        t = np.minimum(np.maximum((np.minimum(np.maximum(s, 0.0), self.total) - self.arc[k]) / np.maximum(self.lengths[k], 1e-9), 0.0), 1.0)
        return self.p[k] + (self.p[k + 1] - self.p[k]) * t[:, None]


def _turned(after: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (after - before + math.pi) % (2 * math.pi) - math.pi


def _reversals(line: _Line, window: float, threshold: float, look: int = 2048) -> list[tuple[float, float, str]]:
    """(arc, turn, kind) of corners and folds along a line, up to ``look`` places at a time, few of them after one that was found."""
    found, step = [], max(window / 8, 0.25)
    at, end = step, line.total - window
    done, few = 0, 16
    while line.total > 2 * window and at + step * done < end:
        places = at + step * np.arange(done, min(done + few, look))
        places = places[places < end]
        corner = _turned(line.heading(places + window), line.heading(places - window))
        hit = np.abs(corner) >= threshold
        if hit.any():  # what comes behind a corner is looked at after it
            places = places[: int(hit.argmax()) + 1]
            hit = hit[: len(places)]
        reached = places[:, None] + _FOLD_ARCS
        back = line.at(reached.ravel()).reshape(*reached.shape, 2) - line.at(places)[:, None]
        turn = _turned(line.heading(reached.ravel()).reshape(reached.shape), line.heading(places)[:, None])
        folds = (reached <= line.total) & (np.hypot(back[..., 0], back[..., 1]) < _FOLD_GAP) & (np.abs(turn) > math.pi / 2)
        some = np.flatnonzero(hit | folds.any(axis=1))
        if not len(some):
            done, few = done + len(places), 2 * few
            if done >= look:
                at, done = at + step * done, 0
            continue
        k = int(some[0])
        if hit[k]:
            first = max(0.0, places[k] - window)
            probes = first + _PROBE * np.arange(int((min(line.total, places[k] + window) - first) / _PROBE + 1e-9) + 1)
            change = np.abs(_turned(line.heading(probes + _PROBE), line.heading(probes - _PROBE)))
            pivot = float(probes[int(change.argmax())])
            found.append((pivot, float(corner[k]), "corner"))
            at = pivot + 4 * window
        else:
            j = int(folds[k].argmax())
            pivot = float(places[k] + _FOLD_ARCS[j] / 2)
            found.append((pivot, float(turn[k, j]), "fold"))
            at = pivot + window
        done, few = 0, 16
    return found


def turns(track: DataFrame, window: float, degrees: float, path: str = "path_id") -> DataFrame:
    """GRP-09: (path, arc, turn, x, y, kind) where a path reverses.

    Along the arc, every eighth of ``window`` (a quarter metre at least), the directions ``window`` before
    and after are compared; where they differ by ``degrees`` or more there is a corner, at the sharpest change within the window, and
    the next four windows behind it are passed over. Where they do not, a path that is back within half a metre after at most three, by
    more than a right angle, is a fold, at its middle, and one window is passed over. A path of two windows or less has none.
    """
    kind = track.schema[path].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        p, told, where = _points(rows.sort_by("seq")), [], np.empty((0, 2))
        if len(p) > 1:
            line = _Line(p)
            told = _reversals(line, window, math.radians(degrees))
            where = line.at(np.array([s for s, _, _ in told], dtype=float))
        arcs, turned, kinds = ([t[i] for t in told] for i in range(3))
        names = rows.column(path).take(pa.array([0] * len(told), pa.int64()))
        return pa.table({path: names, "arc": pa.array(arcs, pa.float64()), "turn": pa.array(turned, pa.float64()), "x": pa.array(where[:, 0]), "y": pa.array(where[:, 1]), "kind": pa.array(kinds, pa.string())})

    return track.groupBy(path).applyInArrow(run, f"{path} {kind}, arc double, turn double, x double, y double, kind string")


def stitched_rings(fragments: DataFrame, relation: str) -> DataFrame:
    """GRP-10: (relation, ring, seq, x, y): a relation's fragments(fragment, seq, x, y) chained end to end; what does not close is dropped."""
    kind = fragments.schema[relation].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        open_ = [g.sort_values("seq")[["x", "y"]].apply(tuple, axis=1).tolist() for _, g in rows.groupby("fragment", sort=True)]
        rings = []
        while open_:
            chain = open_.pop(0)
            grown = True
            while chain[0] != chain[-1] and grown:
                grown = False
                for i, other in enumerate(open_):
                    if other[0] == chain[-1] or other[-1] == chain[-1]:
                        chain = chain + (other if other[0] == chain[-1] else other[::-1])[1:]
                        open_.pop(i)
                        grown = True
                        break
            if chain[0] == chain[-1] and len(chain) > 3:
                rings.append(chain)
        out = [(rows[relation].iloc[0], r, s, x, y) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
        return pd.DataFrame(out, columns=[relation, "ring", "seq", "x", "y"])

    return fragments.groupBy(relation).applyInPandas(run, f"{relation} {kind}, ring long, seq long, x double, y double")


def ring_measures(corners: DataFrame, key: str) -> DataFrame:
    """AGG-36: box, signed area, centroid (null without area) and vertex mean of rings given as corner rows(seq, x, y)."""
    w = W.partitionBy(key).orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nx, ny = F.coalesce(F.lead("x").over(w), first["x"]), F.coalesce(F.lead("y").over(w), first["y"])
    rows = corners.withColumn("_c", F.col("x") * ny - nx * F.col("y")).withColumn("_gx", (F.col("x") + nx) * F.col("_c")).withColumn("_gy", (F.col("y") + ny) * F.col("_c"))
    got = rows.groupBy(key).agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "x_lo"), (F.max, "x", "x_hi"), (F.min, "y", "y_lo"), (F.max, "y", "y_hi"))], (F.sum("_c") / 2).alias("area"), F.sum("_gx").alias("_gx"), F.sum("_gy").alias("_gy"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    solid = F.abs("area") > 1e-12
    return got.select(key, "x_lo", "x_hi", "y_lo", "y_hi", "area", F.when(solid, F.col("_gx") / (6 * F.col("area"))).alias("cx"), F.when(solid, F.col("_gy") / (6 * F.col("area"))).alias("cy"), "mean_x", "mean_y")
