"""Spectra of series and what is read from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.sources.shared import settled


def spectrum(df: DataFrame, series: str, idx: str, value: str, rate: float, segment_rows: int = 65_536) -> DataFrame:
    """GRP-01: (series, bin, frequency_hz, magnitude), one-sided, of each whole series.

    A periodic Hann window over the real rows, zeros up to the next power of two, scaled by 2 over
    the window's sum. A transform of more than ``segment_rows`` (a power of two) is made in two
    steps: every R-th row from each start is transformed alone, then the R results at equal bins
    with one another, so that no group grows with a recording. Shorter series, which a job counts first, are
    transformed one after another as they stand, sorted, in their partitions. Series under two rows give nothing.
    """
    if segment_rows & (segment_rows - 1):
        raise ValueError("segment_rows must be a power of two")
    long = df.groupBy(series).agg(F.count("*").alias("_n")).where(F.col("_n") > segment_rows).select(F.col(series).alias("_long"))
    if long.limit(1).count() == 0:
        return _short_spectra(df, series, idx, value, rate)
    long = settled(long, "long")
    same = F.col(series).eqNullSafe(F.col("_long"))
    return _short_spectra(df.join(long, same, "left_anti"), series, idx, value, rate).unionByName(_long_spectra(df.join(long, same, "left_semi"), series, idx, value, rate, segment_rows))


def _short_spectra(df: DataFrame, series: str, idx: str, value: str, rate: float) -> DataFrame:
    """Spectra of series that a task can hold, many in one pass."""
    kind = df.schema[series].dataType.simpleString()
    rows = df.select(F.col(series).alias("_s"), F.col(value).cast("double").alias("_v"), F.col(idx).alias("_i")).repartition("_s").sortWithinPartitions("_s", F.asc_nulls_last("_i")).select("_s", F.coalesce("_v", F.lit(math.nan)).alias("_v"))

    def told(names: pa.Array, values: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        at, bins, hertz, sizes = [], [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = b - a
            if n < 2:
                continue
            size = 1 << (n - 1).bit_length()
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            at.append(np.abs(np.fft.rfft(values[a:b] * window, size)) * 4 / n)  # the window's sum is n / 2
            bins.append(np.arange(size // 2 + 1))
            hertz.append(bins[-1] * rate / size)
            sizes.append((a, size // 2 + 1))
        if not at:
            return pa.RecordBatch.from_arrays([names.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], [series, "bin", "frequency_hz", "magnitude"])
        first, counts = np.array(sizes).T
        return pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(first, counts))), *[pa.array(np.concatenate(c)) for c in (bins, hertz, at)]], [series, "bin", "frequency_hz", "magnitude"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = _changes(table)
            if len(cuts) > 2:
                yield told(table.column("_s").combine_chunks(), table.column("_v").to_numpy(), cuts[:-1])
            held = table.slice(int(cuts[-2])).to_batches()  # the last series may go on
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield told(table.column("_s").combine_chunks(), table.column("_v").to_numpy(), _changes(table))

    return rows.mapInArrow(run, f"{series} {kind}, bin long, frequency_hz double, magnitude double")


def _changes(table: pa.Table) -> np.ndarray:
    """Where each series begins, and the end."""
    names = table.column("_s").combine_chunks()
    n = len(names)
    if n < 2:
        return np.array([0, n])
    same = pc.equal(names.slice(0, n - 1), names.slice(1))
    same = pc.or_(pc.fill_null(same, False), pc.and_(pc.is_null(names.slice(0, n - 1)), pc.is_null(names.slice(1))))
    return np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1, [n]])


def _long_spectra(df: DataFrame, series: str, idx: str, value: str, rate: float, segment_rows: int) -> DataFrame:
    kind = df.schema[series].dataType.simpleString()
    rows = df.select(F.col(series).alias("_s"), F.col(idx).alias("_i"), F.col(value).cast("double").alias("_v"), F.floor(F.col(idx) / segment_rows).alias("_b"))
    w = W.partitionBy("_s").orderBy(F.asc_nulls_last("_b"))
    counts = rows.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    counts = counts.select(F.col("_s").alias("_t"), F.col("_b").alias("_d"), (F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_o"), F.sum("_c").over(W.partitionBy("_s")).alias("_n"))
    rows = rows.join(counts, F.col("_s").eqNullSafe(F.col("_t")) & F.col("_b").eqNullSafe(F.col("_d"))).where("_n >= 2")
    place = F.col("_o") + F.row_number().over(W.partitionBy("_s", "_b").orderBy(F.asc_nulls_last("_i"))) - 1
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n").cast("double")) - 1e-9)).cast("long")
    rows = rows.select("_s", "_v", "_n", place.alias("_p"), size.alias("_size")).withColumn("_parts", F.greatest(F.lit(1).cast("long"), (F.col("_size") / segment_rows).cast("long")))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        n, size, parts = (int(part[c].iloc[0]) for c in ("_n", "_size", "_parts"))
        place = part["_p"].to_numpy()
        start = int(place[0]) % parts
        x = np.zeros(size // parts)
        x[place // parts] = part["_v"].to_numpy(dtype=float) * (0.5 - 0.5 * np.cos(2 * np.pi * place / n))
        y = np.fft.fft(x) * np.exp(-2j * np.pi * (start * np.arange(len(x)) % size) / size)
        width = max(1, len(x) // parts)
        at = range(0, len(x), width)
        return pd.DataFrame({"_s": part["_s"].iloc[0], "_n": n, "_size": size, "_at": list(at), "_start": start, "_re": [y.real[k : k + width] for k in at], "_im": [y.imag[k : k + width] for k in at]})

    def second(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_start")
        n, size, at = (int(part[c].iloc[0]) for c in ("_n", "_size", "_at"))
        parts = max(1, size // segment_rows)
        y = np.zeros((parts, len(part["_re"].iloc[0])), dtype=complex)
        y[part["_start"].to_numpy()] = np.stack(part["_re"].to_list()) + 1j * np.stack(part["_im"].to_list())
        bins = (at + np.arange(y.shape[1])[None, :] + size // parts * np.arange(parts)[:, None]).ravel()
        magnitude = np.abs(np.fft.fft(y, axis=0)).ravel() * 4 / n  # the window's sum is n / 2
        kept = bins <= size // 2
        return pd.DataFrame({series: part["_s"].iloc[0], "bin": bins[kept], "frequency_hz": bins[kept] * rate / size, "magnitude": magnitude[kept]})

    halves = rows.groupBy("_s", (F.col("_p") % F.col("_parts")).alias("_r")).applyInPandas(first, f"_s {kind}, _n long, _size long, _at long, _start long, _re array<double>, _im array<double>")
    return halves.groupBy("_s", "_at").applyInPandas(second, f"{series} {kind}, bin long, frequency_hz double, magnitude double")


def dft_bins(df: DataFrame, series: str, idx: str, value: str, rate: float, bins: int) -> DataFrame:
    """GRP-01 for a few bins, by sums alone: the first ``bins`` of the same spectrum."""
    n = F.count("*").over(W.partitionBy(series))
    rows = df.select(series, F.col(idx).alias("_i"), F.col(value).alias("_v"), n.alias("_n")).where("_n >= 2")
    rows = rows.withColumn("_w", 0.5 - 0.5 * F.cos(2 * math.pi * F.col("_i") / F.col("_n"))).withColumn("_size", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n").cast("double")) - 1e-9)))
    spread = rows.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).where(F.col("bin") <= F.col("_size") / 2)
    angle = 2 * math.pi * F.col("bin") * F.col("_i") / F.col("_size")
    x = F.col("_v") * F.col("_w")
    sums = spread.groupBy(series, "bin").agg(F.sum(x * F.cos(angle)).alias("_c"), F.sum(x * F.sin(angle)).alias("_s"), F.sum("_w").alias("_w"), F.first("_size").alias("_size"))
    return sums.select(series, "bin", (F.col("bin") * rate / F.col("_size")).alias("frequency_hz"), (F.hypot("_c", "_s") * 2 / F.col("_w")).alias("magnitude"))


def periodogram(df: DataFrame, series: str, idx: str, value: str, rate: float, most: int = 2048, least: int = 32, bins: int | None = None) -> DataFrame:
    """GRP-31: amplitudes 2|X|/n of the mean-free first ``most`` rows at bins 1 to n/2 (or ``bins``), no window; none under ``least`` rows."""
    kept = df.where(F.col(idx) < most)
    w = W.partitionBy(series)
    rows = kept.select(series, F.col(idx).alias("_i"), (F.col(value) - F.avg(value).over(w)).alias("_v"), F.count("*").over(w).alias("_n")).where(F.col("_n") >= least)
    top = F.floor(F.col("_n") / 2) if bins is None else F.least(F.floor(F.col("_n") / 2), F.lit(bins).cast("long"))
    spread = rows.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), top)))
    angle = 2 * math.pi * F.col("bin") * F.col("_i") / F.col("_n")
    sums = spread.groupBy(series, "bin").agg(F.sum(F.col("_v") * F.cos(angle)).alias("_c"), F.sum(F.col("_v") * F.sin(angle)).alias("_s"), F.first("_n").alias("_n"))
    return sums.select(series, "bin", (F.col("bin") * rate / F.col("_n")).alias("frequency_hz"), (2 * F.hypot("_c", "_s") / F.col("_n")).alias("magnitude"))


def gait_signature(spec: DataFrame, series: str, low: float = 1.4, high: float = 3.6) -> DataFrame:
    """GRP-02: cadence_hz and amplitude of the strongest line in the band by a parabola through three bins, and the ratios at twice and three times it."""
    w = W.partitionBy(series).orderBy("bin")
    rows = spec.withColumn("_b", F.lag("magnitude").over(w)).withColumn("_a", F.lead("magnitude").over(w)).withColumn("_step", F.lead("frequency_hz").over(w) - F.col("frequency_hz"))
    rows = rows.where("_b is not null and _a is not null")
    curve = F.col("_b") - 2 * F.col("magnitude") + F.col("_a")
    shift = F.when(F.abs(curve) > 1e-12, F.least(F.greatest(0.5 * (F.col("_b") - F.col("_a")) / curve, F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
    rows = rows.withColumn("line_hz", F.col("frequency_hz") + shift * F.col("_step")).withColumn("line", F.col("magnitude") - 0.25 * (F.col("_b") - F.col("_a")) * shift)
    base = rows.where(F.col("frequency_hz").between(low, high)).groupBy(series).agg(F.max_by(F.struct("line_hz", "line"), F.struct("magnitude", -F.col("bin"))).alias("_p"))
    base = base.select(series, F.col("_p.line_hz").alias("cadence_hz"), F.col("_p.line").alias("amplitude")).where("amplitude > 0")
    near = rows.join(base, series)

    def harmonic(k: int):
        inside = F.abs(F.col("frequency_hz") - k * F.col("cadence_hz")) <= 0.1 * k * F.col("cadence_hz")
        return F.coalesce(F.max(F.when(inside, F.col("line"))) / F.first("amplitude"), F.lit(0.0)).alias(f"ratio_{k}")

    return near.groupBy(series, "cadence_hz", "amplitude").agg(harmonic(2), harmonic(3))


def observables(gait: DataFrame, keys: list[str]) -> DataFrame:
    """GRP-03: the signature as named values."""
    return gait.unpivot(keys, ["cadence_hz", "amplitude", "ratio_2", "ratio_3"], "name", "value")


def spectrum_summary(spec: DataFrame, series: str, step_hz: float | None = None, floor: float = 0.2) -> DataFrame:
    """GRP-04: dominant peak above ``floor``, the strongest bin within a fifth of the step rate, and the bin nearest twice it over that."""
    above = F.col("frequency_hz") >= floor
    out = [F.max_by("frequency_hz", F.when(above, F.struct("magnitude", -F.col("bin")))).alias("dominant_hz")]
    if step_hz:
        inside = F.col("frequency_hz").between(0.8 * step_hz, 1.2 * step_hz)
        out += [F.max(F.when(inside, F.col("magnitude"))).alias("step_magnitude"), F.min_by("magnitude", F.struct(F.abs(F.col("frequency_hz") - 2 * step_hz), "bin")).alias("second_magnitude")]
    return spec.groupBy(series).agg(*out)


def magnitude_at(spec: DataFrame, series: str, frequency: float) -> DataFrame:
    """SRT-05: magnitude at the bin nearest a frequency."""
    return spec.groupBy(series).agg(F.min_by("magnitude", F.struct(F.abs(F.col("frequency_hz") - frequency), "bin")).alias("magnitude"))
