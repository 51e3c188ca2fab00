"""A register of layers' contents: what derived layers were made of, and whether that still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUM = "decimal(38,0)"


def chunk_sums(cells: DataFrame, chunk: int) -> DataFrame:
    """AGG-37: (layer, kx, ky, sum, n) of cells(layer, cx, cy, value): hashes of a chunk's cells added up, which any order of rows gives alike."""
    hashed = F.xxhash64("cx", "cy", F.col("value").cast("double")).cast(_SUM)
    return cells.groupBy("layer", F.floor(F.col("cx") / chunk).alias("kx"), F.floor(F.col("cy") / chunk).alias("ky")).agg(F.sum(hashed).cast(_SUM).alias("sum"), F.count("*").alias("n"))


def changed_sums(sums: DataFrame, removed: DataFrame, added: DataFrame, chunk: int) -> DataFrame:
    """AGG-37: ``sums`` after cells were taken out and put in, from these alone; what a cell was is taken out, what it is is put in."""
    parts = [sums, chunk_sums(added, chunk), chunk_sums(removed, chunk).withColumns({"sum": -F.col("sum"), "n": -F.col("n")})]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("layer", "kx", "ky").agg(F.sum("sum").cast(_SUM).alias("sum"), F.sum("n").alias("n")).where("n <> 0 or sum <> 0")


def layer_fingerprints(sums: DataFrame) -> DataFrame:
    """AGG-37: (layer, fingerprint) of layers with a cell or more."""
    hashed = F.xxhash64("kx", "ky", F.col("sum").cast("string"), "n").cast(_SUM)
    return sums.groupBy("layer").agg(F.sum(hashed).cast(_SUM).alias("_s"), F.count("*").alias("_n")).select("layer", F.xxhash64(F.col("_s").cast("string"), "_n").alias("fingerprint"))


def derived_entries(fingerprints: DataFrame, made: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG-37: register entries (derived, inputs, params, version) of made(derived, params, version) from sources(derived, layer), in any order; a source without content counts as such."""
    hashed = F.xxhash64("layer", F.coalesce("fingerprint", F.lit(0).cast("long"))).cast(_SUM)
    inputs = sources.select("derived", "layer").distinct().join(fingerprints, "layer", "left").groupBy("derived").agg(F.xxhash64(F.sum(hashed).cast("string"), F.count("*")).alias("inputs"))
    return made.join(inputs, "derived", "left").select("derived", F.coalesce("inputs", F.lit(0).cast("long")).alias("inputs"), F.xxhash64(F.col("params").cast("string")).alias("params"), "version")


def verified(register: DataFrame, now: DataFrame) -> DataFrame:
    """AGG-37: (derived, status) of each entry of ``now``, what it would be made of today, against ``register``: valid, or why it is stale."""
    old = register.select("derived", *[F.col(c).alias(f"_{c}") for c in ("inputs", "params", "version")], F.lit(True).alias("_held"))
    status = F.when(F.col("_held").isNull(), "unregistered").when(~F.col("version").eqNullSafe(F.col("_version")), "version").when(~F.col("inputs").eqNullSafe(F.col("_inputs")), "inputs").when(~F.col("params").eqNullSafe(F.col("_params")), "parameters").otherwise("valid")
    return now.join(old, "derived", "left").select("derived", status.alias("status"))
