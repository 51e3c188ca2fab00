"""Near-duplicate vectors: spherical k-means cells, blocked cosines within cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._graph import components
from trackloom.llm._storage import settle


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``k`` unit centres of the rows of ``unit``; fewer if there are fewer rows."""
    random = np.random.Generator(np.random.PCG64(seed))
    centres = unit[random.permutation(len(unit))[:k]]
    for _ in range(rounds):
        cell = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, unit)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centres)
    return centres


def _described(vectors: DataFrame) -> DataFrame:
    """vec_id, and for vectors that can link: label, dim, digest of label and components in two halves, unit vector as bytes."""

    def run(batches):
        for batch in batches:
            ids, others, units, dims = [], [], [], []
            for label, vector in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                x = np.array(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64) if vector.is_valid and not vector.values.null_count else np.zeros(0)
                largest = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0
                good = label is not None and largest > 0
                digest = b""
                if good:
                    x = x / largest
                    x = x / np.linalg.norm(x)
                    digest = hashlib.blake2b(x.tobytes() + f"{label}".encode(), digest_size=16).digest()
                ids.append(int.from_bytes(digest[:8], "little", signed=True) if good else None)
                others.append(int.from_bytes(digest[8:], "little", signed=True) if good else None)
                units.append(x.tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ids, pa.int64()), pa.array(others, pa.int64()), batch.column("label"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "cid", "other", "label", "dim", "unit"])

    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.mapInArrow(run, "vec_id long, cid long, other long, label long, dim int, unit binary")


def _told_apart(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` with a cid for each distinct vector of a label: where different ones share the first 64 bits of their digest, the other 64 serve."""
    both = rows.where("cid is not null").groupBy("cid").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("cid").limit(most + 1).collect()
    if len(both) > most:
        raise RuntimeError("too many vectors share a digest")
    clash = F.col("cid").isin(*[r.cid for r in both]) if both else F.lit(False)
    return rows.withColumn("cid", F.when(clash, F.col("other")).otherwise(F.col("cid"))).drop("other")


def _apart(centre: np.ndarray) -> np.ndarray:
    """Distances of unit centres from one another, never too small: 2 - 2 cos is out by some 1e-15 a component."""
    square = np.clip(2 - 2 * (centre @ centre.T), 0, None)
    return np.sqrt(square + 1e-12)


def _placed(classes: DataFrame, centres: dict[int, np.ndarray], angle: float) -> DataFrame:
    """A row for each cell a vector belongs to: its home, and as a guest those in reach.

    If u is at home in a and v in c, each lies on its own side of the plane between the centres,
    so one of them is within half the angle between u and v of it. A vector that near to the
    plane between its home and another cell is therefore a guest there, and every linked pair
    meets in the home of one of them.
    """
    shared = classes.sparkSession.sparkContext.broadcast({dim: (centre, _apart(centre)) for dim, centre in centres.items()})
    reach = math.sin(angle / 2) + 1e-9

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                unit = np.stack([np.frombuffer(table.column("unit")[int(i)].as_py()) for i in rows])
                centre, apart = shared.value[int(dim)]
                for at in range(0, len(rows), 2048):
                    near = unit[at : at + 2048] @ centre.T
                    home = near.argmax(axis=1)
                    inside = near[np.arange(len(home)), home][:, None] - near <= reach * apart[home]
                    inside[np.arange(len(home)), home] = True
                    i, c = np.nonzero(inside)
                    part = table.take(pa.array(rows[at + i]))
                    cells = [np.flatnonzero(x).astype(np.int32) for x in inside]
                    yield from part.append_column("cell", pa.array(c.astype(np.int32))).append_column("home", pa.array(home[i].astype(np.int32))).append_column("cells", pa.array([cells[k] for k in i], pa.list_(pa.int32()))).to_batches()

    return classes.mapInArrow(run, "cid long, label long, dim int, unit binary, copies long, cell int, home int, cells array<int>")


def _linked(placed: DataFrame, cosine: float, block: int) -> DataFrame:
    """(cid, root, links): for each block pair and vector its links there, and a vector of its group there."""
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = placed.join(sizes, cell).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        cid, copies, home, own = (table.column(c).to_numpy() for c in ("cid", "copies", "home", "own"))
        here, low, high = (table.column(c)[0].as_py() for c in ("cell", "low", "high"))
        unit = np.stack([np.frombuffer(x.as_py()) for x in table.column("unit")])
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if low != high:  # pairs within one block are held against each other where it meets itself
            near &= own[:, None] != own[None, :]
        # a pair counts in its common home, or else in the lower of those homes that it shares
        shared = np.zeros((len(cid), len(cid)), dtype=bool)
        at_home = home == here
        mine, guests = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        shared[np.ix_(mine, mine)] = True
        homes, which = np.unique(home[guests], return_inverse=True)
        cells = table.column("cells").take(pa.array(mine))
        also = np.array([np.isin(homes, x.values.to_numpy()) for x in cells], dtype=bool).reshape(len(mine), len(homes))[:, which]
        count_here = ~also | (here < home[guests])[None, :]
        shared[np.ix_(mine, guests)] = count_here
        shared[np.ix_(guests, mine)] = count_here.T
        near &= shared
        links = near @ copies
        root = np.arange(len(cid), dtype=np.int32)
        while True:
            spread = np.minimum(root, np.where(near, root[None, :], np.int32(len(cid))).min(axis=1, initial=len(cid)))
            if (spread == root).all():
                break
            root = spread
        keep = links > 0
        return pa.table({"cid": pa.array(cid[keep]), "root": pa.array(cid[root[keep]]), "links": pa.array(links[keep].astype(np.int64))})

    columns = ["cid", "copies", "home", "cells", "unit", "own", *cell, "low", "high"]
    return met.select(*columns).groupBy(*cell, "low", "high").applyInArrow(run, "cid long, root long, links long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, block: int = 1024, cell_rows: int = 256, most_cells: int = 2048, sample_rows: int = 16_384) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null, they have the same number of components
    and their cosine in double precision is at least ``cosine``. Null and zero vectors and those that
    hold a null or non-finite component link with nothing and are their own component. Equal
    vectors of a label are one class, compared once and counted as often as they occur; repeated
    rows link with each other. component_id is the smallest vec_id reachable by links; kept marks
    the vector that carries it. A null vec_id takes part and has a null component only among
    its like; no rows give no rows; other columns are not read.

    The cells are fitted to a sample of at most ``sample_rows`` vectors, those of least hash, and
    number one for each ``cell_rows`` of a typical label, ``most_cells`` at most. All vectors are
    placed, guests by an exact bound, so no link is lost; cells larger than ``block`` are compared
    block by block. Linked pairs are counted where they meet; of each group there only a star goes
    on to the components.
    """
    spark = vectors.sparkSession
    rows = _told_apart(settle(_described(vectors), "vectors"))
    good = rows.where("cid is not null")
    classes = settle(good.groupBy("cid").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.count("*").alias("copies")), "vector-classes")
    per_label = classes.groupBy("label", "dim").count()
    typical = per_label.groupBy("dim").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("rows")).collect()
    centres = {}
    for dim, size in typical:
        sample = classes.where(F.col("dim") == dim).select("cid", "unit").orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).collect()
        unit = np.stack([np.frombuffer(r.unit) for r in sample])
        centres[dim] = spherical_kmeans(unit, max(1, min(most_cells, math.ceil(size / cell_rows), max(1, len(sample) // 4))))
    found = settle(_linked(_placed(classes, centres, math.acos(cosine)), cosine, block), "vector-links")
    roots = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    least = good.groupBy("cid").agg(F.min("vec_id").alias("least"))
    told = classes.select("cid", "copies").join(least, "cid").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    told = told.select("cid", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    names = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = settle(told.join(names, "root").select("cid", "n_links", "component_id"), "vector-components")
    full = good.join(told, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
