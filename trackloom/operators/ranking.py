"""Global order without one task: ranks by ranges, and tables that are renumbered and merged by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.sources.shared import settled

_PART = 1 << 33  #: monotonically_increasing_id counts a partition's rows from its number times this on


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", within: str | None = None) -> DataFrame:
    """SRT-04: ``df`` with each row's place in ``order``, from 1; ``within`` counts each of its groups for itself.

    Rows are dealt in ranges of the order, sorted and numbered in each, and written; the numbers of
    rows in the ranges before, one small row a range and group, are added. Ties keep some order of theirs.
    """
    keys = [F.col(within)] if within else []
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = settled(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_part", F.floor(F.col("_at") / _PART))
    group = within or "_all"
    group = within or "_part"
    held = rows.groupBy(*{"_part", group}).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    if within:
        before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))  # a row a range and group
        starts = held.select(F.col("_part").alias("_of"), F.col(group).alias("_group"), "_first", before.alias("_before"))
        met = rows.join(starts, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    else:
        counts = sorted(map(tuple, held.select("_part", "_first", "_n").collect()))  # a row a range
        sums = [sum(n for _, _, n in counts[:k]) for k in range(len(counts))]
        starts = df.sparkSession.createDataFrame([(part, first, before) for (part, first, _), before in zip(counts, sums, strict=True)], "_part long, _first long, _before long")
        met = rows.join(F.broadcast(starts), "_part")
    return met.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def merged_regions(features: DataFrame, outlines: DataFrame, new_features: DataFrame, new_outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON-24: region sets with further ones put in: (features, outlines), by set.

    ``features(set, tag, geom_ref, ..)`` name an outline of their set, ``outlines(set, ref, ..)``; the new ones' references
    are to the new outlines of their own set, by whatever numbers these have. New outlines are numbered on, without holes, behind those
    that a set has; a new feature takes the place of that with its tag, its reference rewritten. Old outlines stay, named or
    not. A reference to no new outline fails the query.
    """
    held = outlines.groupBy("set").agg(F.max("ref").alias("_last"))
    dense = global_rank(new_outlines, [F.col("ref")], "_rank", within="set").join(held, "set", "left")
    placed = dense.withColumn("_new", F.coalesce(F.col("_last") + 1, F.lit(0).cast("long")) + F.col("_rank") - 1)
    moved = new_features.join(placed.select("set", F.col("ref").alias("geom_ref"), "_new"), ["set", "geom_ref"], "left")
    found = F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("no outline "), F.coalesce(F.col("geom_ref").cast("string"), F.lit("null")))).cast("long"))
    moved = moved.withColumn("geom_ref", found).select(*features.columns)
    kept = features.join(new_features.select("set", "tag").distinct(), ["set", "tag"], "left_anti").select(*features.columns)
    return kept.unionByName(moved), outlines.unionByName(placed.withColumn("ref", F.col("_new")).select(*outlines.columns))
