"""Search for the best parameters of many groups at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.shared import settled

_LEAST_GAIN = 2.0**-52


def coordinate_search(start: DataFrame, key: str, knobs: dict[str, tuple[float, float]], score: Callable[[DataFrame], DataFrame], first: float = 0.15, least: float = 0.01, most: int = 400, rounds: int = 1000) -> DataFrame:
    """JON-22: (key, knobs, loss, evaluations) after a search along the coordinates, for each row of ``start(key, knobs)``.

    In a round every knob of every group is moved up and down by its step, within its bounds, and all these candidates are
    scored in one job: ``score`` takes (key, candidate, knobs) and gives (key, candidate, loss) of each. A group goes to its best
    candidate if that lowers its loss; else its steps, which begin at ``first`` of a knob's range, are halved down
    to ``least`` of it. It ends when no step is left to halve, or after ``most`` evaluations. A candidate without a loss, or with NaN, is
    not taken. Each round's state, a row a group, is written to the shared folder.
    """
    names = list(knobs)
    span = [F.lit(float(high - low)) for low, high in knobs.values()]
    begun = start.select(key, *names, F.lit(0).alias("candidate"))
    losses = score(begun).select(key, "candidate", F.col("loss").cast("double").alias("loss"))
    state = begun.join(losses, [key, "candidate"], "left").select(key, *[F.col(n).cast("double").alias(n) for n in names], F.coalesce(F.nanvl("loss", F.lit(float("inf"))), F.lit(float("inf"))).alias("loss"), *[(s * first).alias(f"_s_{n}") for n, s in zip(names, span)], F.lit(1).alias("evaluations"), (F.lit(1) >= most).alias("_done"))
    state = settled(state, "search")
    for _ in range(rounds):
        if state.where("not _done").limit(1).count() == 0:
            return state.select(key, *names, "loss", "evaluations")
        state = settled(_round(state, key, knobs, score, least, most), "search")
    raise RuntimeError(f"{rounds} rounds do not end the search")


def _round(state: DataFrame, key: str, knobs: dict[str, tuple[float, float]], score, least: float, most: int) -> DataFrame:
    names = list(knobs)
    moves = [F.struct(F.lit(2 * k + (sign < 0)).alias("candidate"), *[(F.col(n) + sign * F.col(f"_s_{n}") if n == moved else F.col(n)).alias(n) for n in names]) for k, moved in enumerate(names) for sign in (1, -1)]
    asked = state.where("not _done").select(key, F.explode(F.array(*moves)).alias("m")).select(key, "m.*")
    for n, (low, high) in knobs.items():
        asked = asked.where(F.col(n).between(low, high))
    scored = asked.join(score(asked).select(key, "candidate", F.col("loss").cast("double").alias("_loss")), [key, "candidate"], "left")
    best = scored.groupBy(key).agg(F.count("*").cast("int").alias("_tried"), F.min(F.when(~F.isnan("_loss"), F.struct("_loss", "candidate", *names))).alias("_best"))
    met = state.join(best, key, "left").withColumn("_tried", F.coalesce("_tried", F.lit(0)))
    better = ~F.col("_done") & F.coalesce(F.col("_best._loss") < F.col("loss") - _LEAST_GAIN, F.lit(False))
    floors = {n: (high - low) * least for n, (low, high) in knobs.items()}
    shrinks = F.lit(False)
    for n in names:
        shrinks = shrinks | (F.col(f"_s_{n}") > floors[n])
    after = F.col("evaluations") + F.col("_tried")
    return met.select(
        key,
        *[F.when(better, F.col(f"_best.{n}")).otherwise(F.col(n)).alias(n) for n in names],
        F.when(better, F.col("_best._loss")).otherwise(F.col("loss")).alias("loss"),
        *[F.when(~better & ~F.col("_done") & (F.col(f"_s_{n}") > floors[n]), F.col(f"_s_{n}") / 2).otherwise(F.col(f"_s_{n}")).alias(f"_s_{n}") for n in names],
        after.alias("evaluations"),
        (F.col("_done") | (~better & ~shrinks) | (after >= most)).alias("_done"),
    )
