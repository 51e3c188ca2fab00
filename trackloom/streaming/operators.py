"""Streaming twins of the time-based operators that need no state of their own; see ``processors`` for those that do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.streaming.processors import TERMINAL


def first_terminal(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """STR-03: one terminal event a task and type within the watermark."""
    return events.where(F.col("type").isin(*TERMINAL)).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["task_id", "type"])


def speed_windows(samples: DataFrame, time: str, width: str = "1 minute", watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """STR-08: count, mean and maximum of running speeds by event-time window, every ``slide`` or one after another; rows later than the watermark do not count."""
    late = samples.withWatermark(time, watermark) if samples.isStreaming else samples
    windows = late.groupBy(F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean"), F.max("speed").alias("top"))
    return windows.select(F.col("w.start").alias("start"), "n", "mean", "top")


def sessions(samples: DataFrame, run: str, time: str, gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """STR-08: rows and mean speed of each stretch without a longer gap."""
    late = samples.withWatermark(time, watermark) if samples.isStreaming else samples
    return late.groupBy(run, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean")).select(run, F.col("w.start").alias("start"), "n", "mean")


class RepairedWindows:
    """STR-09: speed windows of a stream that also take the rows that its watermark would drop.

    Used as the sink of ``foreachBatch``. Of each batch it writes the windows' partial sums, the rows that
    were late, which are those of windows that the latest time of the batches before, less ``delay``, had passed,
    and the batch's own latest time, each into a folder of the batch's number. A batch
    that is run again after a failure writes the same folders over, so nothing counts twice. ``windows``
    adds the partial sums up; which of them late rows have changed is told.
    """

    PARTS = "start timestamp, n long, total double, top double, late long"

    def __init__(self, spark: SparkSession, folder: str, time: str, width: str = "1 minute", delay: str = "10 minutes"):
        self.spark, self.folder, self.time, self.width, self.delay = spark, folder.rstrip("/"), time, width, delay

    def __call__(self, rows: DataFrame, batch: int) -> None:
        window = F.window(self.time, self.width)
        mark = self._mark(batch)
        late = F.lit(False) if mark is None else window["end"] <= F.lit(mark)
        told = rows.where(F.col(self.time).isNotNull()).withColumn("_start", window["start"]).withColumn("_late", late).persist()
        try:
            parts = told.groupBy(F.col("_start").alias("start")).agg(F.count("*").alias("n"), F.sum("speed").alias("total"), F.max("speed").alias("top"), F.count_if("_late").alias("late"))
            parts.write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch}")
            told.where("_late").drop("_start", "_late").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch}")
            told.agg(F.max(self.time).alias("at")).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch}")  # last: it says that the batch is whole
        finally:
            told.unpersist()

    def _mark(self, batch: int):
        """The watermark that a stream has before a batch: the latest time of the batches before it, less the delay."""
        if batch == 0:
            return None
        marks = self.spark.read.schema("at timestamp, batch long").parquet(f"{self.folder}/marks").where(F.col("batch") < batch)
        return marks.agg((F.max("at") - F.expr(f"INTERVAL {self.delay}")).alias("mark")).first().mark

    def windows(self) -> DataFrame:
        """(start, n, mean, top, repaired) of all rows so far."""
        parts = self.spark.read.schema(f"{self.PARTS}, batch long").parquet(f"{self.folder}/parts")
        return parts.groupBy("start").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("top").alias("top"), (F.sum("late") > 0).alias("repaired"))

    def late(self, schema: str) -> DataFrame:
        """The late rows, as they came."""
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/late")


def framed(writer, sink: Callable[[DataFrame, int], None]):
    """STR-07: deliver a stream frame by frame; the reader's maxFilesPerTrigger sets their size, the next one waits for the sink."""
    return writer.foreachBatch(sink)
