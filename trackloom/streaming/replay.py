"""Run a stream over what has arrived, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trackloom.sources.shared import shared_path


def open_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream of its files, all at once unless told: files have no order in time, so the watermark of one would make the next one's rows late."""
    path = f"{sf_dir}/{name}.parquet"
    pattern = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"  # a pattern may name one file as well as a folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(pattern)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer: Callable[[], StreamingQuery], spark: SparkSession) -> StreamingQuery:
    """Start a query with the state store that stateful processors need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return writer()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def replay(stream: DataFrame) -> DataFrame:
    """Process all that is there and return the appended rows, from a table in the shared folder."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    start(lambda: writer.start(f"{out}/rows"), spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
