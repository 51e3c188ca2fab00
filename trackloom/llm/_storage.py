"""Where the operators keep what must outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names no such folder a local one will do only for a session within one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches to Python workers end at ``size``, where the session still has Spark's default of 64 MB.

    Batches end by rows too, but some thousand long texts make a batch of a size that small executors feel twice,
    in the JVM and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(name, size)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, so a lost executor costs one stage, and the planner
    knows the real size when it chooses between broadcast and shuffle joins.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
