"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "file:///tmp/checkpoints/gaugeworks"  # for local masters only


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or LOCAL_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what several branches of a plan read is computed once, and survives lost executors."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list, rows: int = 400_000) -> DataFrame:
    """``df`` dealt by ``keys`` over so many partitions that each gets about ``rows`` rows, however long the table is.

    The rows are counted, so ``df`` should be a table that is read, not one that is computed.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
