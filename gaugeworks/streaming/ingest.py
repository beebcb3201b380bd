"""Streams over the journal: ingest with rejects and exact deduplication, incremental label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.checks import with_errors
from ..sources.journal import JOURNAL, flattened

KEYS = ["gen_id", "axis_id"]


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", partial=None) -> None:
    """Process everything that has arrived and stop; the checkpoint makes a later call go on from there."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = (writer.foreachBatch(partial) if partial else writer.format("parquet").option("path", out)).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream of Parquet rows; ``ts`` becomes a timestamp that watermarks understand."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_journal_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Journal lines that appear in a folder, flat, a broken line's text in ``broken``."""
    raw = spark.readStream.schema(f"{JOURNAL}, broken string").option("columnNameOfCorruptRecord", "broken").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return flattened(raw)


def journal_rules() -> dict[str, Column]:
    """What a journal row must fulfil: code and the condition under which it is broken."""
    c = F.col
    kind = F.coalesce(c("kind"), F.lit(""))
    return {
        "broken_line": c("broken").isNotNull(),
        "id_missing": F.coalesce(c("gen_id"), F.lit("")) == "",
        "axis_missing": F.coalesce(c("axis_id"), F.lit("")) == "",
        "kind_unknown": ~kind.isin("label", "embedding"),
        "label_empty": (kind == "label") & (F.coalesce(F.trim("label"), F.lit("")) == ""),
        "embedding_bad": (kind == "embedding") & (F.coalesce(F.size("embedding"), F.lit(0)) < 1),
        "embedding_not_finite": F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        "progress_out_of_range": ~c("s").between(0, 1),
        "time_missing": c("ts").isNull(),
    }


def ingest_batch(batch: DataFrame, number: int, good: str, rejects: str, keys: list[str], rules: dict[str, Column]) -> None:
    """One batch: rows that break a rule go to ``rejects`` with all their reasons, the others to ``good`` unless their keys
    are there already. Of rows with one key the earliest stays. Both go to a folder of the batch's own, which a batch
    that is run again replaces, and only earlier batches count as ingested: so it may run any number of times.
    """
    spark = batch.sparkSession
    checked = with_errors(batch, rules).persist()
    try:
        bad = checked.where(F.size("errors") > 0)
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", F.to_json(F.struct(*batch.columns))))
        fresh = checked.where(F.size("errors") == 0).drop("errors").withColumn("_first", first).where("_first = 1").drop("_first")
        if number > 0:
            # The folder is a partition column: later batches are not even listed as inputs, and only keys are read.
            fresh = fresh.join(ingested(spark, good, batch).where(F.col("batch") < number).select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{good}/batch={number}")
    finally:
        checked.unpersist()


def ingested(spark: SparkSession, good: str, like: DataFrame) -> DataFrame:
    """What ``ingest_batch`` has written so far, with the number of its batch."""
    return spark.read.schema(StructType([*like.schema.fields, StructField("batch", LongType())])).parquet(good)


def ingest_journal(stream: DataFrame, good: str, rejects: str, checkpoint: str, keys: list[str] | None = None, rules: dict[str, Column] | None = None) -> None:
    """Ingest what has arrived and stop: see ``ingest_batch``. Repeats are caught however far apart they come."""
    wanted, tests = keys or KEYS, rules or journal_rules()
    run_available(stream, good, checkpoint, "append", lambda batch, number: ingest_batch(batch, number, good, rejects, wanted, tests))


def label_counts(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Running counts per key and label; ratios are taken from them in batch, never averaged."""
    return stream.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c"))
