"""Hooks for user code: a measurer on payloads, run once per distinct content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 1000  # payloads that a worker gets at a time
MEASURED = [pa.field("label", pa.string()), pa.field("embedding", pa.list_(pa.float64())), pa.field("error", pa.string())]


def measured(df: DataFrame, payload: str, measure: Callable[[str], str | list[float]]) -> DataFrame:
    """Add label, embedding and error of ``measure(payload)``: text makes a label, a sequence of numbers an embedding.

    Equal payloads are measured once. Errors become the name of their kind, rows stay; a null payload is not measured.
    Workers get at most BATCH payloads at a time (for that, Arrow's batches are made smaller in this session) and make
    one of them an object at a time, however many a partition holds.
    """
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(batches)) <= BATCH:
        df.sparkSession.conf.set(batches, str(BATCH))

    @F.arrow_udf("struct<label string, embedding array<double>, error string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = []
            for p in part:  # one payload at a time becomes an object
                try:
                    got = None if not p.is_valid else measure(p.as_py())
                    rows.append((got, None, None) if got is None or isinstance(got, str) else (None, [float(x) for x in got], None))
                except Exception as e:  # the measurer is user code
                    rows.append((None, None, type(e).__name__))
            columns = zip(zip(*rows, strict=True), MEASURED, strict=True) if rows else (((), f) for f in MEASURED)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in columns], fields=MEASURED)

    keyed = df.withColumn("_key", F.sha2(F.col(payload), 256))
    once = keyed.where(F.col(payload).isNotNull()).groupBy("_key").agg(F.min(payload).alias("_p")).withColumn("_m", run("_p"))
    return keyed.join(once.select("_key", "_m.label", "_m.embedding", "_m.error"), "_key", "left").drop("_key")
