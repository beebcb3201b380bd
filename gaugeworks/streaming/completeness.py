"""Completeness monitor: which units have all their measurements, while rows keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import run_available

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
REPORT = ["unit", "kind", "key", "ms", "arrived", "expected"]


class UnitMonitor(StatefulProcessor):
    """Counts the distinct keys of a unit until its expected number is there; the state holds its keys until then, so it
    is bounded by what is expected. One read and one write of the state a unit and batch.

    A unit that is still short ``patience_ms`` after its last row is reported once as incomplete when the watermark
    passes that time, and goes on counting. Rows behind the watermark are late: passed on, never counted.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("unit", "seen array<string>, arrived long, expected long, last_ms long, timer_ms long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        water = timerValues.getCurrentWatermarkInMs()
        seen, arrived, expected, last, timer, done = self.state.get() if self.state.exists() else ([], 0, 0, -1, -1, False)
        seen, out = set(seen or ()), []
        for pdf in rows:
            for k, ms, want in zip(pdf["key"], pdf["ms"].tolist(), pdf["expected"].tolist(), strict=True):
                if water > 0 and ms < water:
                    out.append((key[0], "late", k, ms, arrived, want))
                    continue
                expected, last = want, max(last, ms)
                if not done and k not in seen:
                    seen.add(k)
                    arrived += 1
                    if arrived >= expected:
                        done = True
                        out.append((key[0], "done", k, ms, arrived, expected))
        due = -1 if done or last < 0 else last + self.patience_ms
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.state.update(([] if done else sorted(seen), arrived, expected, last, due, done))
        yield pd.DataFrame(out, columns=REPORT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, arrived, expected, last, _, done = self.state.get()
        self.state.update((seen, arrived, expected, last, -1, done))
        yield pd.DataFrame([] if done else [(key[0], "incomplete", None, last, arrived, expected)], columns=REPORT)

    def close(self) -> None:
        pass


def monitored(stream: DataFrame, expected: DataFrame, unit: str, key: str, ts: str = "ts", delay: str = "1 day", patience_ms: int = DAY_MS) -> DataFrame:
    """Reports (unit, kind, key, ms, arrived, expected) of a stream of measurements against ``expected`` (unit, expected).

    ``done``: the last key that was missing has arrived; ``incomplete``: the unit's time is up; ``late``: a row behind
    the watermark. Rows of units that nothing is expected of are left out. The state holds the keys of open units only.
    """
    marked = stream.withWatermark(ts, delay).join(expected.select(F.col(unit).alias("_unit"), "expected"), F.col(unit) == F.col("_unit"))
    # The time goes on as a plain number: were it the watermark's column, late rows would be dropped unseen.
    rows = marked.select(F.col(unit).alias("unit"), F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("ms"), F.col("expected").cast("long").alias("expected"))
    kind = rows.schema["unit"].dataType.simpleString()
    return rows.groupBy("unit").transformWithStateInPandas(
        UnitMonitor(patience_ms), f"unit {kind}, kind string, key string, ms long, arrived long, expected long", "Append", "EventTime")


def run_monitor(spark: SparkSession, reports: DataFrame, status: str, late: str, checkpoint: str) -> None:
    """Write what has arrived: reports of units to ``status``, late rows to ``late``. A batch that is run again replaces its own files."""

    def split(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("kind <> 'late'").select("unit", "kind", "ms", "arrived", "expected").write.mode("overwrite").parquet(f"{status}/batch={number}")
        kept.where("kind = 'late'").select("unit", "key", "ms").write.mode("overwrite").parquet(f"{late}/batch={number}")
        kept.unpersist()

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        run_available(reports, status, checkpoint, "append", split)
    finally:
        spark.conf.set(name, before)
