"""Streams over files that arrive one after another: rejects, repeats, reruns, completeness and late rows."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.streaming import completeness, ingest


def line(i, label="a", axis="x", ts="2024-01-01T00:00:00", kind="label", **more):
    target = {"axis_id": axis, "kind": kind, "label": label, "embedding": more.pop("embedding", None)}
    return json.dumps({"gen_id": f"g{i}", "axis_id": axis, "target": target, "extra": {"role": "fork", "clip": "c", "s": more.pop("s", 0.5)}, "ts": ts})


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def dirs(tmp_path):
    return {k: str(tmp_path / k) for k in ("in", "good", "rejects", "mark")}, tmp_path / "in"


def run(spark, d):
    stream = ingest.read_journal_stream(spark, d["in"], files_per_batch=1)
    ingest.ingest_journal(stream, d["good"], d["rejects"], d["mark"])
    good = ingest.ingested(spark, d["good"], stream)
    return good, spark.read.parquet(d["rejects"])


def test_rejects_keep_every_reason_and_good_rows_go_on(spark, dirs):
    d, folder = dirs
    put(folder, "1.json", [line(1), line(2, label=" "), "{broken", line(3, s=1.5, label=""), line(4, kind="embedding", label=None, embedding=[1.0, 2.0]), line(5, kind="embedding", label=None, embedding=[]), line(6, kind="odd", ts=None)])
    good, bad = run(spark, d)
    assert {r.gen_id for r in good.collect()} == {"g1", "g4"}
    reasons = {r.gen_id: r.errors for r in bad.collect()}
    assert reasons["g2"] == ["label_empty"] and reasons["g3"] == ["label_empty", "progress_out_of_range"]
    assert reasons["g5"] == ["embedding_bad"] and reasons["g6"] == ["kind_unknown", "time_missing"]
    assert reasons[None][0] == "broken_line" and [r.broken for r in bad.where("gen_id is null").collect()] == ["{broken"]


def test_repeats_are_caught_within_and_across_files_however_late(spark, dirs):
    d, folder = dirs
    put(folder, "1.json", [line(1, "second", ts="2024-01-02T00:00:00"), line(1, "first"), line(2)])
    good, _ = run(spark, d)
    assert {(r.gen_id, r.label) for r in good.collect()} == {("g1", "first"), ("g2", "a")}
    put(folder, "2.json", [line(1, "again", ts="2025-06-01T00:00:00"), line(2), line(1, axis="y"), line(3)])
    good, _ = run(spark, d)
    assert sorted((r.gen_id, r.axis_id, r.label) for r in good.collect()) == [("g1", "x", "first"), ("g1", "y", "a"), ("g2", "x", "a"), ("g3", "x", "a")]
    before = good.count()
    assert run(spark, d)[0].count() == before  # nothing new has arrived


def test_a_batch_that_runs_again_replaces_itself(spark, dirs):
    d, folder = dirs
    put(folder, "1.json", [line(1), line(2)])
    put(folder, "2.json", [line(2), line(3), "{"])
    good, bad = run(spark, d)
    first = sorted((r.batch, r.gen_id) for r in good.collect()), bad.count()
    from gaugeworks.sources.journal import JOURNAL, flattened

    raw = spark.read.schema(f"{JOURNAL}, broken string").option("columnNameOfCorruptRecord", "broken").json(f"{d['in']}/2.json")
    for number in (1, 1):
        ingest.ingest_batch(flattened(raw), number, d["good"], d["rejects"], ingest.KEYS, ingest.journal_rules())
    again = ingest.ingested(spark, d["good"], flattened(raw))
    assert (sorted((r.batch, r.gen_id) for r in again.collect()), spark.read.parquet(d["rejects"]).count()) == first


def events(spark, rows):
    return spark.createDataFrame(rows, "unit long, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def watch(spark, tmp_path, drops, expected):
    folder, status, late, mark = (str(tmp_path / k) for k in ("arriving", "status", "late", "mark"))
    want = spark.createDataFrame(expected, "unit long, expected long")
    for rows in drops:
        events(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("unit long, key string, ts timestamp").parquet(folder)
        completeness.run_monitor(spark, completeness.monitored(stream, want, "unit", "key", delay="1 hour", patience_ms=3_600_000), status, late, mark)
    reports = spark.read.schema("unit long, kind string, ms long, arrived long, expected long").parquet(status)
    return sorted((r.unit, r.kind, r.arrived, r.expected) for r in reports.collect()), sorted((r.unit, r.key) for r in spark.read.schema("unit long, key string, ms long").parquet(late).collect())


def test_late_rows_go_to_their_own_table_and_count_for_nothing(spark, tmp_path):
    first = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:01:00"), (2, "a", "2024-01-02 00:00:00"), (2, "b", "2024-01-02 00:01:00"), (9, "a", "2024-01-02 00:00:00")]
    second = [(1, "b", "2024-01-01 12:00:00"), (3, "a", "2024-01-01 12:00:00"), (2, "c", "2024-01-02 00:30:00")]
    status, late = watch(spark, tmp_path, [first, second], [(1, 2), (2, 2), (3, 1)])
    assert (2, "done", 2, 2) in status and not [s for s in status if s[0] in (3, 9)]
    assert late == [(1, "b"), (3, "a")]
    assert (1, "incomplete", 1, 2) in status and not [s for s in status if s[:2] == (1, "done")]


def test_units_are_done_when_all_distinct_keys_are_there_across_batches(spark, tmp_path):
    drops = [[(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00")], [(1, "b", "2024-01-01 00:10:00"), (1, "a", "2024-01-01 00:11:00")], [(1, "c", "2024-01-01 00:20:00"), (1, "d", "2024-01-01 00:21:00")]]
    status, late = watch(spark, tmp_path, drops, [(1, 3)])
    assert [s for s in status if s[1] == "done"] == [(1, "done", 3, 3)] and late == []
