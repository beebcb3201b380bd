"""Queries of streams and user-code hooks (SURVEY L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks
from ..operators import agreement as ag
from ..operators import resampling as rs
from ..sources import journal as jn
from ..streaming import completeness, ingest
from .bindings import r6, table
from .catalog import query
from .data import scratch
from .draws import ci, draws


def events(spark, d):
    # The file source wants a folder: the glob picks the one table.
    schema = table(spark, d, "events").schema
    return ingest.read_events(spark, f"{d}/events.parquet*", schema)


def event_lines(e):
    """Events as journal lines: every 50th broken off, every 7th without its label."""
    number = F.col("event_id")
    rows = e.select(
        number, F.concat(F.lit("e"), number.cast("string")).alias("gen_id"), F.lit("type").alias("axis_id"), F.lit("label").alias("kind"), F.when(number % 7 == 0, "").otherwise(F.col("event_type")).alias("label"),
        F.lit("fork").alias("role"), F.col("user_id").cast("string").alias("clip"), F.round(F.dayofmonth("ts") / 31.0, 6).alias("s"), F.col("ts").cast("timestamp").alias("ts"))
    return jn.journal_line(rows, "event_id").select(F.when(F.col("event_id") % 50 == 0, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))


@query("l01_stream_ingest", """WITH x AS (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN 'broken_line' WHEN event_id % 7 = 0 THEN 'label_empty' ELSE 'ok' END AS outcome, event_id % 11 = 0 AS again FROM events),
 n AS (SELECT outcome, CASE WHEN outcome = 'ok' THEN event_type END AS label, CASE WHEN outcome <> 'ok' AND again THEN 2 ELSE 1 END AS n FROM x) SELECT outcome, label, sum(n)::BIGINT AS n FROM n GROUP BY ALL""")
def l01(spark, d):
    """Two runs over a folder of lines: the second brings every 11th event again and must add nothing but its rejects."""
    e = table(spark, d, "events")
    folder, good, rejects, mark = (scratch(spark, name) for name in ("lines", "good", "rejects", "mark"))
    for arrived in (e, e.where("event_id % 11 = 0")):
        event_lines(arrived).write.mode("append").text(folder)
        stream = ingest.read_journal_stream(spark, folder)
        ingest.ingest_journal(stream, good, rejects, mark)
    ok = ingest.ingested(spark, good, stream).groupBy(F.lit("ok").alias("outcome"), "label").agg(F.count(F.lit(1)).alias("n"))
    # every line that is broken lacks all fields: its first reason tells
    bad = spark.read.parquet(rejects).groupBy(F.get("errors", F.lit(0)).alias("outcome"), F.lit(None).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return ok.unionByName(bad)


@query("l02_incremental_agreement", "WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) SELECT user_id, round(CASE WHEN sum(c) < 2 THEN 1.0 ELSE sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) END, 6) AS agreement, sum(c)::BIGINT AS n FROM c GROUP BY user_id")
def l02(spark, d):
    out, mark = scratch(spark, "counts"), scratch(spark, "mark")

    def merge(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}-part")

    ingest.run_available(ingest.label_counts(events(spark, d), ["user_id"], "event_type"), out, mark, "update", merge)
    seen = spark.read.schema("user_id long, event_type string, c long, epoch long").parquet(f"{out}/*")
    latest = seen.groupBy("user_id", "event_type").agg(F.max_by("c", "epoch").alias("c"))
    return latest.groupBy("user_id").agg(r6(ag.pair_share(), "agreement"), F.sum("c").alias("n"))


#: Every 97th event of all but the last days comes when the others are through; the watermark is a day behind the newest.
LATE = "event_id % 97 = 0 AND ts < (SELECT max(ts) FROM events WHERE event_id % 97 <> 0) - INTERVAL 2 DAY"


@query("l03_completeness", f"""WITH x AS (SELECT user_id, {LATE} AS late FROM events), u AS (SELECT user_id, 1 + user_id % 80 AS expected, count(*) FILTER (NOT late) AS arrived, count(*) FILTER (late) AS late FROM x GROUP BY user_id)
 SELECT user_id, expected, arrived >= expected AS done, late FROM u""")
def l03(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = e.where("event_id % 97 <> 0").agg(F.max("ts").alias("newest"))
    marked = e.join(newest).withColumn("late", (F.col("event_id") % 97 == 0) & (F.col("ts") < F.col("newest") - F.expr("INTERVAL 2 DAYS"))).drop("newest")
    folder, status, late, mark = (scratch(spark, name) for name in ("arriving", "status", "late", "mark"))
    expected = e.select("user_id", (1 + F.col("user_id") % 80).alias("expected")).distinct()
    for part in (marked.where("not late"), marked.where("late")):
        part.drop("late").write.mode("append").parquet(folder)
        stream = ingest.read_events(spark, folder, e.schema)
        completeness.run_monitor(spark, completeness.monitored(stream, expected, "user_id", "event_id"), status, late, mark)
    done = spark.read.schema("unit long, kind string, ms long, arrived long, expected long").parquet(status).where("kind = 'done'").select(F.col("unit").alias("user_id"), F.lit(True).alias("done"))
    behind = spark.read.schema("unit long, key string, ms long").parquet(late).groupBy(F.col("unit").alias("user_id")).agg(F.count(F.lit(1)).alias("late"))
    return expected.join(done, "user_id", "left").join(behind, "user_id", "left").select("user_id", "expected", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("late", F.lit(0)).alias("late"))


@query("m01_pluggable_statistic", f"""WITH v AS (SELECT o_orderpriority AS axis, o_custkey AS unit, avg(o_totalprice) AS v FROM orders GROUP BY ALL), {draws("v", "stat", 10)},
 rp AS (SELECT axis, b, max(v) - min(v) AS m FROM wt JOIN v USING (unit) WHERE b >= 0 AND w > 0 GROUP BY ALL), c AS ({ci("m", "rp")}) SELECT axis, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, replicates FROM c""")
def m01(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("axis"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("v"))
    return rs.bootstrap_statistic(v, ["axis"], "unit", "v", lambda x: float(x.max() - x.min()), 10).select("axis", r6("ci_low"), r6("ci_high"), "replicates")


@query("m02_pluggable_measurer", "SELECT doc_id, CASE WHEN len(text) = 0 THEN 'empty' WHEN contains(text, 'the') THEN 'english' ELSE 'other' END AS label FROM documents WHERE text IS NOT NULL")
def m02(spark, d):
    def measure(text: str) -> str:
        return "empty" if not text else "english" if "the" in text else "other"

    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return hooks.measured(docs, "text", measure).select("doc_id", "label")


@query("m02_vector_measurer", "SELECT doc_id, len(text)::DOUBLE AS chars, (len(text) - len(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents WHERE text IS NOT NULL")
def m02_vectors(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    got = hooks.measured(docs, "text", lambda text: [len(text), text.count(" ")])
    return got.select("doc_id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("blanks"))
