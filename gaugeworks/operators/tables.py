"""Joins and filters between tables of units: registries, ledgers, catalogs, labels, grids, events, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curves import status


def registry_check(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The axis registry (axis, tier, kind, metric) with whether kind and metric fit, and how many rows each axis has."""
    n = rows.groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
    fits = (F.col("kind") == "embedding") == (F.col("metric") == "cosine")
    return registry.join(n, "axis", "left").withColumn("coupled", fits).withColumn("n", F.coalesce("n", F.lit(0)))


def write_results(cells: DataFrame, windows: DataFrame, keys: list[str], path: str, columns: list[str] | None = None) -> None:
    """Cells with their windows' columns beside them, in a fixed order of columns, as Parquet."""
    joined = cells.join(windows, keys, "left")
    joined.select(*(columns or joined.columns)).write.parquet(path)


def certified(rows: DataFrame, ledger: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Add ``reason``: ratified, not_ok or not_in_ledger."""
    marked = ledger.select(*keys, F.col(ok).alias("_ok"), F.lit(True).alias("_in"))
    reason = F.when(F.col("_in").isNull(), "not_in_ledger").when(F.col("_ok"), "ratified").otherwise("not_ok")
    return rows.join(marked, keys, "left").withColumn("reason", reason).drop("_ok", "_in")


def homogeneous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many different values the keys have together, and whether it is one."""
    return rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("settings")).withColumn("homogeneous", F.col("settings") == 1)


def event_catalog(events: DataFrame, unit: str, event: str, anchor: Column, inside: Column, declared_least: int) -> DataFrame:
    """Events recounted per unit: events, anchors, those inside their bounds, whether ids are unique and the number is as declared."""
    per = events.groupBy(unit, event).agg(F.count(F.lit(1)).alias("_n"), F.count_if(anchor).alias("_a"), F.count_if(inside).alias("_i"))
    return per.groupBy(unit).agg(
        F.sum("_n").alias("events"), F.sum("_a").alias("anchors"), F.sum("_i").alias("inside"), (F.max("_n") == 1).alias("unique_ids"), (F.sum("_n") >= declared_least).alias("declared_ok"))


def underpowered(rows: DataFrame, least: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """keys, min_n, n, underpowered: units against the registered least number of each key."""
    return rows.groupBy(*keys).agg(F.count_distinct(unit).alias("n")).join(least, keys).select(*keys, "min_n", "n", (F.col("n") < F.col("min_n")).alias("underpowered"))


def eligible(pool: DataFrame, rule: Column, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the pool that fulfil the rule and are not excluded."""
    return pool.where(rule).join(excluded.select(*keys).distinct(), keys, "left_anti")


def preflight(tasks: list[DataFrame], index: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, tasks, reason: the task lists merged, joined with the index, and the first check that fails (null: none).

    A key that is not in the index fails as ``index_join_missing``; a key may be in several lists.
    """
    merged = reduce(DataFrame.unionByName, tasks).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("task")), "+").alias("tasks"))
    found = index.withColumn("_found", F.lit(True))
    reason = F.coalesce(F.when(F.col("_found").isNull(), "index_join_missing"), *(F.when(bad, code) for code, bad in checks.items()))
    return merged.join(found, key, "left").select(key, "tasks", reason.alias("reason"))


def with_labels(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their labels, and ``status``: ok or label_missing."""
    return rows.join(labels.withColumn("_found", F.lit(True)), keys, "left").withColumn("status", F.when(F.col("_found"), "ok").otherwise("label_missing")).drop("_found")


def grid_lookups(value: Column, grid: list[float]) -> dict[str, Column]:
    """nearest (the lower one at ties), next (at or above) and previous (below) point of a grid, null where there is none."""
    points = F.array(*(F.lit(float(x)) for x in grid))
    near = F.array_min(F.transform(points, lambda s: F.struct(F.abs(s - value).alias("d"), s.alias("s"))))["s"]
    return {"nearest": near, "next": F.array_min(F.filter(points, lambda s: s >= value)), "previous": F.array_max(F.filter(points, lambda s: s < value))}


def nearest_event(events: DataFrame, unit: str, ident: str, time: str, primary: Column, other: Column) -> DataFrame:
    """ident, gap of every primary event to the nearest other event of its unit, null where there is none: one sorted pass, no pairs."""
    w = Window.partitionBy(unit).orderBy(time, ident)
    at = F.when(other, F.col(time))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return events.where(primary | other).withColumn("gap", F.least(F.col(time) - before, after - F.col(time))).where(primary).select(ident, "gap")


def manifest(screened: DataFrame, without: DataFrame, *subsets: DataFrame) -> DataFrame:
    """Units screened and in none of ``without``, that one of the subsets chooses."""
    return screened.subtract(without).intersect(reduce(DataFrame.union, subsets).distinct())


def gap_table(crossings: DataFrame, keys: list[str], commit: str, read: str, least: int) -> DataFrame:
    """keys, s_commit, s_read, gap, where both have at least ``least`` units that cross."""
    got = crossings.groupBy(*keys).agg(F.avg(commit).alias("s_commit"), F.avg(read).alias("s_read"), F.count(commit).alias("_c"), F.count(read).alias("_r"))
    return got.where((F.col("_c") >= least) & (F.col("_r") >= least)).select(*keys, "s_commit", "s_read", (F.col("s_read") - F.col("s_commit")).alias("gap"))


def diagnostics(crossings: DataFrame, baselines: DataFrame, curves: DataFrame, commit: str) -> DataFrame:
    """Per axis: grid points, units, how they commit, and whether these counts add up."""
    st = crossings.join(baselines, ["unit", "axis"]).withColumn("_s", status(F.col("a_ind"), F.col(commit)))
    names = ("determined", "crossing", "censored")
    got = st.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("_s") == k).alias(k) for k in names))
    grid = curves.groupBy("axis").agg(F.count_distinct("s").alias("grid"))
    return got.join(grid, "axis", "full_outer").withColumn("consistent", reduce(Column.__add__, (F.col(k) for k in names)) == F.col("n"))
