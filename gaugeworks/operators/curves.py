"""Curves along the progress column: crossings, survival, windows, separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .agreement import pairwise_agreement

EPS = 1e-9


def baseline(df: DataFrame) -> DataFrame:
    """unit, axis, a_ind: agreement of the independents."""
    return pairwise_agreement(df.where("role = 'independent'"), ["unit", "axis"]).select("unit", "axis", F.col("agreement").alias("a_ind"))


def gain_curves(df: DataFrame, on_saturated: str = "zero") -> DataFrame:
    """unit, axis, s, a_fork, a_ind, gain: forks joined with their unit's baseline."""
    forks = pairwise_agreement(df.where("role = 'fork'"), ["unit", "axis", "s"]).select("unit", "axis", "s", F.col("agreement").alias("a_fork"))
    return forks.join(baseline(df), ["unit", "axis"]).withColumn("gain", exprs.gain(F.col("a_fork"), F.col("a_ind"), on_saturated))


def interpolated_crossing(df: DataFrame, keys: list[str], value: str, theta: Column | float, falling: bool = False) -> DataFrame:
    """keys, crossing: first s where the value reaches theta, linear between grid points; null if it never does.

    A first point already across gives its own s. Undefined points are skipped; a crossing right after an
    undefined point is undefined.
    """
    return interpolated_crossings(df, keys, {"crossing": (value, theta)}, falling)


def interpolated_crossings(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, Column | float]], falling: bool = False) -> DataFrame:
    """Several crossings (name: value, theta) of the same curves in one pass, as ``interpolated_crossing``."""
    w = Window.partitionBy(*keys).orderBy("s")
    prev_s = F.lag("s").over(w)
    marked, found = df, []
    for name, (value, theta) in wanted.items():
        v, level = F.col(value), theta if isinstance(theta, Column) else F.lit(theta)
        across = v <= level if falling else v >= level
        prev_v = F.lag(value).over(w)
        at = F.when(prev_s.isNull(), F.col("s")).otherwise(prev_s + (level - prev_v) / F.when(v != prev_v, v - prev_v) * (F.col("s") - prev_s))
        marked = marked.withColumn(f"_hit_{name}", F.when(across, F.struct(F.col("s").alias("s"), at.alias("at"))))
        found.append(F.min(f"_hit_{name}")["at"].alias(name))
    return marked.groupBy(*keys).agg(*found)


def grid_crossing(df: DataFrame, keys: list[str], value: str, theta: Column | float, below: bool = False) -> DataFrame:
    """Smallest grid s with value >= theta (or < theta)."""
    level = theta if isinstance(theta, Column) else F.lit(theta)
    hit = F.col(value) < level if below else F.col(value) >= level
    return df.groupBy(*keys).agg(F.min(F.when(hit, F.col("s"))).alias("crossing"))


def status(a_ind: Column, crossing: Column) -> Column:
    return F.when(a_ind >= 1 - EPS, "determined").when(crossing.isNotNull(), "crossing").otherwise("censored")


def survival(df: DataFrame, keys: list[str], time: str, event: Column, weight: Column | None = None) -> DataFrame:
    """Product-limit curve per key: t, at_risk, events, survival. Rows without an event are censored at their time."""
    w = weight if weight is not None else F.lit(1)
    return survival_of_counts(df.groupBy(*keys, F.col(time).alias("t")).agg(F.sum(F.when(event, w).otherwise(0)).alias("events"), F.sum(w).alias("n")), keys)


def survival_of_counts(per: DataFrame, keys: list[str]) -> DataFrame:
    """The curve from counts (or weights) per time: t, n (rows that end there) and events."""
    later = Window.partitionBy(*keys).orderBy(F.desc("t"))
    risk = per.withColumn("at_risk", F.sum("n").over(later))
    so_far = Window.partitionBy(*keys).orderBy("t")
    return risk.withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(so_far)).select(*keys, "t", "at_risk", "events", "survival")


def survival_median(df: DataFrame, keys: list[str], time: str, event: Column, weight: Column | None = None) -> DataFrame:
    return median_of_curve(survival(df, keys, time, event, weight), keys)


def median_of_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    return curve.groupBy(*keys).agg(F.min(F.when((F.col("survival") <= 0.5 + 1e-12) & (F.col("events") > 0), F.col("t"))).alias("median"))


def ranking(df: DataFrame, keys: list[str], name: str, value: str, places: int = 12) -> DataFrame:
    """Competition ranks, values equal to ``places`` decimals tied, and the order as text: a < b = c."""
    x = F.round(value, places)
    ranked = df.withColumn("_v", x).withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy("_v")))
    ties = ranked.groupBy(*keys, "rank").agg(F.array_join(F.array_sort(F.collect_list(name)), " = ").alias("_t"))
    text = ties.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda r: r["_t"]), " < ").alias("ordering"))
    return ranked.drop("_v").join(text, keys)


def separation(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(max - min of s_hat) / mean width; spread 0: 0; width 0: infinity; fewer than two defined windows: null."""
    spread, width = F.max("s_hat") - F.min("s_hat"), F.avg(F.col("ci_high") - F.col("ci_low"))
    value = F.when(F.count("s_hat") < 2, None).when(spread <= EPS, 0.0).when(width <= EPS, float("inf")).otherwise(spread / width)
    return windows.groupBy(*keys).agg(value.alias("separation"))


def non_overlap(windows: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Whether windows sorted by s_hat don't overlap; touching passes unless ``strict``."""
    nxt = F.lead("ci_low").over(Window.partitionBy(*keys).orderBy("s_hat", "axis"))
    ok = F.col("ci_high") < nxt if strict else F.col("ci_high") <= nxt
    return windows.withColumn("_ok", F.coalesce(ok, F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("ordered"))
