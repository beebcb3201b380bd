"""Measures of curves, labels, marks and swapped conditions, each from columns that the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .agreement import marginals
from .ordering import quantiles
from .resampling import mean, replicate_sums, windows

FALL_MOST = 0.02  # fixed value: a mean step may fall by this much


def share(flag: Column) -> Column:
    """The share of rows where ``flag`` holds; unknown rows don't count."""
    return F.avg(flag.cast("int"))


def shares(curves: DataFrame, keys: list[str], embedding: bool = False) -> DataFrame:
    """keys, conditioning, seed, trajectory, residual, end_gain of curves (keys, s, a_fork, a_ind): where the agreement at the
    end comes from. The end's gain is over the baseline, or over the first point for embeddings; undefined where that is 1."""
    e = curves.groupBy(*keys).agg(F.max("a_ind").alias("_i"), F.min_by("a_fork", "s").alias("_a"), F.max_by("a_fork", "s").alias("_z"))
    i, a, z = F.col("_i"), F.col("_a"), F.col("_z")
    base = a if embedding else i
    parts = {"conditioning": i, "seed": a - i, "trajectory": z - a, "residual": 1 - z}
    return e.select(*keys, *(exprs.clip01(x).alias(n) for n, x in parts.items()), F.when(1 - base > 1e-9, exprs.gain(z, base)).alias("end_gain"))


def top_class(df: DataFrame, keys: list[str], vector: str, group: Column, excluded: list, margin: float, name: Column) -> DataFrame:
    """keys, label, margin, entropy of a probability vector: the best group's ``name``, or abstain where the next other group
    is nearer than ``margin``. ``group`` is an expression over ``pos``, the place in the vector; excluded groups are masked out."""
    p = df.select(*keys, F.posexplode(vector).alias("pos", "p")).withColumn("_g", group).where(~F.col("_g").isin(excluded))
    per = p.groupBy(*keys, "_g").agg(F.max("p").alias("p"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p"))).alias("h"))
    best = per.groupBy(*keys).agg(F.max(F.struct("p", "_g")).alias("_t"), F.sort_array(F.collect_list("p"), asc=False).alias("_p"), F.sum("h").alias("entropy"))
    gap = F.col("_t.p") - F.coalesce(F.get("_p", F.lit(1)), F.lit(0.0))
    return best.withColumn("_g", F.col("_t._g")).select(*keys, F.when(gap < margin, "abstain").otherwise(name).alias("label"), gap.alias("margin"), "entropy")


def pooled(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, v: means and then maxima of the vectors' components, as one vector of length 1. Components add up before the shuffle."""
    each = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"), F.max("_x").alias("_t"))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_t"))).alias("_p"))
    both = rows.select(*keys, F.concat(F.transform("_p", lambda r: r["_m"]), F.transform("_p", lambda r: r["_t"])).alias("_v"))
    norm = F.sqrt(exprs.dot(F.col("_v"), F.col("_v")))
    return both.withColumn("_n", norm).select(*keys, F.transform("_v", lambda x: x / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("v"))


def commit_read_cell(commit: Column, read: Column, theta_commit: float, theta_read: float) -> Column:
    """R1 read before it commits, R2 committed but unread, early_action both, uncommitted neither."""
    return F.when(commit < theta_commit, F.when(read >= theta_read, "R1").otherwise("uncommitted")).when(read < theta_read, "R2").otherwise("early_action")


def interval_agreement(rows: DataFrame, item: str, rater: str, start: str, end: str) -> DataFrame:
    """pairs, mean and median IoU, overlap and mean errors over all rater pairs of an item (few raters an item)."""
    x = rows.select(item, F.col(rater).alias("_r"), F.col(start).alias("a0"), F.col(end).alias("a1"))
    p = x.join(x.toDF(item, "_q", "b0", "b1"), item).where("_r < _q")
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    each = p.select(
        exprs.interval_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("iou"), (F.least("a1", "b1") > F.greatest("a0", "b0")).cast("int").alias("overlap"),
        gap("a0", "b0").alias("start"), gap("a1", "b1").alias("end"), F.abs((F.col("a0") + F.col("a1") - F.col("b0") - F.col("b1")) / 2).alias("middle"))
    means = each.agg(F.count(F.lit(1)).alias("pairs"), F.avg("iou").alias("mean_iou"), F.avg("overlap").alias("overlap"), *(F.avg(c).alias(f"{c}_error") for c in ("start", "end", "middle")))
    return means.join(quantiles(each, [], "iou", {"median_iou": 0.5}).select("median_iou"), how="left")


def diversity(df: DataFrame, keys: list[str], unit: str = "unit", label: str = "label", abstain: str = "abstain") -> DataFrame:
    """Distinct labels of a unit with and without abstentions: means, least and most over units, and the abstain rate."""
    per = df.groupBy(*keys, unit, label).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys, unit).agg(
        F.count(label).alias("_k"), F.count(F.when(F.col(label) != abstain, 1)).alias("_s"), (F.sum(F.when(F.col(label) == abstain, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_r"))
    return per.groupBy(*keys).agg(F.avg("_k").alias("mean_all"), F.avg("_s").alias("mean_confident"), F.min("_s").alias("least"), F.max("_s").alias("most"), F.avg("_r").alias("abstain_rate"))


def gain_surface(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Means of a_fork, a_ind and gain per cell, over units."""
    return curves.groupBy(*keys).agg(F.avg("a_fork").alias("a_fork"), F.avg("a_ind").alias("a_ind"), F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("n"))


def mark_errors(rows: DataFrame, keys: list[str], error: str, adopt_at: float = 0.35, least_bin: float = 0.5) -> DataFrame:
    """coverage, mae, median_abs, rmse, std, bias of paired marks (null: unmarked), whether to adopt them, and the bin they allow."""
    e, a = F.col(error), F.abs(error)
    means = rows.groupBy(*keys).agg((F.count(error) / F.count(F.lit(1))).alias("coverage"), F.avg(a).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(error).alias("std"), F.avg(error).alias("bias"))
    medians = quantiles(rows.withColumn("_a", a), keys, "_a", {"median_abs": 0.5}).drop("n")
    both = means.join(medians, keys, "left") if keys else means.join(medians, how="left")
    return both.withColumns({"adopt": F.col("median_abs") <= adopt_at, "bin": F.greatest(F.lit(least_bin), 2 * F.col("std"))})


def anchor_coverage(rows: DataFrame, unit: str, source: str, uncertainty: str) -> DataFrame:
    """Per source: units, events, units with one and with more events, mean and largest uncertainty."""
    per = rows.groupBy(unit, source).agg(F.count(F.lit(1)).alias("_n"), F.avg(uncertainty).alias("_m"), F.max(uncertainty).alias("_t"))
    return per.groupBy(source).agg(
        F.count(F.lit(1)).alias("units"), F.sum("_n").alias("events"), F.count_if(F.col("_n") == 1).alias("single"), F.count_if(F.col("_n") > 1).alias("multi"), F.avg("_m").alias("mean_uncertainty"), F.max("_t").alias("max_uncertainty"))


def headroom(baselines: DataFrame, keys: list[str], above: float = 0.9) -> DataFrame:
    """pinned, open, unscorable units and the mean agreement per key."""
    a = F.col("a_ind")
    return baselines.groupBy(*keys).agg(F.count_if(a > above).alias("pinned"), F.count_if(a <= above).alias("open"), F.count_if(a.isNull()).alias("unscorable"), F.avg("a_ind").alias("mean"))


def reliability_gate(scores: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Add ``reliable`` and ``reason``: the scores that lie below their limit or are undefined."""
    failed = F.concat_ws("; ", *(F.when(F.coalesce(F.col(k) < x, F.lit(True)), k) for k, x in limits.items()))
    return scores.withColumn("reason", failed).withColumn("reliable", F.col("reason") == "")


def matches(swapped: Column, anchor: Column) -> Column:
    return swapped == anchor


def vector_matches(swapped: Column, anchor: Column, other: Column, floor: float) -> Column:
    """Nearer to ``anchor`` than to ``other``, and near enough."""
    own = exprs.cosine(swapped, anchor)
    return (own >= floor) & (own > exprs.cosine(swapped, other))


def follow_rates(rows: DataFrame, keys: list[str], follows: Column, retains: Column) -> DataFrame:
    """Shares of swapped values that follow the donor, keep the source, or do neither; both may hold."""
    return rows.groupBy(*keys).agg(share(follows).alias("follow_rate"), share(retains).alias("retention_rate"), share(~follows & ~retains).alias("neither_rate"), F.count(F.lit(1)).alias("n"))


def corrected_rates(rows: DataFrame, keys: list[str], swapped: str = "swapped", donor: str = "donor", source: str = "source") -> DataFrame:
    """Strict rates (follows but doesn't keep, and the reverse), the same where donor and source differ, collisions, and the
    rate that no effect would give, the sum of squared label shares."""
    f, r, differ = F.col(swapped) == F.col(donor), F.col(swapped) == F.col(source), F.col(source) != F.col(donor)
    strict, kept = f & ~r, r & ~f
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~differ).alias("collisions"), share(strict).alias("strict_follow"), share(kept).alias("strict_retain"),
        F.avg(F.when(differ, f.cast("int"))).alias("follow_where_differ"), F.avg(F.when(differ, r.cast("int"))).alias("retain_where_differ"))
    return got.join(marginals(rows, keys, swapped).select(*keys, (1 / F.col("k_eff")).alias("floor")), keys)


def completion(rows: DataFrame, keys: list[str], done: Column, **verdicts: Column) -> DataFrame:
    """total, completed, coverage, and how often each of ``verdicts`` holds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), share(done).alias("coverage"), *(F.count_if(v).alias(n) for n, v in verdicts.items()))


def trend(points: DataFrame, keys: list[str], x: str, y: str, eps: float = 1e-6) -> DataFrame:
    """Least-squares slope, last minus first, and whether that rises."""
    delta = F.max_by(y, x) - F.min_by(y, x)
    return points.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), delta.alias("delta"), (delta > eps).alias("increasing"))


def status_merge(rows: DataFrame, keys: list[str], token: str, good: str = "OK", none: str = "MISSING") -> DataFrame:
    """keys, status: any other token wins (the least by text), else ``good`` if there is one, else ``none``."""
    t = F.col(token)
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(t != good, t)), F.max(F.when(t == good, F.lit(good))), F.lit(none)).alias("status"))


def taxonomy(curves: DataFrame, keys: list[str], unit: str = "unit", theta: float = 0.7, pinned: float = 0.9, seed: float = 0.3, early: float = 0.4, late: float = 0.7) -> DataFrame:
    """Units that are pinned, seeded, early, mid, late and never commit; the first two overlap the others."""
    c = curves.groupBy(*keys, unit).agg(F.max("a_ind").alias("_i"), F.min(F.when(F.col("gain") >= theta, F.col("s"))).alias("_t"), (F.min_by("a_fork", "s") - F.max("a_ind")).alias("_s"))
    t = F.col("_t")
    cases = {"pinned": F.col("_i") >= pinned, "seed": F.col("_s") >= seed, "early": t <= early, "mid": (t > early) & (t < late), "late": t >= late, "never": t.isNull()}
    return c.groupBy(*keys).agg(*(F.count_if(v).alias(n) for n, v in cases.items()))


def accept_accuracy(rows: DataFrame, accept: DataFrame, category: str, label: str, least: float, abstain: str = "abstain") -> DataFrame:
    """Per category how often the label is among those that ``accept`` (category, label) lists for it: with abstentions as
    misses and without, their rate, and whether the first reaches ``least``."""
    listed = accept.select(F.col(category).alias("_c"), F.col(label).alias("_l")).distinct().withColumn("_ok", F.lit(True))
    both = rows.join(listed, (F.col(category) == F.col("_c")) & (F.col(label) == F.col("_l")), "left")
    ok, sure = F.coalesce("_ok", F.lit(False)).cast("int"), F.col(label) != abstain
    return both.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("accuracy"), F.avg(F.when(sure, ok)).alias("confident_accuracy"), share(~sure).alias("abstain_rate"), (F.avg(ok) >= least).alias("passed"))


def endpoint_controls(curves: DataFrame, keys: list[str], value: str, low: float, high: float, most_at_low: float, least_at_high: float) -> DataFrame:
    """keys, low, high, sane: a mean curve near two points; no verdict where either is undefined."""
    mean_ = curves.groupBy(*keys, "s").agg(F.avg(value).alias("_g"))
    at = lambda x: F.min_by("_g", F.abs(F.col("s") - x))
    return mean_.groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"), ((at(low) <= most_at_low) & (at(high) >= least_at_high)).alias("sane"))


def monotonicity(curves: DataFrame, keys: list[str], value: str, unit: str = "unit", n_boot: int = 1000, seed: str = "monotone") -> DataFrame:
    """keys, s, mean_step, ci_low, ci_high, n, violation: the mean step to each point, units resampled; a violation where
    even the interval's upper end falls by more than FALL_MOST."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys, unit).orderBy("s"))
    steps = curves.withColumn("_d", step).where("_d is not null")
    got = windows(replicate_sums(steps, [*keys, "s"], [unit], ["_d"], n_boot, seed), [*keys, "s"], mean("_d"), n=F.col("n__d").cast("long"))
    return got.select(*keys, "s", F.col("point").alias("mean_step"), "ci_low", "ci_high", "n", (F.col("ci_high") < -FALL_MOST).alias("violation"))


def best_per_step(scores: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """The row of the highest score per key, ties by name."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), name))
    return scores.withColumn("_r", first).where("_r = 1").drop("_r")


def smallest_setting(settings: DataFrame, setting: str, **least: float) -> DataFrame:
    """The smallest setting whose columns all reach their least value, and OK or NONE."""
    ok = F.lit(True)
    for name, x in least.items():
        ok = ok & (F.col(name) >= x)
    return settings.agg(F.min(F.when(ok, F.col(setting))).alias(setting), F.when(F.count_if(ok) == 0, "NONE").otherwise("OK").alias("token"))
