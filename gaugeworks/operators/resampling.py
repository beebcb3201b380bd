"""Resampling of units in one pass: every task adds up its rows' share of all replicates at once.

Replicate b counts a unit w times, w a Poisson(1) draw that a hash of (seed, unit, b) decides, so any engine and any
task finds the same number, with no ranks and no table of draws. A task multiplies the weights of its rows with their
values; what is shuffled is replicates x keys numbers a task. The sample itself comes along as replicate -1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import interpolated_crossings

SAMPLE = -1
DRAWS = 16  # 16-bit numbers in a SHA-256
#: A 16-bit number of at least CUTS[i] draws more than i.
CUTS = [round(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(i + 1))) for i in range(8)]
_WEIGHT = np.searchsorted(CUTS, np.arange(65536), side="right").astype("u1")
_ROWS, _KEYS = 1024, 512  # rows multiplied at a time; keys held before their sums are passed on


def weights(units: list[str], seed: str, n_boot: int) -> np.ndarray:
    """Weights (unit, replicate) of Poisson(1) draws."""
    runs = range(-(-n_boot // DRAWS))
    raw = b"".join(hashlib.sha256(f"{seed}:{u}:{k}".encode()).digest() for u in units for k in runs)
    return _WEIGHT[np.frombuffer(raw, ">u2").reshape(len(units), -1)[:, :n_boot]]


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def replicate_sums(df: DataFrame, keys: list[str], units: list[str], values: list[str], n_boot: int = 1000, seed: str = "boot") -> DataFrame:
    """Per key and replicate b: ``n`` (weight of all rows), and for each value ``sum_<value>`` and ``n_<value>`` over rows
    where it is defined. Rows b = -1 hold the sample itself.

    A row weighs the product of its units' weights (one unit column, or two for rows about pairs). Keys may be many:
    sums are passed on before they fill a task.
    """
    m = len(values)
    names = [*keys, "b", "n", *(f"{p}_{v}" for v in values for p in ("sum", "n"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            sums = np.concatenate(list(held.values()))
            made = pd.DataFrame({"b": np.tile(np.arange(SAMPLE, n_boot), len(held)), "n": sums[:, 0]})
            for i, v in enumerate(values):
                made[f"sum_{v}"], made[f"n_{v}"] = sums[:, 1 + i], sums[:, 1 + m + i]
            for i, k in enumerate(keys):
                made[k] = pd.Series([key[i] for key in held], dtype=object).repeat(n_boot + 1).to_numpy()
            held.clear()
            return made[names]

        for whole in batches:
            for first in range(0, len(whole), _ROWS):
                pdf = whole.iloc[first : first + _ROWS].reset_index(drop=True)
                w = np.ones((len(pdf), n_boot + 1))
                for u in units:
                    codes, distinct = pd.factorize(pdf[f"_unit_{u}"])
                    w[:, 1:] *= weights(list(distinct), seed, n_boot)[codes]
                x = pdf[values].to_numpy("f8", na_value=np.nan) if values else np.empty((len(pdf), 0))
                defined = ~np.isnan(x)
                right = np.concatenate([np.ones((len(pdf), 1)), np.where(defined, x, 0.0), defined], axis=1)
                groups = pdf.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(pdf))}
                for key, at in groups.items():
                    key = key if isinstance(key, tuple) else (key,)
                    key = tuple(None if pd.isna(k) else k for k in key)
                    add = w[at].T @ right[at]
                    held[key] = held[key] + add if key in held else add
                if len(held) > _KEYS:
                    yield out()
        if held:
            yield out()

    unit_text = [F.coalesce(F.col(u).cast("string"), F.lit("null")).alias(f"_unit_{u}") for u in units]
    numbers = [F.col(v).cast("double").alias(v) for v in values]
    schema = f"{_key_schema(df, keys)}b int, {', '.join(f'{c} double' for c in names[len(keys) + 1:])}"
    parts = df.select(*keys, *unit_text, *numbers).mapInPandas(run, schema)
    return parts.groupBy(*keys, "b").agg(*(F.sum(c).alias(c) for c in names[len(keys) + 1 :]))


def mean(value: str) -> Column:
    """The mean of a value in every replicate of ``replicate_sums``; null where none is drawn."""
    return F.when(F.col(f"n_{value}") > 0, F.col(f"sum_{value}") / F.col(f"n_{value}"))


def windows(replicates: DataFrame, keys: list[str], statistic: Column, ci: float = 0.95, **sample: Column) -> DataFrame:
    """point, ci_low, ci_high and replicates (defined ones) of a statistic per key, and ``sample`` columns read off the sample."""
    tail = (1 - ci) / 2
    stated = replicates.withColumn("_x", statistic)
    own = lambda c: F.max(F.when(F.col("b") == SAMPLE, c))
    drawn = F.when(F.col("b") != SAMPLE, F.col("_x"))
    return stated.groupBy(*keys).agg(
        own(F.col("_x")).alias("point"), F.percentile(drawn, F.lit(tail)).alias("ci_low"), F.percentile(drawn, F.lit(1 - tail)).alias("ci_high"),
        F.count(drawn).alias("replicates"), *(own(c).alias(name) for name, c in sample.items()),
    )


def bootstrap_mean(df: DataFrame, keys: list[str], unit: str, value: str, n_boot: int = 1000, seed: str = "boot", ci: float = 0.95) -> DataFrame:
    """keys, mean, ci_low, ci_high, n (units with a defined value), units: the mean of unit means, units resampled.

    Rows of a unit are averaged first; undefined values are dropped, so are replicates that draw none. One unit gives
    its own value on both sides.
    """
    rows = df.groupBy(*keys, unit).agg(F.avg(value).alias("_v"))
    got = windows(replicate_sums(rows, keys, [unit], ["_v"], n_boot, seed), keys, mean("_v"), ci, n=F.col("n__v").cast("long"), units=F.col("n").cast("long"))
    return got.select(*keys, F.col("point").alias("mean"), "ci_low", "ci_high", "n", "units")


def crossing_windows(crossings: DataFrame, keys: list[str], unit: str = "unit", value: str = "crossing", n_boot: int = 1000, seed: str = "win", min_n: int = 1) -> DataFrame:
    """keys, s_hat, ci_low, ci_high, n, crossed, underpowered: the mean crossing of the units that cross, units resampled.

    ``n`` counts all units; fewer than ``min_n`` make a window underpowered, so that it is shown but is no result.
    """
    got = bootstrap_mean(crossings, keys, unit, value, n_boot, seed)
    return got.select(*keys, F.col("mean").alias("s_hat"), "ci_low", "ci_high", F.col("units").alias("n"), F.col("n").alias("crossed"), (F.col("units") < min_n).alias("underpowered"))


def replicate_rows(df: DataFrame, keys: list[str], unit: str, value: str, n_boot: int, seed: str) -> DataFrame:
    """keys, b, value, w for every drawn unit: for statistics that no sums can give. It makes 0.63 x n_boot rows a unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for first in range(0, len(whole), _ROWS):
                pdf = whole.iloc[first : first + _ROWS].reset_index(drop=True)
                w = weights(pdf["_unit"].tolist(), seed, n_boot)
                row, b = np.nonzero(w)
                made = pdf[[*keys, value]].iloc[row].reset_index(drop=True)
                made["b"], made["w"] = b, w[row, b].astype("i4")
                yield made[[*keys, "b", value, "w"]]

    source = df.select(*keys, F.coalesce(F.col(unit).cast("string"), F.lit("null")).alias("_unit"), F.col(value).cast("double").alias(value))
    return source.mapInPandas(run, f"{_key_schema(df, keys)}b int, `{value}` double, w int")


def bootstrap_statistic(df: DataFrame, keys: list[str], unit: str, value: str, statistic, n_boot: int = 50, seed: str = "stat", ci: float = 0.95) -> DataFrame:
    """Interval of any Python function of the resampled unit values (an array, repeats included).

    A replicate's values meet in one task, as the function wants them together: a key may have as many units as a task
    can hold doubles. Statistics that are functions of sums go through ``replicate_sums`` at any size.
    """
    drawn = replicate_rows(df, keys, unit, value, n_boot, seed)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*keys, "b"]].head(1).copy()
        pdf = pdf.sort_values(value)
        out["stat"] = float(statistic(pdf[value].repeat(pdf["w"]).to_numpy()))
        return out

    reps = drawn.groupBy(*keys, "b").applyInPandas(one, f"{_key_schema(df, keys)}b int, stat double")
    return windows(reps, keys, F.col("stat"), ci).drop("point")


def determination_budget(curves: DataFrame, keys: list[str], theta: float, n_boot: int = 1000, seed: str = "det", unit: str = "unit") -> DataFrame:
    """Where a unit's agreement comes from, per key, with intervals over units: conditioning (its baseline), seed (first fork
    agreement over it), trajectory (last over first), residual, and the mean grid point at which its gain reaches theta.

    One pass gives the sums of all five shares in all replicates.
    """
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    ends = curves.groupBy(*keys, unit).agg(F.max("a_ind").alias("i"), F.min_by("a_fork", "s").alias("f0"), F.max_by("a_fork", "s").alias("f1"), F.min(F.when(F.col("gain") >= theta, F.col("s"))).alias("c"))
    parts = ends.withColumns({"seed": share(F.col("f0") - F.col("i")), "traj": share(F.col("f1") - F.col("f0")), "res": share(1 - F.col("f1"))})
    sums = replicate_sums(parts, keys, [unit], ["i", "seed", "traj", "res", "c"], n_boot, seed)
    tail = 0.025
    own, drawn = (lambda v: F.max(F.when(F.col("b") == SAMPLE, mean(v)))), (lambda v: F.when(F.col("b") != SAMPLE, mean(v)))
    stated = []
    for value, name, short in (("i", "conditioning", "cond"), ("seed", "seed", "seed"), ("traj", "trajectory", "traj"), ("c", "s_commit", "scommit")):
        stated += [own(value).alias(name), F.percentile(drawn(value), F.lit(tail)).alias(f"{short}_lo"), F.percentile(drawn(value), F.lit(1 - tail)).alias(f"{short}_hi")]
    return sums.groupBy(*keys).agg(F.max(F.when(F.col("b") == SAMPLE, F.col("n"))).cast("long").alias("n"), own("res").alias("residual"), *stated)


def threshold_sweep(curves: DataFrame, keys: list[str], thetas, value: str = "gain", unit: str = "unit", n_boot: int = 200, seed: str = "sweep", min_n: int = 1) -> DataFrame:
    """``crossing_windows`` of interpolated crossings for every theta: theta, keys, s_hat, ci_low, ci_high, n, crossed, underpowered.

    The curves are read once: a unit's crossings of all thetas come out of one window.
    """
    names = {f"t{i}": theta for i, theta in enumerate(thetas)}
    found = interpolated_crossings(curves, [*keys, unit], {name: (value, theta) for name, theta in names.items()})
    each = found.select(*keys, unit, F.explode(F.array(*(F.struct(F.lit(float(t)).alias("theta"), F.col(n).alias("crossing")) for n, t in names.items()))).alias("_t"))
    return crossing_windows(each.select("_t.theta", *keys, unit, "_t.crossing"), ["theta", *keys], unit, "crossing", n_boot, seed, min_n)
