"""Candidate selection replayed on tables: pool rows (unit, cand, ok, score), one chain of windows per policy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import draw
from .resampling import mean, replicate_sums, windows

PLACES = 9  # of cosines, so that ties are ties


def is_first(*then: str, before: list[Column] | None = None) -> Column:
    """Whether a row is its unit's first: rows that hold the conditions ``before`` first, then the highest score, then ``then`` upwards.

    A least value over the unit, so that all choices of a chain share one order of the rows by unit.
    """
    score = F.col("score")
    key = F.struct(*((~F.coalesce(b, F.lit(False))).alias(f"b{i}") for i, b in enumerate(before or [])), score.isNull().alias("n"), (~F.isnan(score.cast("double"))).alias("m"), (-score).alias("s"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(then)))
    return key == F.min(key).over(Window.partitionBy("unit"))


def best(pool: DataFrame, policy: str, seed: str = "tie") -> DataFrame:
    """One winner per unit: highest score, ties by hash."""
    rows = pool.withColumn("_h", draw(seed, "unit", "cand"))
    return rows.withColumn("_p", is_first("_h", "cand")).where("_p").drop("_p", "_h").withColumn("policy", F.lit(policy))


def budgeted(pool: DataFrame, k: int, seed: str) -> DataFrame:
    """k candidates per unit in hashed order."""
    place = F.row_number().over(Window.partitionBy("unit").orderBy(draw(seed, "unit", "cand"), "cand"))
    return pool.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def random_prune(pool: DataFrame, share: float, seed: str) -> DataFrame:
    """Prune round(share * n) per unit, half to even, in hashed order; one stays at least."""
    place = F.row_number().over(Window.partitionBy("unit").orderBy(draw(seed, "unit", "cand"), "cand"))
    size = F.count(F.lit(1)).over(Window.partitionBy("unit"))
    return pool.withColumn("_p", place).withColumn("_n", size).where(F.col("_p") > F.least(F.bround(F.col("_n") * share), F.col("_n") - 1)).drop("_p", "_n")


def keep_or_best(pool: DataFrame, keep: Column, among: Column | None = None) -> Column:
    """Whether a row stays: where ``keep`` holds; in a unit where it holds for none, the one of the highest score (then lowest candidate).

    ``among`` narrows a unit to the rows that are still in.
    """
    inside = among if among is not None else F.lit(True)
    unit = Window.partitionBy("unit")
    any_kept = F.max((inside & keep).cast("int")).over(unit) == 1
    return inside & F.when(any_kept, keep).otherwise(is_first("cand", before=[inside]))


def never_empty(pool: DataFrame, keep: Column) -> DataFrame:
    """Rows where ``keep`` holds; of a unit where it holds for none, the best row."""
    return pool.withColumn("_k", keep).withColumn("_s", keep_or_best(pool, F.col("_k"))).where("_s").drop("_k", "_s")


def softmax_resample(pool: DataFrame, n: int, temperature: float, seed: str) -> DataFrame:
    """n draws with replacement per unit by softmax weight; distinct candidates stay."""
    w = Window.partitionBy("unit")
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    weighed = pool.withColumn("_e", e).withColumn("_t", F.sum("_e").over(w))
    upto = F.sum("_e").over(w.orderBy("cand")) / F.col("_t")
    ranged = weighed.withColumn("_hi", upto).withColumn("_lo", F.coalesce(F.lag("_hi").over(w.orderBy("cand")), F.lit(0.0)))
    draws = pool.select("unit").distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("_u", draw(seed, "unit", "_i") / float(1 << 32))
    hit = draws.join(ranged.select("unit", "cand", "_lo", "_hi"), "unit").where("_u >= _lo AND _u < _hi").select("unit", "cand").distinct()
    return pool.join(hit, ["unit", "cand"], "left_semi")


def charged(s: float, steps: int) -> int:
    """What a candidate costs that is pruned at progress ``s``: round(s * steps), half to even."""
    return round(s * steps)


def gated(pool: DataFrame, gates: list[tuple[float, list[str]]], steps: int) -> DataFrame:
    """Add ``kept`` (survives all gates), ``nfe`` (what the row costs) and ``scored`` (how often it is scored).

    At a gate every survivor is scored and those good on all its axes stay, or else the best survivor. A unit of one
    survivor passes the other gates unscored. Survivors are completed and scored once more. All gates are windows over
    the unit: one shuffle, whatever their number.
    """
    out = pool.withColumns({"kept": F.lit(True), "nfe": F.lit(0), "scored": F.lit(0)})
    for s, axes in gates:
        keep = F.lit(True)
        for a in axes:
            keep = keep & F.coalesce(F.col(a), F.lit(False))
        alive = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("unit"))
        out = out.withColumn("_n", alive).withColumn("_in", F.col("kept") & (F.col("_n") > 1)).withColumn("_keep", keep)
        out = out.withColumn("_stay", keep_or_best(out, F.col("_keep"), F.col("_in")))
        out = out.withColumns({
            "scored": F.col("scored") + F.col("_in").cast("int"),
            "nfe": F.col("nfe") + F.when(F.col("_in") & ~F.col("_stay"), charged(s, steps)).otherwise(0),
            "kept": F.when(F.col("_in"), F.col("_stay")).otherwise(F.col("kept")),
        }).drop("_n", "_in", "_keep", "_stay")
    done = F.col("kept").cast("int")
    return out.withColumns({"nfe": F.col("nfe") + done * steps, "scored": F.col("scored") + done})


def funnel(pool: DataFrame, gates: list[tuple[float, list[str]]], steps: int) -> tuple[DataFrame, DataFrame]:
    """Survivors of the gates in turn, and the cost per unit."""
    out = gated(pool, gates, steps)
    return out.where("kept").drop("kept", "nfe", "scored"), out.groupBy("unit").agg(F.sum("nfe").alias("cost"))


def _to_mean(units: pa.Array) -> pa.Array:
    """Per unit the cosine of each of its vectors to their sum, to PLACES; undefined for all where one is, 0 for a vector shorter than the sum.

    Rounded here, a batch at once: Spark's round makes a decimal of every double, which cost more than the cosines.
    """
    counts = units.value_lengths().to_numpy()
    each = units.flatten()
    sizes = each.value_lengths()
    flat = each.flatten()
    if len(each) and not each.null_count and not flat.null_count and (d := sizes[0].as_py()) and (sizes.to_numpy() == d).all() and counts.all():
        x = flat.to_numpy().reshape(-1, d)
        total = np.repeat(np.add.reduceat(x, np.cumsum(counts) - counts, axis=0), counts, axis=0)
        norms = np.sqrt((x * x).sum(1)) * np.sqrt((total * total).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(norms == 0, 0.0, np.clip((x * total).sum(1) / norms, -1.0, 1.0)).round(PLACES) + 0.0  # no negative zero
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found))
    return pa.array([_odd_cosines(v) for v in units.to_pylist()], pa.list_(pa.float64()))


def _odd_cosines(vectors: list) -> list:
    if any(v is None for v in vectors):
        return [None] * len(vectors)
    most = max(len(v) for v in vectors)
    if any(len(v) < most for v in vectors) or any(z is None for v in vectors for z in v):
        return [0.0 if len(v) < most else None for v in vectors]
    x = np.array(vectors, "f8").reshape(len(vectors), most)
    total = x.sum(0)
    norms = np.sqrt((x * x).sum(1)) * np.sqrt((total * total).sum())
    return [0.0 if n == 0 else float(np.clip(d / n, -1.0, 1.0).round(PLACES)) + 0.0 for d, n in zip((x * total).sum(1), norms, strict=True)]


def build_pool(rows: DataFrame, labels: list[str], vectors: list[str], reward: str, unit: str = "unit", cand: str = "cand") -> DataFrame:
    """unit, cand, for each axis whether the candidate is right (boolean) and ``<axis>_score``, ok (right on all) and score.

    A label axis is right where it equals the unit's majority label, ties by text. A vector axis is right where its cosine
    to the unit's mean vector is at least the median cosine; its score is the cosine scaled to [0, 1]. The score is the
    cosine of ``reward`` to the unit's mean. Cosines are rounded to nine places, so that ties are ties. Units of one
    candidate are left out; a unit's candidates, few by design, are held as one array.
    """
    c = F.col("_c")
    whole = rows.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct(cand, *labels, *vectors, *([reward] if reward not in vectors else [])))).alias("_c")).where(F.size("_c") > 1)

    def majority(axis: str) -> Column:
        n = lambda x: F.size(F.filter(c, lambda y: y[axis].eqNullSafe(x[axis])))
        return F.array_min(F.transform(c, lambda x: F.struct((-n(x)).alias("n"), x[axis].cast("string").alias("l"))))["l"]

    def cosines(axis: str) -> Column:
        return F.arrow_udf(_to_mean, "array<double>")(F.transform(c, lambda x: x[axis].cast("array<double>")))

    whole = whole.withColumns({f"_m_{a}": majority(a) for a in labels} | {f"_s_{v}": cosines(v) for v in dict.fromkeys([*vectors, reward])})
    for v in vectors:
        s, n = F.array_sort(f"_s_{v}"), F.size("_c")
        whole = whole.withColumn(f"_t_{v}", F.round((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2, PLACES))
    each = whole.select("*", F.posexplode("_c").alias("_i", "_x"))
    out = {}
    for a in labels:
        out[a] = F.col(f"_x.{a}").cast("string").eqNullSafe(F.col(f"_m_{a}"))
        out[f"{a}_score"] = out[a].cast("double")
    for v in vectors:
        mine, all_ = F.get(f"_s_{v}", F.col("_i")), F.col(f"_s_{v}")
        out[v] = mine >= F.col(f"_t_{v}")
        out[f"{v}_score"] = (mine - F.array_min(all_)) / (F.array_max(all_) - F.array_min(all_) + 1e-12)
    ok = F.lit(True)
    for a in [*labels, *vectors]:
        ok = ok & out[a]
    return each.select(unit, F.col(f"_x.{cand}").alias(cand), *(x.alias(n) for n, x in out.items()), ok.alias("ok"), F.get(f"_s_{reward}", F.col("_i")).alias("score"))


def gates_from_commit(commit: DataFrame, grid) -> DataFrame:
    """gate, axes: axes grouped by the first grid point at or after their ``s_commit``; axes that never commit, or only past the grid, have no gate."""
    points = F.array(*(F.lit(float(s)) for s in sorted(grid)))
    placed = commit.withColumn("gate", F.array_min(F.filter(points, lambda s: s >= F.col("s_commit"))))
    return placed.where("gate is not null").groupBy("gate").agg(F.array_sort(F.collect_list("axis")).alias("axes"))


SCALAR = ("full_bon", "same_compute_bon", "diffrs_scalar", "smc_scalar")
POLICIES = ("full_bon", "final_rerank", "same_compute_bon", "random_prune", "diffrs_scalar", "smc_scalar", "oracle_axis_gated")


def replay(pool: DataFrame, gates: list[tuple[float, list[str]]], axes: list[str], steps: int = 25, tau: float = 0.0, temperature: float = 1.0, prune: float = 0.5, noise: float | None = None) -> DataFrame:
    """Every policy on every unit in one pass: unit, policy, winner, correct, correct_<axis>, completed, nfe, scoring_calls,
    retained, false_pruned, regret.

    full_bon and final_rerank complete all; same_compute_bon as many as the gated policy's cost pays for, rounded up;
    random_prune, diffrs_scalar (score at least ``tau``) and smc_scalar (n softmax draws) prune once at the first gate;
    oracle_axis_gated at every gate. With ``noise``, non_oracle_axis_gated reads axes that are wrong with that probability.
    retained: the highest score is completed; false_pruned: the best correct candidate is not; regret: whether one is
    correct minus whether the winner is. Windows share the unit's partitioning; ties of a winner go by hash.
    """
    unit = Window.partitionBy("unit")
    n = F.count(F.lit(1)).over(unit)
    place = lambda seed: F.row_number().over(unit.orderBy(draw(seed, "unit", "cand"), "cand"))
    x = pool.withColumn("_bok", place("bok")).withColumn("_half", place("half"))  # rows are sorted while they are narrow, by candidate last
    weight = F.exp((F.col("score") - F.max("score").over(unit)) / max(temperature, 1e-6))
    x = x.withColumn("_e", weight).withColumn("_hi", F.sum("_e").over(unit.orderBy("cand")) / F.sum("_e").over(unit)).withColumn("_lo", F.coalesce(F.lag("_hi").over(unit.orderBy("cand")), F.lit(0.0)))
    x = gated(x.withColumn("_ok", F.coalesce("ok", F.lit(False))), gates, steps).withColumnsRenamed({"kept": "k_oracle_axis_gated", "nfe": "n_oracle_axis_gated", "scored": "s_oracle_axis_gated"})
    x = x.withColumns({"_n": n, "_paid": F.sum("n_oracle_axis_gated").over(unit)})
    drawn = F.exists(F.sequence(F.lit(1), F.col("_n")), lambda i: _between(draw("smc", F.col("unit"), i) / float(1 << 32), F.col("_lo"), F.col("_hi")))
    first = charged(gates[0][0] if gates else 0.5, steps)
    affordable = F.greatest(F.lit(1), F.least(F.col("_n"), F.ceil(F.col("_paid") / steps)))
    kept = {
        "full_bon": F.lit(True), "final_rerank": F.lit(True), "same_compute_bon": F.col("_bok") <= affordable,
        "random_prune": F.col("_half") > F.least(F.bround(F.col("_n") * prune), F.col("_n") - 1),
        "diffrs_scalar": keep_or_best(x, F.col("score") >= tau), "smc_scalar": drawn,
    }
    names = list(POLICIES)
    x = x.withColumns({f"k_{p}": k for p, k in kept.items()})
    for p in kept:
        done = F.col(f"k_{p}").cast("int")
        once = p in ("random_prune", "diffrs_scalar", "smc_scalar")
        x = x.withColumns({f"n_{p}": done * steps + ((1 - done) * first if once else 0), f"s_{p}": done + (1 if once else 0)})
    if noise is not None:
        names.append("non_oracle_axis_gated")
        read = x
        for a in axes:
            read = read.withColumn(f"_r_{a}", F.col(a) != (draw("noise", F.lit(a), "unit", "cand") / float(1 << 32) < noise))
        x = gated(read, [(s, [f"_r_{a}" for a in ax]) for s, ax in gates], steps).withColumnsRenamed({"kept": "k_non_oracle_axis_gated", "nfe": "n_non_oracle_axis_gated", "scored": "s_non_oracle_axis_gated"})
    x = x.withColumns({"_top": is_first("cand"), "_right": F.col("_ok") & is_first("cand", before=[F.col("_ok")]), "_tie": draw("tie", "unit", "cand")})
    order = F.struct("score", -F.col("_tie"), -F.col("cand"))
    row = F.struct("cand", F.col("_ok").alias("ok"), *axes)
    result = [F.struct(
        F.lit(p).alias("policy"), F.max_by(row, F.when(F.col(f"k_{p}"), order)).alias("w"), F.sum(F.col(f"k_{p}").cast("int")).alias("completed"), F.sum(f"n_{p}").alias("nfe"), F.sum(f"s_{p}").alias("scoring_calls"),
        F.bool_or(F.col(f"k_{p}") & F.col("_top")).alias("retained"), F.bool_or(~F.col(f"k_{p}") & F.col("_right")).alias("false_pruned"), F.bool_or("_ok").alias("possible"),
    ) for p in names]
    each = x.groupBy("unit").agg(F.array(*result).alias("_r")).select("unit", F.explode("_r").alias("r")).select("unit", "r.*")
    return each.select(
        "unit", "policy", F.col("w.cand").alias("winner"), F.col("w.ok").alias("correct"), *(F.col(f"w.{a}").alias(f"correct_{a}") for a in axes), "completed", "nfe", "scoring_calls", "retained",
        "false_pruned", (F.col("possible").cast("int") - F.col("w.ok").cast("int")).alias("regret"),
    )


def _between(u: Column, low: Column, high: Column) -> Column:
    return (u >= low) & (u < high)


def policy_metrics(outcomes: DataFrame, axes: list[str]) -> DataFrame:
    """Means and sums of ``replay`` per policy."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return outcomes.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n_units"), share("correct").alias("correctness"), *(share(f"correct_{a}").alias(f"correct_{a}") for a in axes), F.avg("completed").alias("completed"),
        F.sum("nfe").alias("total_nfe"), F.sum("scoring_calls").alias("scoring_calls"), share("retained").alias("winner_retention"), share("false_pruned").alias("false_prune_rate"), F.avg("regret").alias("regret"),
    )


def headroom_recovery(outcomes: DataFrame, axes: list[str], policy: str = "non_oracle_axis_gated", oracle: str = "oracle_axis_gated", scalars: tuple[str, ...] = SCALAR, n_boot: int = 1000, seed: str = "recovery") -> DataFrame:
    """measure (correct or an axis), recovery, ci_low, ci_high, floor, replicates: the share of the way from the best scalar
    policy to the oracle that ``policy`` goes, in [0, 1].

    The best scalar policy is chosen anew in the sample and in every replicate, as its choice is part of what is uncertain.
    Undefined where there is no room between floor and oracle. One pass over the outcomes gives the sums of all replicates.
    """
    measures = {"correct": "correct"} | {a: f"correct_{a}" for a in axes}
    used = outcomes.where(F.col("policy").isin(policy, oracle, *scalars)).select("unit", "policy", *(F.coalesce(F.col(c), F.lit(False)).cast("int").alias(m) for m, c in measures.items()))
    sums = replicate_sums(used, ["policy"], ["unit"], list(measures), n_boot, seed)
    each = sums.select("policy", "b", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), mean(m).alias("x")) for m in measures))).alias("_m")).select("policy", "b", "_m.*")
    side = lambda *names: F.max(F.when(F.col("policy").isin(*names), F.col("x")))
    per = each.groupBy("measure", "b").agg(side(policy).alias("x"), side(oracle).alias("top"), side(*scalars).alias("floor"))
    room = F.col("top") - F.col("floor")
    share = F.when(room > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - F.col("floor")) / room)))
    return windows(per, ["measure"], share, floor=F.col("floor")).select("measure", F.col("point").alias("recovery"), "ci_low", "ci_high", "floor", "replicates")
