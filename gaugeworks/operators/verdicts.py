"""Verdicts over cells of a grid: exchangeability with its guards, micro-map criteria, self-target gate, stability of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curves import non_overlap
from .decisions import tokens
from .inference import normal_tail
from .ordering import average_rank
from .resampling import mean, replicate_sums, windows

# Fixed values of the exchangeability rules.
ALPHA = 0.05
LOW_P_MOST = 2
EXCEED_MOST = 3
GROSS_FACTOR = 3.0
GROSS_TV = 0.9
LEAST_REJECTED = 0.80
LEAST_NULL_P = 0.01
MOST_OF_CROSS = 0.9
LEAST_SHIFT_P = 0.01

# Fixed values of the micro-map criteria.
EARLY, LATE = 0.05, 0.90
LATE_LEAST = 0.90
FLOOR_LEAST, FLOOR_MOST = -0.02, 0.25
FALL_MOST = 0.02
PINNED_ABOVE, PINNED_SHARE = 0.9, 12 / 16
ABSTAIN_MOST = 0.30
SAME = 1.0 - 1e-9
SCORABLE_LEAST = 12
HALF_WIDTH_MOST = 0.05
READABLE_MARGIN = 0.15


def number(x: Column) -> Column:
    """A double without a needless fraction: 1, 4.5."""
    return F.regexp_replace(x.cast("double").cast("string"), "\\.0$", "")


def kernel_token(passed: Column, cfg: Column, schedule: Column) -> Column:
    """CFG_KERNEL_OK or CFG_KERNEL_FAIL with the setting, and the schedule where it is not constant."""
    suffix = F.when(schedule != "constant", F.concat(F.lit(", schedule="), schedule)).otherwise("")
    return F.concat(F.when(passed, "CFG_KERNEL_OK(cfg=").otherwise("CFG_KERNEL_FAIL(cfg="), number(cfg), suffix, F.lit(")"))


def design_reasons(cells: DataFrame, keys: list[str], expected_s: list[float], per_s: int) -> DataFrame:
    """keys, reasons: the first thing wrong with a grid of cells, nothing if it has exactly ``per_s`` cells at every expected s."""
    n = cells.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n"))
    want = F.array(*(F.lit(float(s)) for s in expected_s))
    facts = n.groupBy(*keys).agg(F.collect_set("s").alias("have"), F.bool_or(F.array_contains(want, F.col("s")) & (F.col("n") != per_s)).alias("bad"))
    missing, extra = F.array_sort(F.array_except(want, "have")), F.array_sort(F.array_except("have", want))
    told = lambda what, xs: F.concat(F.lit(what), F.array_join(F.transform(xs, number), ","))
    reason = F.when(F.size(missing) > 0, told("missing s=", missing)).when(F.col("bad"), F.lit(f"cells per s are not {per_s}")).when(F.size(extra) > 0, told("unregistered s=", extra))
    return facts.select(*keys, F.array_compact(F.array(reason)).alias("reasons"))


def guard_reasons(guards: DataFrame, thresholds: DataFrame) -> DataFrame:
    """reasons (one row): why the test certifies nothing. ``guards``: one row of power_reject, cross_median, cross_p95, null_p;
    ``thresholds``: s, theta_mmd. A threshold is compared with the cross-unit 95th percentile, or the median where that is undefined."""
    worst = thresholds.agg(F.array_sort(F.collect_list(F.struct("s", F.col("theta_mmd").alias("theta")))).alias("_t"))
    level = F.coalesce("cross_p95", "cross_median")
    low = lambda t: t["theta"].isNull() | (t["theta"] <= 0)
    near = lambda t: (level > 0) & (t["theta"] > MOST_OF_CROSS * level)
    g3 = F.array_compact(F.transform("_t", lambda t: F.when(low(t), F.concat(F.lit("g3 degenerate s="), number(t["s"]))).when(near(t), F.concat(F.lit("g3 not separated s="), number(t["s"])))))
    first = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("power_reject") >= LEAST_REJECTED, F.lit(False)), "g1 power"),
        F.when(~F.coalesce(F.col("null_p") >= LEAST_NULL_P, F.lit(False)), "g2 null"),
    ))
    return guards.join(worst).select(F.concat(first, g3).alias("reasons"))


def internal_null(cells: DataFrame, guards: DataFrame, thresholds: DataFrame, expected_s: list[float] = (EARLY, LATE), per_s: int = 16, low_p_most: int = LOW_P_MOST) -> DataFrame:
    """cfg, schedule, token, passed, underpowered, reasons of the hard rule: a complete grid, healthy guards, and at every s at
    most ``low_p_most`` cells with p below ALPHA. A grid or guard that fails makes the verdict underpowered, never a pass.

    ``cells``: cfg, schedule, s, p_value, one row a cell.
    """
    keys = ["cfg", "schedule"]
    low = cells.groupBy(*keys, "s").agg(F.count_if(F.col("p_value") < ALPHA).alias("low"))
    rule = low.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("low") > low_p_most, F.concat(F.lit("low p at s="), number(F.col("s")))))).alias("failed"))
    return _decided(cells, keys, expected_s, per_s, rule, guard_reasons(guards, thresholds))


def calibrated(cells: DataFrame, null: DataFrame, expected_s: list[float] = (EARLY, LATE), per_s: int = 16, exceed_most: int = EXCEED_MOST) -> DataFrame:
    """cfg, schedule, token, passed, underpowered, reasons of cells judged against ``null`` cells (s, mmd2, tv): at every s and
    for both statistics no shift upwards (one-sided rank test, normal approximation with ties), at most ``exceed_most``
    cells above the null's 95th percentile, and none grossly above it. Fewer than three null values fail."""
    keys = ["cfg", "schedule"]
    stat = F.explode(F.array(F.struct(F.lit("mmd").alias("stat"), F.col("mmd2").alias("x")), F.struct(F.lit("tv").alias("stat"), F.col("tv").alias("x")))).alias("_v")
    mine = cells.select(*keys, "s", stat).select(*keys, "s", "_v.*").where("x is not null")
    base = null.select("s", stat).select("s", "_v.*").where("x is not null")
    limits = base.groupBy("s", "stat").agg(F.percentile("x", F.lit(0.95)).alias("theta"), F.count(F.lit(1)).alias("n0"))
    by = [*keys, "s", "stat"]
    over = mine.join(limits, ["s", "stat"])
    gross = F.least(GROSS_FACTOR * F.col("theta"), F.when(F.col("stat") == "tv", F.lit(GROSS_TV)).otherwise(F.lit(float("inf"))))
    exceed = over.groupBy(*by).agg(F.count(F.lit(1)).alias("n1"), F.max("n0").alias("n0"), F.count_if(F.col("x") > F.col("theta")).alias("above"), F.count_if(F.col("x") > gross).alias("gross"))
    both = mine.withColumn("g", F.lit(1)).unionByName(mine.select(*keys).distinct().join(base).withColumn("g", F.lit(0)).select(*by, "x", "g"))
    ranked = average_rank(both, "x", "r", by)
    ties = both.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    rank_sum = ranked.groupBy(*by).agg(F.sum(F.when(F.col("g") == 1, F.col("r"))).alias("r1"))
    n1, n0 = F.col("n1"), F.col("n0")
    total = n1 + n0
    var = n1 * n0 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    z = F.when(var > 0, (F.col("r1") - n1 * (n1 + 1) / 2 - n1 * n0 / 2 - 0.5) / F.sqrt(var)).otherwise(0.0)
    tested = exceed.join(ties, by).join(rank_sum, by).withColumn("p", normal_tail(z))
    told = lambda what: F.concat(F.col("stat"), F.lit(f":{what} s="), number(F.col("s")))
    wrong = F.array_compact(F.array(F.when(n0 < 3, told("data")), F.when((n0 >= 3) & (F.col("p") < LEAST_SHIFT_P), told("shift")), F.when((n0 >= 3) & (F.col("above") > exceed_most), told("exceedance")), F.when((n0 >= 3) & (F.col("gross") > 0), told("gross"))))
    rule = tested.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(wrong))).alias("failed"))
    # a statistic that no cell has, or no null cell, is data that is missing
    want = F.array(*(F.struct(F.lit(float(s)).alias("s"), F.lit(k).alias("stat")) for s in expected_s for k in ("mmd", "tv")))
    have = tested.groupBy(*keys).agg(F.collect_set(F.struct("s", "stat")).alias("have"))
    lacking = cells.select(*keys).distinct().join(have, keys, "left").select(*keys, F.transform(F.array_except(want, F.coalesce("have", F.slice(want, 1, 0))), lambda x: F.concat(x["stat"], F.lit(":data s="), number(x["s"]))).alias("lacking"))
    rule = lacking.join(rule, keys, "left").select(*keys, F.array_sort(F.concat("lacking", F.coalesce("failed", F.slice("lacking", 1, 0)))).alias("failed"))
    return _decided(cells, keys, expected_s, per_s, rule, None)


def _decided(cells, keys, expected_s, per_s, rule, guards) -> DataFrame:
    design = design_reasons(cells, keys, list(expected_s), per_s).withColumnRenamed("reasons", "design")
    both = design.join(rule, keys)
    both = both.join(guards.withColumnRenamed("reasons", "guards")) if guards is not None else both.withColumn("guards", F.slice("design", 1, 0))
    instrument = F.when(F.size("design") > 0, F.col("design")).otherwise(F.col("guards"))
    under = F.size(instrument) > 0
    passed = ~under & (F.size("failed") == 0)
    return both.select(*keys, kernel_token(passed, F.col("cfg"), F.col("schedule")).alias("token"), passed.alias("passed"), under.alias("underpowered"), F.when(under, instrument).otherwise(F.col("failed")).alias("reasons"))


def incomplete(forks: DataFrame, baselines: DataFrame, emb: DataFrame, emb_base: DataFrame, determinism: DataFrame, clips: int, cfgs: list[float], grid: list[float], axes: list[str]) -> DataFrame:
    """problem, n: what is missing from a run's cells. A cell may hold an undefined agreement but must be there; embedding cells
    and determinism scores must be defined."""
    spark = forks.sparkSession
    units = forks.select("clip").distinct()
    number_of = lambda xs, t: spark.createDataFrame([(x,) for x in xs], t)
    cells = units.join(number_of([float(c) for c in cfgs], "cfg double")).join(number_of(axes, "axis string"))
    stepped = number_of([float(s) for s in grid], "s double")
    lacking = lambda want, have, on, name: want.join(have.select(*on).distinct(), on, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        units.agg(F.abs(F.count(F.lit(1)) - clips).alias("n")).select(F.lit("clips").alias("problem"), "n"),
        lacking(cells.join(stepped), forks, ["clip", "cfg", "axis", "s"], "fork cells"),
        lacking(cells, baselines, ["clip", "cfg", "axis"], "baselines"),
        lacking(cells.select("clip", "cfg").distinct().join(stepped), emb.where("a_fork_emb is not null"), ["clip", "cfg", "s"], "embedding cells"),
        lacking(cells.select("clip", "cfg").distinct(), emb_base.where("a_ind_emb is not null"), ["clip", "cfg"], "embedding baselines"),
        lacking(number_of(axes, "axis string"), determinism.where("score is not null"), ["axis"], "determinism scores"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


def micromap_criteria(forks: DataFrame, baselines: DataFrame, emb: DataFrame, emb_base: DataFrame, determinism: DataFrame, gate: DataFrame, cfg: float = 1.0, class_axis: str = "class", scorable: int = SCORABLE_LEAST, n_boot: int = 1000) -> DataFrame:
    """criterion, passed, reasons for endpoints, monotonicity, kernel_headline, measurer_determinism and informativeness.

    ``forks``: clip, cfg, axis, s, a_fork, n_conf, abstain; ``baselines``: clip, cfg, axis, a_ind, n_conf; ``emb``: clip, cfg,
    s, a_fork_emb; ``emb_base``: clip, cfg, a_ind_emb; ``determinism``: axis, score; ``gate``: one row of passed and
    early_ok, the exchangeability at the first s. Only the headline ``cfg`` counts. Intervals resample clips.
    """
    f, b = forks.where(F.col("cfg") == cfg), baselines.where(F.col("cfg") == cfg)
    at = lambda s, c: F.avg(F.when(F.col("s") == s, F.col(c)))
    fit = lambda s: F.count_if((F.col("s") == s) & (F.col("n_conf") >= 2))
    side = f.groupBy("axis").agg(at(LATE, "a_fork").alias("late"), at(EARLY, "a_fork").alias("early"), fit(LATE).alias("n_late"), fit(EARLY).alias("n_early"))
    ind = b.groupBy("axis").agg(F.avg("a_ind").alias("ind"), F.count_if(F.col("n_conf") >= 2).alias("n_ind"))
    floor = F.col("early") - F.col("ind")
    told = lambda text, on: F.when(on, F.concat(F.col("axis"), F.lit(f": {text}")))
    few = (F.col("n_late") < scorable) | (F.col("n_early") < scorable) | (F.col("n_ind") < scorable)
    ends = side.join(ind, "axis").select(F.array_compact(F.array(
        told("too few scorable clips", few), told("late agreement too low", ~F.coalesce(F.col("late") >= LATE_LEAST, F.lit(False))), told("early gap undefined", floor.isNull()),
        told("anti-correlation", floor < FLOOR_LEAST), told("near-deterministic from noise", floor > FLOOR_MOST),
    )).alias("r"))
    e, eb = emb.where(F.col("cfg") == cfg), emb_base.where(F.col("cfg") == cfg).select("clip", "a_ind_emb")
    own = lambda s: F.max(F.when(F.col("s") == s, F.col("a_fork_emb")))
    clips = e.groupBy("clip").agg(own(EARLY).alias("early"), own(LATE).alias("late")).join(eb, "clip", "left")
    clips = clips.select("clip", (F.col("early") - F.col("a_ind_emb")).alias("floor"), (F.col("late") - F.col("early")).alias("growth"), "early")
    sums = replicate_sums(clips, [], ["clip"], ["floor", "growth", "early"], n_boot, "endpoints")
    drawn = lambda v, q: F.percentile(F.when(F.col("b") >= 0, mean(v)), F.lit(q))
    ci = sums.agg(drawn("floor", 0.025).alias("f_lo"), drawn("growth", 0.025).alias("g_lo"), ((drawn("early", 0.975) - drawn("early", 0.025)) / 2).alias("half"))
    no = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), text)
    shape = ci.select(F.array_compact(F.array(no(F.col("f_lo") > 0, "E1: floor interval holds 0"), no(F.col("half") <= HALF_WIDTH_MOST, "E1: floor unstable"), no(F.col("g_lo") > 0, "E2: growth interval holds 0"))).alias("r"))
    early = gate.select(F.array_compact(F.array(no(F.col("early_ok"), f"not exchangeable at s={EARLY:g}"))).alias("r"))
    endpoints = ends.unionByName(shape).unionByName(early).agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("reasons")).withColumn("criterion", F.lit("endpoints"))

    ind_of = b.where("a_ind is not null").select("clip", "axis", "a_ind")
    commit = F.when(F.col("a_ind") >= 1 - 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a_fork") - F.col("a_ind")) / (1 - F.col("a_ind")))))
    curve = f.join(ind_of, ["clip", "axis"]).withColumn("g", F.when(F.col("a_fork").isNotNull(), commit))
    step = curve.withColumn("d", F.col("g") - F.lag("g").over(Window.partitionBy("clip", "axis").orderBy("s")))
    falls = windows(replicate_sums(step.where("d is not null"), ["axis", "s"], ["clip"], ["d"], n_boot, "monotone"), ["axis", "s"], mean("d"))
    fallen = falls.where((F.col("point") < -FALL_MOST) & (F.col("ci_high") < -FALL_MOST)).select(F.concat("axis", F.lit(": falls before s="), number(F.col("s"))).alias("x"))
    unscored = f.select("axis").distinct().join(ind_of.select("axis").distinct(), "axis", "left_anti").select(F.concat("axis", F.lit(": no scorable curves")).alias("x"))
    monotone = fallen.unionByName(unscored).agg(F.array_sort(F.collect_list("x")).alias("reasons")).withColumn("criterion", F.lit("monotonicity"))

    kernel = gate.select(F.array_compact(F.array(no(F.col("passed"), "headline kernel not exchangeable"))).alias("reasons")).withColumn("criterion", F.lit("kernel_headline"))
    unsteady = determinism.where(~F.coalesce(F.col("score") >= SAME, F.lit(False))).select(F.concat("axis", F.lit(": not deterministic")).alias("x"))
    steady = unsteady.agg(F.array_sort(F.collect_list("x")).alias("reasons")).withColumn("criterion", F.lit("measurer_determinism"))
    pinned = b.where(F.col("axis") == class_axis).agg((F.count_if(F.col("a_ind") > PINNED_ABOVE) / F.count(F.lit(1)) >= PINNED_SHARE).alias("pinned"))
    silent = f.where((F.col("axis") == class_axis) & (F.col("s") == LATE)).agg((F.avg("abstain") > ABSTAIN_MOST).alias("silent"))
    informative = pinned.join(silent).select(F.array_compact(F.array(F.when(F.col("pinned"), "pool pinned"), F.when(F.col("silent"), "abstain cap exceeded"))).alias("reasons")).withColumn("criterion", F.lit("informativeness"))
    out = endpoints
    for part in (monotone, kernel, steady, informative):
        out = out.unionByName(part)
    return out.select("criterion", (F.size("reasons") == 0).alias("passed"), "reasons")


ORDER = ("endpoints", "monotonicity", "kernel_headline", "measurer_determinism", "informativeness")


def micromap_token(criteria: DataFrame) -> DataFrame:
    """token (one row): MICROMAP_PASS, or MICROMAP_FAIL with the criteria that failed in their order."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("criterion"))
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct(place.alias("i"), "criterion")))), lambda x: x["criterion"]), ",")
    got = criteria.agg(failed.alias("f"))
    return got.select(F.when(F.col("f") == "", "MICROMAP_PASS").otherwise(F.concat(F.lit("MICROMAP_FAIL("), "f", F.lit(")"))).alias("token"))


def self_target(reliability: DataFrame, theta_rel: float, theta_robust: float, diagnostic: str = "class") -> DataFrame:
    """Add passed, reason and kept_diagnostic: measured twice alike and robust to perturbation; validity has no say.

    An axis named ``diagnostic`` that is deterministic but not robust is kept in maps without counting.
    """
    sure, steady = F.coalesce(F.col("determinism") >= theta_rel, F.lit(False)), F.coalesce(F.col("robustness") >= theta_robust, F.lit(False))
    reason = F.when(sure & steady, "self-target OK").otherwise(F.concat(F.lit("self-target FAIL: "), F.concat_ws(",", F.when(~sure, "determinism"), F.when(~steady, "robustness"))))
    return reliability.withColumns({"passed": sure & steady, "reason": reason, "kept_diagnostic": (F.col("axis") == diagnostic) & sure & ~steady})


def ordering_stable(commit: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordering, stable: the axes with a defined s_hat by s_hat (ties by name), and whether a second setting has the same order; null without one."""
    def order(df: DataFrame, name: str) -> DataFrame:
        return df.where("s_hat is not null").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_hat", "axis"))), lambda x: x["axis"]).alias(name))

    shared = other.join(commit.where("s_hat is not null").select(*keys, "axis"), [*keys, "axis"], "left_semi")
    both = order(commit, "ordering").join(order(shared, "_other"), keys, "left").join(other.select(*keys).distinct().withColumn("_given", F.lit(True)), keys, "left")
    return both.select(*keys, "ordering", F.when(F.col("_given"), F.coalesce(F.col("ordering") == F.col("_other"), F.lit(False))).alias("stable"))


def phase_tokens(commit: DataFrame, other: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens, ordered, stable: GO_MAP if the windows don't overlap (touching counts as overlap) and their order is
    the same in a second setting; GO_READOUT if a committed axis reads well before the end; else GO_RESTRICTED or
    GO_DIAGNOSTIC. ``read``: keys, axis, s_hat, of which an axis' earliest counts."""
    done = commit.where("s_hat is not null")
    n = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    apart = non_overlap(done, keys, strict=True).join(n, keys).select(*keys, (F.col("ordered") & (F.col("n") >= 2)).alias("ordered"))
    reads = read.where("s_hat is not null").groupBy(*keys, "axis").agg(F.min("s_hat").alias("r")).join(done.select(*keys, "axis"), [*keys, "axis"])
    readable = reads.groupBy(*keys).agg(F.bool_or(F.col("r") <= 1 - READABLE_MARGIN).alias("readable"))
    facts = commit.select(*keys).distinct().join(apart, keys, "left").join(readable, keys, "left").join(ordering_stable(commit, other, keys), keys, "left")
    apart_, mapped = F.coalesce("ordered", F.lit(False)), F.coalesce("ordered", F.lit(False)) & F.coalesce("stable", F.lit(False))
    found = tokens(("GO_MAP", mapped), ("GO_READOUT", F.col("readable")), ("GO_RESTRICTED", ~mapped & apart_), ("GO_DIAGNOSTIC", ~mapped & ~apart_))
    return facts.select(*keys, found.alias("tokens"), apart_.alias("ordered"), "stable")
