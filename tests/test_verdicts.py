"""Known answers of the exchangeability verdict, the micro-map criteria, the self-target gate and exact intervals."""

import math
import sys

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.hooks import BATCH, measured
from gaugeworks.operators import inference as nf
from gaugeworks.operators import verdicts as ve

CELL = "cfg double, schedule string, s double, clip int, p_value double, mmd2 double, tv double"


def cells(spark, cfg=1.0, schedule="constant", n=16, grid=(0.05, 0.9), low=(), shift=0.0):
    rows = [(cfg, schedule, s, c, 0.01 if c in low else 0.5, 0.10 + 0.001 * c + shift, 0.3 + 0.001 * c + shift) for s in grid for c in range(n)]
    return spark.createDataFrame(rows, CELL)


def guards(spark, power=0.9, median=0.5, p95=1.0, null_p=0.4):
    return spark.createDataFrame([(power, median, p95, null_p)], "power_reject double, cross_median double, cross_p95 double, null_p double")


def limits(spark, *thetas):
    return spark.createDataFrame([(s, t) for s, t in zip((0.05, 0.9), thetas, strict=True)], "s double, theta_mmd double")


def verdict(df):
    r = df.first()
    return r.token, r.passed, r.underpowered, r.reasons


def test_internal_null_passes_and_fails_by_low_p_cells(spark):
    g, t = guards(spark), limits(spark, 0.2, 0.2)
    assert verdict(ve.internal_null(cells(spark, low=(0, 1)), g, t)) == ("CFG_KERNEL_OK(cfg=1)", True, False, [])
    assert verdict(ve.internal_null(cells(spark, low=(0, 1, 2)), g, t)) == ("CFG_KERNEL_FAIL(cfg=1)", False, False, ["low p at s=0.05", "low p at s=0.9"])
    assert verdict(ve.internal_null(cells(spark, 4.5, "g2"), g, t))[0] == "CFG_KERNEL_OK(cfg=4.5, schedule=g2)"


@pytest.mark.parametrize(("change", "reasons"), [
    ({"power": 0.79}, ["g1 power"]), ({"power": None}, ["g1 power"]), ({"null_p": 0.009}, ["g2 null"]), ({"p95": 0.21}, ["g3 not separated s=0.05"]), ({"p95": None, "median": 0.2}, ["g3 not separated s=0.05"]),
    ({"power": 0.1, "null_p": None}, ["g1 power", "g2 null"]),
])
def test_each_guard_makes_a_verdict_underpowered(spark, change, reasons):
    got = verdict(ve.internal_null(cells(spark), guards(spark, **change), limits(spark, 0.2, 0.1)))
    assert got == ("CFG_KERNEL_FAIL(cfg=1)", False, True, reasons)


def test_degenerate_thresholds(spark):
    got = verdict(ve.internal_null(cells(spark), guards(spark), limits(spark, 0.0, None)))
    assert got[2:] == (True, ["g3 degenerate s=0.05", "g3 degenerate s=0.9"])


@pytest.mark.parametrize(("change", "reason"), [({"grid": (0.05,)}, "missing s=0.9"), ({"n": 15}, "cells per s are not 16"), ({"grid": (0.05, 0.5, 0.9)}, "unregistered s=0.5")])
def test_a_grid_that_is_not_the_registered_one_never_passes(spark, change, reason):
    assert verdict(ve.internal_null(cells(spark, **change), guards(spark), limits(spark, 0.2, 0.2)))[1:] == (False, True, [reason])
    assert verdict(ve.calibrated(cells(spark, **change), cells(spark)))[1:] == (False, True, [reason])


def test_calibrated_cells(spark):
    null = cells(spark)
    assert verdict(ve.calibrated(cells(spark, 4.5), null)) == ("CFG_KERNEL_OK(cfg=4.5)", True, False, [])
    token, passed, under, reasons = verdict(ve.calibrated(cells(spark, 4.5, shift=0.02), null))
    assert (token, passed, under) == ("CFG_KERNEL_FAIL(cfg=4.5)", False, False)
    assert {"mmd:shift s=0.05", "mmd:exceedance s=0.05", "tv:shift s=0.9"} <= set(reasons) and not [r for r in reasons if "gross" in r]
    one = cells(spark, 4.5).withColumn("mmd2", F.when((F.col("clip") == 3) & (F.col("s") == 0.9), 5.0).otherwise(F.col("mmd2")))
    assert verdict(ve.calibrated(one, null))[3] == ["mmd:gross s=0.9"]
    few = null.where("clip < 2")
    assert "mmd:data s=0.05" in verdict(ve.calibrated(cells(spark, 4.5), few))[3]
    silent = cells(spark, 4.5).withColumn("tv", F.lit(None).cast("double"))
    assert verdict(ve.calibrated(silent, null))[3] == ["tv:data s=0.05", "tv:data s=0.9"]


def micromap(spark, late=0.97, early=0.5, ind=0.4, emb=(0.3, 0.45, 0.8), fall=None, scores=(1.0, 1.0), abstain=0.0, gate=(True, True), n_conf=8, deployed=0.97, clips=16):
    grid = (0.05, 0.3, 0.6, 0.9)
    value = {0.05: early, 0.3: max(early, 0.6), 0.6: 0.85 if fall is None else fall, 0.9: late}
    forks = [(c, g, a, s, (value[s] if g == 1.0 else deployed) + 0.002 * (c % 3), n_conf, abstain if a == "class" else 0.0) for c in range(clips) for g in (1.0, 4.5) for a in ("presence", "class") for s in grid]
    base = [(c, g, a, ind + 0.002 * (c % 2), n_conf) for c in range(clips) for g in (1.0, 4.5) for a in ("presence", "class")]
    embs = [(c, g, s, emb[1] + (emb[2] - emb[1]) * (s - 0.05) / 0.85 + 0.005 * (c % 4)) for c in range(clips) for g in (1.0, 4.5) for s in grid]
    return (
        spark.createDataFrame(forks, "clip int, cfg double, axis string, s double, a_fork double, n_conf int, abstain double"), spark.createDataFrame(base, "clip int, cfg double, axis string, a_ind double, n_conf int"),
        spark.createDataFrame(embs, "clip int, cfg double, s double, a_fork_emb double"), spark.createDataFrame([(c, g, emb[0] + 0.004 * (c % 5)) for c in range(clips) for g in (1.0, 4.5)], "clip int, cfg double, a_ind_emb double"),
        spark.createDataFrame(list(zip(("presence", "class"), scores, strict=True)), "axis string, score double"), spark.createDataFrame([gate], "passed boolean, early_ok boolean"),
    )


MICROMAPS = [
    ({}, "MICROMAP_PASS", []),
    ({"deployed": 0.5}, "MICROMAP_PASS", []),  # only the headline setting counts
    ({"late": 0.5}, "MICROMAP_FAIL(endpoints,monotonicity)", ["class: late agreement too low", "class: falls before s=0.9"]),
    ({"early": 0.55}, "MICROMAP_PASS", []),
    ({"early": 0.8}, "MICROMAP_FAIL(endpoints)", ["presence: near-deterministic from noise"]),
    ({"ind": 0.8, "early": 0.4}, "MICROMAP_FAIL(endpoints)", ["presence: anti-correlation"]),
    ({"fall": 0.3}, "MICROMAP_FAIL(monotonicity)", ["presence: falls before s=0.6"]),
    ({"gate": (False, True)}, "MICROMAP_FAIL(kernel_headline)", ["headline kernel not exchangeable"]),
    ({"gate": (True, False)}, "MICROMAP_FAIL(endpoints)", ["not exchangeable at s=0.05"]),
    ({"scores": (0.99, 1.0)}, "MICROMAP_FAIL(measurer_determinism)", ["presence: not deterministic"]),
    ({"scores": (1.0, None)}, "MICROMAP_FAIL(measurer_determinism)", ["class: not deterministic"]),
    ({"abstain": 0.4}, "MICROMAP_FAIL(informativeness)", ["abstain cap exceeded"]),
    ({"ind": 0.95, "early": 0.96}, "MICROMAP_FAIL(monotonicity,informativeness)", ["pool pinned"]),
    ({"n_conf": 1}, "MICROMAP_FAIL(endpoints)", ["class: too few scorable clips"]),
    ({"emb": (0.5, 0.45, 0.8)}, "MICROMAP_FAIL(endpoints)", ["E1: floor interval holds 0"]),
    ({"emb": (0.3, 0.45, 0.40)}, "MICROMAP_FAIL(endpoints)", ["E2: growth interval holds 0"]),
]


@pytest.mark.parametrize(("change", "token", "reasons"), MICROMAPS)
def test_micromap_criteria(spark, change, token, reasons):
    criteria = ve.micromap_criteria(*micromap(spark, **change), n_boot=100).cache()
    assert ve.micromap_token(criteria).first().token == token
    told = [r for row in criteria.collect() for r in row.reasons]
    assert set(reasons) <= set(told)
    criteria.unpersist()


def test_incomplete_runs_are_named(spark):
    forks, base, emb, emb_base, scores, _ = micromap(spark)
    check = lambda **k: {r.problem: r.n for r in ve.incomplete(**({"forks": forks, "baselines": base, "emb": emb, "emb_base": emb_base, "determinism": scores} | k), clips=16, cfgs=[1.0, 4.5], grid=[0.05, 0.3, 0.6, 0.9], axes=["presence", "class"]).collect()}
    assert check() == {}
    assert check(forks=forks.where("not (clip = 3 and s = 0.3 and cfg = 1.0)")) == {"fork cells": 2}
    assert check(emb=emb.withColumn("a_fork_emb", F.when(F.col("clip") > 0, F.col("a_fork_emb")))) == {"embedding cells": 8}
    assert check(determinism=scores.where("axis = 'class'"), forks=forks.where("clip < 15")) == {"determinism scores": 1, "clips": 1}


def test_self_target_gate_and_stability(spark):
    df = spark.createDataFrame([("presence", 0.99, 0.95), ("class", 0.99, 0.5), ("timing", 0.5, None)], "axis string, determinism double, robustness double")
    got = {r.axis: (r.passed, r.reason, r.kept_diagnostic) for r in ve.self_target(df, 0.95, 0.9).collect()}
    assert got == {"presence": (True, "self-target OK", False), "class": (False, "self-target FAIL: robustness", True), "timing": (False, "self-target FAIL: determinism,robustness", False)}
    windows = "k int, axis string, s_hat double, ci_low double, ci_high double"
    commit = spark.createDataFrame([(k, a, s, s - w, s + w) for k, w in ((0, 0.05), (1, 0.05), (2, 0.1), (3, 0.05)) for a, s in (("x", 0.2), ("y", 0.4))], windows)
    other = spark.createDataFrame([(0, "x", 0.3, 0.2, 0.4), (0, "y", 0.5, 0.4, 0.6), (1, "x", 0.6, 0.5, 0.7), (1, "y", 0.5, 0.4, 0.6), (2, "x", 0.1, 0.0, 0.2), (2, "y", 0.3, 0.2, 0.4)], windows)
    read = spark.createDataFrame([(0, "x", 0.95), (0, "x", 0.5), (1, "x", 0.9), (3, "q", 0.1)], "k int, axis string, s_hat double")
    got = {r.k: (r.tokens, r.ordered, r.stable) for r in ve.phase_tokens(commit, other, read, ["k"]).collect()}
    assert got == {0: (["GO_MAP", "GO_READOUT"], True, True), 1: (["GO_RESTRICTED"], True, False), 2: (["GO_DIAGNOSTIC"], False, True), 3: (["GO_RESTRICTED"], True, None)}


def test_clopper_pearson_equals_the_binomial_and_takes_large_n(spark):
    rows = [(0, 10), (10, 10), (5, 10), (1, 1000), (499, 1000), (2_500_000, 10_000_000), (None, 3), (4, 3), (0, 0)]
    df = spark.createDataFrame(rows, "k long, n long")
    low, high = nf.clopper_pearson(F.col("k"), F.col("n"))
    got = [(r.low, r.high) for r in df.select(low.alias("low"), high.alias("high")).collect()]
    tail = lambda k, n, p: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
    for (k, n), (a, b) in zip(rows[:5], got[:5], strict=True):
        assert a == 0.0 if k == 0 else tail(k, n, a) == pytest.approx(0.025, rel=1e-9)
        assert b == 1.0 if k == n else 1 - tail(k + 1, n, b) == pytest.approx(0.025, rel=1e-9)
    assert got[5] == (pytest.approx(0.24973168, abs=1e-7), pytest.approx(0.25026848, abs=1e-7))
    assert got[6:] == [(None, None)] * 3


def test_measurers_may_give_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, ""), (4, None), (5, "boom")], "id int, p string")

    def measure(p):
        if p == "boom":
            return [object()]
        return [len(p), 1] if p else "empty"

    got = {r.id: (r.label, r.embedding, r.error) for r in measured(df, "p", measure).collect()}
    assert got == {1: (None, [2.0, 1.0], None), 2: (None, [2.0, 1.0], None), 3: ("empty", None, None), 4: (None, None, None), 5: (None, None, "TypeError")}


def test_measurers_get_few_payloads_at_a_time(spark):
    df = spark.range(7 * BATCH).select("id", F.col("id").cast("string").alias("p")).coalesce(1)
    got = measured(df, "p", lambda p: [len(sys._getframe(1).f_locals["part"])])
    most = got.agg(F.max(F.get("embedding", F.lit(0))).alias("n"), F.count("embedding").alias("rows")).first()
    assert most.n <= BATCH and most.rows == 7 * BATCH
