"""Resampling in one pass: sums of all replicates against plain numpy, windows and budgets with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import resampling as rs


def rows(spark, n=300):
    rng = np.random.default_rng(4)
    data = [("xyz"[i % 3], i // 3, float(rng.normal()) if i % 7 else None, float(i % 2)) for i in range(n)]
    return data, spark.createDataFrame(data, "axis string, unit int, v double, e double")


def test_weights_are_poisson_and_fixed_by_seed_and_unit():
    w = rs.weights([str(i) for i in range(2000)], "s", 100)
    assert w.shape == (2000, 100)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (rs.weights(["7"], "s", 40) == rs.weights(["3", "7"], "s", 100)[1, :40]).all()
    assert (rs.weights(["7"], "t", 100) != w[7]).any()


@pytest.mark.parametrize("parts", [1, 5])
def test_replicate_sums_equal_numpy(spark, parts):
    data, df = rows(spark)
    got = {(r.axis, r.b): r for r in rs.replicate_sums(df.repartition(parts), ["axis"], ["unit"], ["v", "e"], 50, "s").collect()}
    assert len(got) == 3 * 51
    w = rs.weights([str(u) for _, u, _, _ in data], "s", 50)
    for axis in "xyz":
        mine = np.array([a == axis for a, *_ in data])
        v = np.array([np.nan if x is None else x for _, _, x, _ in data])
        for b in (-1, 0, 17, 49):
            weight = np.where(mine, 1 if b < 0 else w[:, b], 0).astype(float)
            r = got[(axis, b)]
            assert r.n == weight.sum() and r.n_v == weight[~np.isnan(v)].sum()
            assert r.sum_v == pytest.approx(np.nansum(weight * v)) and r.sum_e == pytest.approx(sum(weight * [e for *_, e in data]))


def test_weights_of_pairs_multiply(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0)], "i int, j int, x double")
    got = {r.b: r for r in rs.replicate_sums(df, [], ["i", "j"], ["x"], 30, "p").collect()}
    w = rs.weights(["1", "2", "3"], "p", 30).astype(float)
    for b in range(30):
        assert got[b].sum_x == 5 * w[0, b] * w[1, b] + w[1, b] * w[2, b]


def test_many_keys_null_keys_and_no_rows(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), "id", F.lit(2.0).alias("v"))
    sums = rs.replicate_sums(df, ["k", "g"], ["id"], ["v"], 3, "m").where("b = -1")
    assert sums.count() == 1500 and sums.where("g is null").count() == 750 and sums.agg(F.sum("sum_v")).first()[0] == 6000
    assert rs.bootstrap_mean(df.limit(0), ["k"], "id", "v").count() == 0


def test_interval_covers_the_mean_like_a_normal_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(rng.normal(10, 2, 400))], "axis string, unit int, v double")
    r = rs.bootstrap_mean(df, ["axis"], "unit", "v", 1000).first()
    assert (r.ci_high - r.ci_low) == pytest.approx(2 * 1.96 * 2 / 20, rel=0.12) and r.ci_low < r["mean"] < r.ci_high


def test_repeated_rows_of_a_unit_are_averaged_first(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.0), ("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, None)], "axis string, unit int, v double")
    r = rs.bootstrap_mean(df, ["axis"], "unit", "v", 20).first()
    assert (r["mean"], r.n, r.units) == (0.5, 2, 3)


def test_windows_count_all_units_and_drop_underpowered_ones_from_results(spark):
    curves = spark.createDataFrame([("a", u, s, (1.0 if s >= 0.5 else 0.0) if u < 8 else 0.0) for u in range(10) for s in (0.0, 0.5, 1.0)] + [("b", 1, 0.0, 1.0)], "axis string, unit int, s double, gain double")
    got = {(r.axis, r.theta): r for r in rs.threshold_sweep(curves, ["axis"], (0.5, 2.0), min_n=5).collect()}
    assert (got["a", 0.5].s_hat, got["a", 0.5].n, got["a", 0.5].crossed, got["a", 0.5].underpowered) == (0.25, 10, 8, False)
    assert got["a", 2.0].s_hat is None and got["a", 2.0].ci_low is None
    assert (got["b", 0.5].s_hat, got["b", 0.5].underpowered) == (0.0, True)


def test_determination_budget_of_known_shares(spark):
    rows = [(u, "x", s, 0.2 + 0.2 * (s > 0) + 0.4 * (s >= 1), 0.1, g) for u in range(4) for s, g in ((0.0, 0.1), (0.5, 0.5), (1.0, 0.9))]
    r = rs.determination_budget(spark.createDataFrame(rows, "unit int, axis string, s double, a_fork double, a_ind double, gain double"), ["axis"], 0.7, 50).first()
    assert [round(x, 6) for x in (r.conditioning, r.seed, r.trajectory, r.residual, r.s_commit)] == [0.1, 0.1, 0.6, 0.2, 1.0]
    assert (round(r.seed_lo, 6), round(r.seed_hi, 6), r.n) == (0.1, 0.1, 4)


def test_any_statistic_sees_repeats(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "axis string, unit int, v double")
    seen = rs.bootstrap_statistic(df, ["axis"], "unit", "v", lambda x: float(len(x)), 40).first()
    w = rs.weights([str(i) for i in range(50)], "stat", 40).sum(0)
    assert (seen.ci_low, seen.ci_high, seen.replicates) == (pytest.approx(np.percentile(w, 2.5)), pytest.approx(np.percentile(w, 97.5)), 40)
