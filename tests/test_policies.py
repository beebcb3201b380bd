"""Selection policies: pools, costs, retention and recovery with known answers."""

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.operators import policy as po

GATES = [(0.25, ["a"]), (0.5, ["b"])]
POOL = "unit int, cand int, a boolean, b boolean, ok boolean, score double"


def by_policy(df):
    return {r.policy: r for r in df.collect()}


def test_pool_of_majorities_and_cosines(spark):
    rows = [(1, 1, "x", [1.0, 0.0], [1.0, 0.0]), (1, 2, "x", [0.9, 0.1], [0.0, 1.0]), (1, 3, "y", [0.0, 1.0], [1.0, 0.1]), (2, 1, "b", [1.0], [1.0]), (2, 2, "a", [2.0], [1.0]), (3, 1, "z", [1.0], [1.0])]
    df = spark.createDataFrame(rows, "unit int, cand int, l string, v array<double>, f array<double>")
    got = {(r.unit, r.cand): r for r in po.build_pool(df, ["l"], ["v"], "f").collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)}  # one candidate is no pool
    assert [got[1, c].l for c in (1, 2, 3)] == [True, True, False]
    assert [got[2, c].l for c in (1, 2)] == [False, True]  # a tie goes to the smaller text
    assert sum(got[1, c].v for c in (1, 2, 3)) == 2 and not got[1, 3].v  # at least the median cosine
    assert max(got[1, c].v_score for c in (1, 2, 3)) == pytest.approx(1) and got[1, 3].v_score == 0
    assert got[1, 1].ok and not got[1, 3].ok and got[1, 3].score > got[1, 2].score


def test_gated_policy_costs_and_scores(spark):
    rows = [(1, 1, True, True, True, 0.1), (1, 2, True, False, False, 0.9), (1, 3, False, True, False, 0.8), (1, 4, False, False, False, 0.7)]
    df = spark.createDataFrame(rows, POOL)
    got = by_policy(po.replay(df, GATES, ["a", "b"], steps=25, tau=0.5))
    g = got["oracle_axis_gated"]
    # four scored, two pruned at 0.25 (6 each); two scored, one pruned at 0.5 (12); one completed and scored
    assert (g.winner, g.correct, g.completed, g.nfe, g.scoring_calls) == (1, True, 1, 2 * 6 + 12 + 25, 4 + 2 + 1)
    assert not g.retained and not g.false_pruned and g.regret == 0
    full = got["full_bon"]
    assert (full.winner, full.correct, full.completed, full.nfe, full.scoring_calls, full.regret, full.retained) == (2, False, 4, 100, 4, 1, True)
    d = got["diffrs_scalar"]
    assert (d.completed, d.nfe, d.scoring_calls, d.false_pruned) == (3, 75 + 6, 4 + 3, True)
    assert got["same_compute_bon"].completed == 2 and got["same_compute_bon"].nfe == 50  # 49 steps, rounded up to whole candidates
    assert got["random_prune"].completed == 2 and got["random_prune"].nfe == 2 * 25 + 2 * 6
    assert 1 <= got["smc_scalar"].completed <= 4


def test_no_gate_empties_a_unit_and_one_survivor_is_not_scored_again(spark):
    rows = [(1, 1, False, True, False, 0.4), (1, 2, False, False, False, 0.6), (2, 5, None, None, None, 0.1)]
    got = {(r.unit, r.policy): r for r in po.replay(spark.createDataFrame(rows, POOL), GATES, ["a", "b"], steps=25, tau=2.0).collect()}
    g = got[1, "oracle_axis_gated"]
    assert (g.winner, g.completed, g.nfe, g.scoring_calls) == (2, 1, 6 + 25, 2 + 1)
    assert (got[1, "diffrs_scalar"].winner, got[1, "diffrs_scalar"].completed) == (2, 1)
    assert (got[2, "oracle_axis_gated"].nfe, got[2, "oracle_axis_gated"].scoring_calls, got[2, "random_prune"].completed) == (25, 1, 1)
    assert got[2, "oracle_axis_gated"].correct is False


def test_costs_round_half_to_even():
    assert [po.charged(s, 25) for s in (0.25, 0.5, 0.1, 0.3)] == [6, 12, 2, 8]


def test_gates_group_axes_at_the_next_grid_point(spark):
    df = spark.createDataFrame([("x", 0.3), ("y", 0.4), ("z", 0.95), ("n", None)], "axis string, s_commit double")
    assert {r.gate: r.axes for r in po.gates_from_commit(df, (0.8, 0.4)).collect()} == {0.4: ["x", "y"]}


def outcome(unit, policy, right):
    return (unit, policy, bool(right), bool(right))


def test_recovery_takes_its_floor_anew_in_every_replicate(spark):
    rows = []
    for u in range(80):
        rows += [outcome(u, "full_bon", u < 40), outcome(u, "smc_scalar", u >= 40), outcome(u, "oracle_axis_gated", True), outcome(u, "non_oracle_axis_gated", u % 4)]
    df = spark.createDataFrame(rows, "unit int, policy string, correct boolean, correct_a boolean")
    got = {r.measure: r for r in po.headroom_recovery(df, ["a"], n_boot=300).collect()}
    r = got["correct"]
    assert (r.recovery, r.floor) == (pytest.approx(0.5), 0.5) and got["a"].recovery == r.recovery
    # either scalar policy may be the better one in a replicate: the floor is their maximum, so recovery lies lower than at a fixed floor
    fixed = po.headroom_recovery(df, [], scalars=("full_bon",), n_boot=300).first()
    assert r.ci_low < fixed.ci_low and r.ci_high < fixed.ci_high and r.ci_low < 0.5 < r.ci_high and r.replicates == 300


def test_recovery_without_room_is_undefined(spark):
    rows = [outcome(u, p, True) for u in range(5) for p in ("full_bon", "oracle_axis_gated", "non_oracle_axis_gated")]
    r = po.headroom_recovery(spark.createDataFrame(rows, "unit int, policy string, correct boolean, correct_a boolean"), ["a"], n_boot=20).first()
    assert r.recovery is None and r.ci_low is None and r.replicates == 0


def test_pool_of_odd_vectors(spark):
    rows = [(1, 1, "x", [1.0, 0.0]), (1, 2, "x", [0.0, 0.0]), (2, 1, "x", None), (2, 2, "x", [1.0, 2.0]), (3, 1, "x", [1.0]), (3, 2, "x", [1.0, 2.0]), (4, 1, "x", [3.0, 4.0]), (4, 2, "x", [3.0, 4.0])]
    df = spark.createDataFrame(rows, "unit int, cand int, l string, v array<double>").coalesce(1)
    got = {(r.unit, r.cand): r.score for r in po.build_pool(df, ["l"], ["v"], "v").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): None, (2, 2): None, (3, 1): 0.0, (3, 2): None, (4, 1): 1.0, (4, 2): 1.0}


def test_choices_of_a_chain_sort_a_unit_once(spark):
    rows = [(u, c, c % 2 == 0, c % 3 == 0, c % 6 == 0, float(c % 4)) for u in range(5) for c in range(1, 7)]
    df = spark.createDataFrame(rows, POOL)
    alive, _ = po.funnel(df, GATES, 25)
    plan = po.best(alive, "f")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Sort [") == 1
    assert {(r.unit, r.cand) for r in po.best(alive, "f").collect()} == {(u, 6) for u in range(5)}


def test_dealt_tables_get_more_parts_as_they_grow(spark, tmp_path):
    from gaugeworks.sources.tables import dealt

    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert dealt(df, ["id"], 100).rdd.getNumPartitions() == 10 and dealt(df, ["id"], 10_000).rdd.getNumPartitions() == 4


def test_counts_by_unit_need_one_shuffle_of_the_lines(spark, tmp_path):
    from gaugeworks.operators import agreement as ag
    from gaugeworks.plans.bindings import measurements

    rows = [(i % 9, 1 + i % 7, "OF"[i % 2], "ANR"[i % 3], float(i % 50), 0.05) for i in range(300)]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_linestatus string, l_returnflag string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    one, two = (ag.pairwise_agreement(measurements(spark, str(tmp_path), by_unit=b), ["axis", "unit"]) for b in (True, False))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


@pytest.mark.parametrize("odd", [False, True])
def test_cosines_are_rounded_in_batches_not_by_decimals(spark, odd):
    rng = np.random.default_rng(6)
    units = [[[float(x) for x in rng.normal(size=3)] for _ in range(4)] for _ in range(50)] + [[[1.0, 0.0, 0.0], [1.0, 1e-12, 0.0]]]
    for v, got in zip(units, po._to_mean(pa.array([*units, *([[None]] if odd else [])], pa.list_(pa.list_(pa.float64())))).to_pylist(), strict=False):
        total = np.sum(v, axis=0)
        exact = [float(np.dot(x, total) / (np.linalg.norm(x) * np.linalg.norm(total))) for x in v]
        assert got == [float(f"{min(1.0, x):.9f}") for x in exact]
    df = spark.createDataFrame([(1, c, "x", [float(c), 1.0]) for c in (1, 2)], "unit int, cand int, l string, f array<double>")
    plan = po.build_pool(df, ["l"], [], "f")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
