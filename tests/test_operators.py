"""Known answers and edge cases of the measurement operators."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import exprs
from gaugeworks.functions.hooks import measured
from gaugeworks.operators import agreement as ag
from gaugeworks.operators import checks as ck
from gaugeworks.operators import curves as cv
from gaugeworks.operators import inference as nf
from gaugeworks.operators import resampling as rs
from gaugeworks.operators import sampling as sm
from gaugeworks.sources import journal as jn


def one(df):
    return df.collect()[0]


def test_pairwise_agreement(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "unit int, label string")
    got = {r.unit: r.agreement for r in ag.pairwise_agreement(df, ["unit"]).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 1.0}


def test_confident_agreement_is_undefined_below_two(spark):
    df = spark.createDataFrame([(1, "abstain"), (1, "a"), (2, "a"), (2, "a"), (2, "abstain")], "unit int, label string")
    got = {r.unit: (r.agreement, r.n_conf) for r in ag.confident_agreement(df, ["unit"]).collect()}
    assert got == {1: (None, 1), 2: (1.0, 2)}


def test_krippendorff_is_one_or_zero(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "unit int, label string")
    assert {r.unit: r.alpha for r in ag.krippendorff_nominal(df, ["unit"]).collect()} == {1: 1.0, 2: 0.0}


def test_vector_agreement_zero_norm_counts_as_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 0.0])], "unit int, v array<double>")
    assert one(ag.vector_agreement(df, ["unit"])).agreement == pytest.approx(1 / 3)


def test_rater_agreement_edges(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "a string, b string")
    r = one(ag.rater_agreement(df, []))
    assert (r.p_o, r.kappa, r.ac1, r.pabak) == (1.0, 1.0, 1.0, 1.0)
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "a string, b string")
    r = one(ag.rater_agreement(df, []))
    assert r.kappa == pytest.approx(0.5) and r.pabak == pytest.approx(0.5)


def test_auroc_ties_and_missing_class(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "x int, y int")
    assert one(ag.auroc(df, "x", "y")).auroc == pytest.approx(0.75)
    assert one(ag.auroc(df.where("y = 1"), "x", "y")).auroc is None


def test_interval_iou_known_answers(spark):
    df = spark.createDataFrame([(0.0, 3.0, 0.5, 3.0), (1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert [r.x for r in df.select(exprs.interval_iou(*map(F.col, "abcd")).alias("x")).collect()] == [pytest.approx(5 / 6), 1.0, 0.0]


def test_gain_rules(spark):
    df = spark.createDataFrame([(0.5, 0.2), (0.9, 1.0), (None, 0.1)], "f double, i double")
    assert [r.g for r in df.select(exprs.gain(F.col("f"), F.col("i")).alias("g")).collect()] == [pytest.approx(0.375), 0.0, None]
    assert [r.g for r in df.select(exprs.gain(F.col("f"), F.col("i"), "null").alias("g")).collect()][1] is None


def curve(spark, values):
    return spark.createDataFrame([(1, s, v) for s, v in values], "unit int, s double, v double")


def test_crossings(spark):
    df = curve(spark, [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)])
    assert one(cv.interpolated_crossing(df, ["unit"], "v", 0.75)).crossing == pytest.approx(0.75)
    assert one(cv.grid_crossing(df, ["unit"], "v", 0.75)).crossing == 1.0
    assert one(cv.interpolated_crossing(df, ["unit"], "v", 2.0)).crossing is None
    undefined = curve(spark, [(0.0, None), (0.25, None), (0.45, 0.9), (1.0, None)])
    assert one(cv.grid_crossing(undefined, ["unit"], "v", 0.7)).crossing == 0.45
    assert one(cv.interpolated_crossing(undefined, ["unit"], "v", 0.7)).crossing is None


def test_survival_median_known_answer(spark):
    df = spark.createDataFrame([("x", 0.15, True), ("x", 0.35, True), ("x", 1.0, False)], "axis string, time double, e boolean")
    assert one(cv.survival_median(df, ["axis"], "time", F.col("e"))).median == pytest.approx(0.35)


def test_ordering_text(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.2), (1, "c", 0.5)], "k int, axis string, v double")
    assert {r.ordering for r in cv.ranking(df, ["k"], "axis", "v").collect()} == {"a < b = c"}


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    df = spark.createDataFrame([("x", i, float(i % 10)) for i in range(60)], "axis string, unit int, v double")
    a, b = (one(rs.bootstrap_mean(df.repartition(n), ["axis"], "unit", "v", 80)) for n in (1, 3))
    assert a.ci_low < a.mean == 4.5 < a.ci_high and a == b
    single = one(rs.bootstrap_mean(df.where("unit = 7"), ["axis"], "unit", "v", 10))
    assert single.ci_low == single.ci_high == 7.0


def test_clopper_pearson_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10)], "k int, n int")
    low, high = nf.clopper_pearson(F.col("k"), F.col("n"))
    got = [(r.low, r.high) for r in df.select(low.alias("low"), high.alias("high")).collect()]
    assert got[0] == (0.0, pytest.approx(1 - 0.025 ** 0.1)) and got[1][1] == 1.0
    assert got[2] == (pytest.approx(0.1871, abs=1e-4), pytest.approx(0.8129, abs=1e-4))


def test_hash_modulo_equals_python(spark):
    import hashlib

    df = spark.createDataFrame([(str(i),) for i in range(20)], "k string")
    got = [r.m for r in df.select(sm.hash_modulo(F.col("k"), 10).alias("m")).collect()]
    assert got == [int(hashlib.sha256(str(i).encode()).hexdigest(), 16) % 10 for i in range(20)]


def test_split_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "s string, u int")
    n = {(r.s, r.split): r["count"] for r in sm.stratified_split(df, "s", "u", 0.5, "x").groupBy("s", "split").count().collect()}
    assert n[("a", "train")] == 2 and n[("b", "eval")] == 1


def test_completeness_and_reconciliation(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (2, None), (4, 5.0)], "k int, v double")
    e = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {(r.k, r.problem) for r in ck.completeness(a, e, ["k"]).collect()} == {(2, "duplicate"), (3, "missing"), (4, "extra")}
    b = spark.createDataFrame([(1, 1.0), (4, None)], "k int, v double")
    r = one(ck.reconcile(a.where("k <> 2"), b, ["k"], ["v"], 1e-9))
    assert (r.matches, r.mismatches) == (1, 1)


def test_journal_round_trip_and_broken_lines(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"gen_id": "g", "axis_id": "x", "target": {"axis_id": "x", "kind": "label", "label": "a"}, "extra": {"role": "fork", "clip": "c", "s": 0.5}}\n{broken\n')
    rows = jn.read_journal(spark, str(path)).collect()
    assert sorted((r.label, r.role, r.broken is not None) for r in rows if r.label) == [("a", "fork", False)]
    assert sum(r.broken is not None for r in rows) == 1


def test_missing_value_dialect(spark):
    df = spark.createDataFrame([("",), ("None",), ("nan",), ("NaN",), ("1.5",), (None,)], "x string")
    assert [r.y for r in df.select(jn.undefined_to_null(F.col("x")).alias("y")).collect()] == [None, None, None, None, 1.5, None]


def test_measurer_runs_once_per_content_and_keeps_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "boom")], "id int, p string")

    def measure(p):
        if p == "boom":
            raise ValueError
        return p.upper()

    assert {(r.id, r.label, r.error) for r in measured(df, "p", measure).collect()} == {(1, "A", None), (2, "A", None), (3, None, "ValueError")}


def test_row_order_does_not_matter(spark):
    df = spark.createDataFrame([(i % 3, "ab"[i % 2]) for i in range(30)], "unit int, label string")
    a = ag.pairwise_agreement(df, ["unit"]).orderBy("unit").collect()
    assert a == ag.pairwise_agreement(df.orderBy(F.desc("label")).repartition(5), ["unit"]).orderBy("unit").collect()
