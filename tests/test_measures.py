"""Known answers of the operators over tables and measures, with nulls, ties and empty tables."""

import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import exprs
from gaugeworks.operators import inference as nf
from gaugeworks.operators import kernels as kn
from gaugeworks.operators import measures as ms
from gaugeworks.operators import probes as pr
from gaugeworks.operators import tables as tb


def one(df):
    return df.first()


def test_shares_of_a_curve_over_its_baseline_or_first_point(spark):
    df = spark.createDataFrame([("u", s, f, 0.2) for s, f in ((0.0, 0.3), (0.5, 0.6), (1.0, 0.9))] + [("v", 0.0, 1.0, 1.0), ("v", 1.0, 1.0, 1.0)], "unit string, s double, a_fork double, a_ind double")
    got = {r.unit: r for r in ms.shares(df, ["unit"]).collect()}
    assert [round(x, 9) for x in got["u"][1:]] == [0.2, 0.1, 0.6, 0.1, 0.875] and got["v"].end_gain is None
    assert round({r.unit: r for r in ms.shares(df, ["unit"], embedding=True).collect()}["u"].end_gain, 9) == round(0.6 / 0.7, 9)


def test_top_class_abstains_near_another_group(spark):
    df = spark.createDataFrame([(1, [0.5, 0.1, 0.3, 0.1]), (2, [0.3, 0.29, 0.3, 0.11]), (3, [0.1, 0.0, 0.2, 0.7])], "id int, p array<double>")
    got = {r.id: r for r in ms.top_class(df, ["id"], "p", F.floor(F.col("pos") / 2), [], 0.05, F.col("_g").cast("string")).collect()}
    assert (got[1].label, got[2].label, got[3].label) == ("0", "abstain", "1")
    assert got[1].margin == pytest.approx(0.2) and got[3].entropy == pytest.approx(-(0.1 * math.log(0.1) + 0.2 * math.log(0.2) + 0.7 * math.log(0.7)))
    masked = ms.top_class(df, ["id"], "p", F.floor(F.col("pos") / 2), [1], 0.05, F.col("_g").cast("string"))
    assert {r.label for r in masked.collect()} == {"0"}


def test_pooled_vectors_have_length_one(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [3.0, 0.0]), ("z", [0.0, 0.0])], "k string, v array<double>")
    got = {r.k: r.v for r in ms.pooled(df, ["k"], "v").collect()}
    assert got["a"] == pytest.approx([2 / math.sqrt(13), 0, 3 / math.sqrt(13), 0]) and got["z"] == [0.0] * 4


def test_interval_agreement_of_known_intervals(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 3.0), (1, "b", 0.5, 3.0), (2, "a", 1.0, 1.0), (2, "b", 1.0, 1.0), (3, "a", 0.0, 9.0)], "item int, rater string, a0 double, a1 double")
    r = one(ms.interval_agreement(df, "item", "rater", "a0", "a1"))
    assert (r.pairs, r.mean_iou, r.median_iou, r.start_error, r.middle_error) == (2, pytest.approx(11 / 12), pytest.approx(11 / 12), 0.25, 0.125)
    assert one(ms.interval_agreement(df.limit(0), "item", "rater", "a0", "a1")).pairs == 0


def test_diversity_and_headroom(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "a"), ("k", 1, "abstain"), ("k", 1, "b"), ("k", 2, "abstain")], "k string, unit int, label string")
    r = one(ms.diversity(df, ["k"]))
    assert (r.mean_all, r.mean_confident, r.least, r.most, r.abstain_rate) == (2.0, 1.0, 0, 2, 0.625)
    h = one(ms.headroom(spark.createDataFrame([("k", 0.95), ("k", 0.9), ("k", None)], "k string, a_ind double"), ["k"]))
    assert (h.pinned, h.open, h.unscorable, h["mean"]) == (1, 1, 1, pytest.approx(0.925))


def test_mark_errors(spark):
    df = spark.createDataFrame([("k", x) for x in (0.1, -0.2, 0.6, None)], "k string, e double")
    r = one(ms.mark_errors(df, ["k"], "e"))
    assert (r.coverage, r.mae, r.median_abs, r.adopt) == (0.75, pytest.approx(0.3), pytest.approx(0.2), True)
    assert r.bias == pytest.approx(1 / 6) and r.bin == pytest.approx(max(0.5, 2 * np.std([0.1, -0.2, 0.6])))


def test_reliability_names_what_is_low_or_undefined(spark):
    df = spark.createDataFrame([("x", 0.9, 0.9), ("y", 0.2, None)], "axis string, a double, b double")
    assert {r.axis: (r.reliable, r.reason) for r in ms.reliability_gate(df, {"a": 0.5, "b": 0.5}).collect()} == {"x": (True, ""), "y": (False, "a; b")}


def test_swapped_values(spark):
    df = spark.createDataFrame([("k", "d", "d", "s"), ("k", "s", "d", "s"), ("k", "q", "d", "s"), ("k", "c", "c", "c")], "k string, swapped string, donor string, source string")
    s = F.col("swapped")
    r = one(ms.follow_rates(df, ["k"], ms.matches(s, F.col("donor")), ms.matches(s, F.col("source"))))
    assert (r.follow_rate, r.retention_rate, r.neither_rate, r.n) == (0.5, 0.5, 0.25, 4)
    c = one(ms.corrected_rates(df, ["k"]))
    assert (c.collisions, c.strict_follow, c.strict_retain, c.follow_where_differ, c.floor) == (1, 0.25, 0.25, pytest.approx(1 / 3), 0.25)
    v = spark.createDataFrame([([1.0, 0.1], [1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [1.0, 0.0], [0.0, 1.0])], "x array<double>, a array<double>, b array<double>")
    assert [r.m for r in v.select(ms.vector_matches(F.col("x"), F.col("a"), F.col("b"), 0.9).alias("m")).collect()] == [True, False]


def test_trends_taxonomy_and_monotone_steps(spark):
    points = spark.createDataFrame([("k", x, y) for x, y in ((1.0, 0.0), (2.0, 1.0), (3.0, None), (4.0, 3.0))], "k string, x double, y double")
    r = one(ms.trend(points, ["k"], "x", "y"))
    assert (r.slope, r.delta, r.increasing) == (pytest.approx(1.0), 3.0, True)
    rows = [("k", u, s, f, 0.1, g) for u in range(30) for s, f, g in ((0.0, 0.5, 0.1), (0.5, 0.9, 0.8), (1.0, 0.7 + 0.001 * u, 0.6))]
    curves = spark.createDataFrame(rows, "axis string, unit int, s double, a_fork double, a_ind double, gain double")
    t = one(ms.taxonomy(curves, ["axis"]))
    assert (t.pinned, t.seed, t.early, t.mid, t.late, t.never) == (0, 30, 0, 30, 0, 0)
    steps = {r.s: r for r in ms.monotonicity(curves, ["axis"], "a_fork", n_boot=100).collect()}
    assert set(steps) == {0.5, 1.0} and not steps[0.5].violation and steps[1.0].violation and steps[1.0].mean_step == pytest.approx(-0.1855)
    e = one(ms.endpoint_controls(curves, ["axis"], "gain", 0.05, 0.95, 0.2, 0.5))
    assert (e.low, e.high, e.sane) == (pytest.approx(0.1), pytest.approx(0.6), True)


def test_rank_correlation_of_two_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r], [float(v) for v in 2 * r]) for i, r in enumerate(x)], "id int, a array<double>, b array<double>")
    r = one(kn.representation_similarity(df, "id", "a", "b"))
    assert (r.pairs, r.rho) == (66, pytest.approx(1.0))


@pytest.mark.parametrize("tile", [1024, 5])
def test_rank_correlation_equals_plain_ranks(spark, monkeypatch, tile):
    monkeypatch.setattr(kn, "TILE", tile)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(24, 3)), rng.normal(size=(24, 4))
    b[:, :3] += a
    df = spark.createDataFrame([(i % 2, i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(0, 99, None, [1.0] * 4)], "g int, id int, a array<double>, b array<double>")
    cos = lambda v, i, j: round(float(v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j])), 4)
    pairs = [(i, j) for i in range(24) for j in range(i + 1, 24) if i % 2 == j % 2]
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    want = np.corrcoef(*(rank(np.array([cos(v, i, j) for i, j in pairs])) for v in (a, b)))[0, 1]
    r = one(kn.representation_similarity(df, "id", "a", "b", ["g"]))
    assert (r.pairs, r.rho) == (len(pairs), pytest.approx(want, abs=1e-9))
    assert one(kn.representation_similarity(df.limit(0), "id", "a", "b")).rho is None


def test_status_accept_sets_and_settings(spark):
    s = spark.createDataFrame([(1, "OK"), (1, "FAIL"), (1, "ERR"), (2, "OK"), (3, None)], "shard int, token string")
    assert {r.shard: r.status for r in ms.status_merge(s, ["shard"], "token").collect()} == {1: "ERR", 2: "OK", 3: "MISSING"}
    rows = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "abstain"), ("e", "a")], "category string, label string")
    accept = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b")], "category string, label string")
    got = {r.category: (r.n, r.accuracy, r.confident_accuracy, r.passed) for r in ms.accept_accuracy(rows, accept, "category", "label", 0.6).collect()}
    assert got == {"c": (3, pytest.approx(2 / 3), 1.0, True), "e": (1, 0.0, 0.0, False)}
    settings = spark.createDataFrame([(0.1, 0.2, 0.9), (0.2, 0.6, 0.9), (0.3, 0.9, 0.9)], "alpha double, d double, v double")
    assert tuple(one(ms.smallest_setting(settings, "alpha", d=0.5, v=0.8))) == (0.2, "OK") and one(ms.smallest_setting(settings, "alpha", d=2.0)).token == "NONE"
    best = ms.best_per_step(spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", None)], "s int, n string, x double"), ["s"], "n", "x")
    assert [r.n for r in best.collect()] == ["a"]


def test_tables_against_ledgers_labels_and_lists(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, cfg string")
    ledger = spark.createDataFrame([(1, True), (2, False)], "k int, ok boolean")
    assert {r.k: r.reason for r in tb.certified(rows, ledger, ["k"]).collect()} == {1: "ratified", 2: "not_ok", 3: "not_in_ledger"}
    assert not one(tb.homogeneous(rows, ["cfg"])).homogeneous and one(tb.homogeneous(rows.where("k < 3"), ["cfg"])).homogeneous
    labelled = tb.with_labels(rows, spark.createDataFrame([(1, None)], "k int, label string"), ["k"])
    assert {r.k: r.status for r in labelled.collect()} == {1: "ok", 2: "label_missing", 3: "label_missing"}
    tasks = [spark.createDataFrame([(1, "b"), (9, "b")], "k int, task string"), spark.createDataFrame([(1, "a"), (2, "a")], "k int, task string")]
    got = {r.k: (r.tasks, r.reason) for r in tb.preflight(tasks, rows, "k", {"first": F.col("k") == 2, "second": F.col("cfg") == "x"}).collect()}
    assert got == {1: ("a+b", "second"), 2: ("a", "first"), 9: ("b", "index_join_missing")}
    assert {r.k for r in tb.eligible(rows, F.col("cfg") == "x", rows.where("k = 2"), ["k"]).collect()} == {1}
    cat = spark.createDataFrame([(1, "e1", True), (1, "e1", False), (2, "e2", True)], "u int, e string, a boolean")
    assert {r.u: (r.events, r.anchors, r.unique_ids, r.declared_ok) for r in tb.event_catalog(cat, "u", "e", F.col("a"), F.col("a"), 2).collect()} == {1: (2, 1, False, True), 2: (1, 1, True, False)}


def test_grid_and_nearest_events(spark):
    found = tb.grid_lookups(F.col("x"), [1, 3, 9])
    got = {r.x: (r.n, r.nx, r.p) for r in spark.createDataFrame([(0.5,), (2.0,), (3.0,), (10.0,)], "x double").select("x", found["nearest"].alias("n"), found["next"].alias("nx"), found["previous"].alias("p")).collect()}
    assert got == {0.5: (1, 1, None), 2.0: (1, 3, 1), 3.0: (3, 3, 1), 10.0: (9, None, 9)}
    e = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate([(0, "v"), (5, "p"), (7, "v"), (20, "p")])] + [(2, 9, 3, "v")], "u int, i int, t long, k string")
    assert {r.i: r.gap for r in tb.nearest_event(e, "u", "i", "t", F.col("k") == "v", F.col("k") == "p").collect()} == {0: 5, 2: 2, 9: None}


def test_projection_tail_and_blind_ids_equal_plain_ones(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, v array<double>")
    matrix = np.random.default_rng(4).normal(0, 1 / np.sqrt(2), (3, 2))
    assert one(pr.gaussian_projection(df, "v", 3, 2, 4)).projected == pytest.approx(list(np.array([1.0, 2.0, 3.0]) @ matrix))
    z = spark.createDataFrame([(0.0,), (1.6448536269514722,), (None,)], "z double")
    assert [r.p for r in z.select(nf.normal_tail(F.col("z")).alias("p")).collect()] == [0.5, pytest.approx(0.05), None]
    ids = spark.createDataFrame([("a/b",), (None,)], "k string").select(exprs.blind_id(b"study")(F.col("k")).alias("b")).collect()
    assert [r.b for r in ids] == [hmac.new(b"study", b"a/b", "sha256").hexdigest()[:12], None]
