"""Probes against numpy: ridge in closed form, the hidden layer's gradient and what it can and cannot learn, intervals over units."""

import numpy as np
import pytest

from gaugeworks.operators import probes as pr


def ring(n=600, seed=0):
    """Two classes that no plane parts: inside and outside a circle."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (np.linalg.norm(x, axis=1) > 1.17).astype(int)
    return x, y


def table(spark, x, y, key=0):
    return spark.createDataFrame([(key, i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))], "k int, id int, label int, v array<double>")


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [1, 5, 0.2, 1, 3] + 2
    y = (x[:, 0] + x[:, 3] > 4).astype(int) + (x[:, 1] > 4)
    train = np.arange(200) % 3 > 0
    got = {r.id: r.predicted for r in pr.ridge_predictions(table(spark, x, y).repartition(4), "v", "label", "id % 3 > 0", [0, 1, 2], 0.7, keep=["id"]).collect()}
    mu, sd = x[train].mean(0), x[train].std(0)
    z, onehot = (x - mu) / sd, np.eye(3)[y]
    w = np.linalg.solve(z[train].T @ z[train] + 0.7 * np.eye(5), z[train].T @ (onehot[train] - onehot[train].mean(0)))
    want = (z @ w + onehot[train].mean(0)).argmax(1)
    assert got == {i: want[i] for i in range(200) if not train[i]}


def test_ridge_of_one_class_and_null_labels(spark):
    df = spark.createDataFrame([(i, None if i == 4 else 1, [float(i)]) for i in range(9)], "id int, label int, v array<double>")
    got = pr.ridge_probe(df, "v", "label", "id < 5", [0, 1]).first()
    assert (got.accuracy, got.n) == (1.0, 4)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    net = pr.Layers(3, 4, 3, 5)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 3, 7)
    loss = lambda w: -np.log(pr.forward(x, w, net.shapes)[1][np.arange(7), y]).sum()
    g = pr.gradient(x, y, net.w, net.shapes)
    for i in rng.choice(len(net.w), 12, replace=False):
        e = np.zeros_like(net.w)
        e[i] = 1e-6
        assert g[i] == pytest.approx((loss(net.w + e) - loss(net.w - e)) / 2e-6, abs=1e-4)


def test_hidden_layer_learns_what_ridge_cannot_and_nothing_from_noise(spark):
    x, y = ring()
    noise = np.random.default_rng(9).integers(0, 2, len(y))
    df = table(spark, x, y, 0).unionByName(table(spark, x, noise, 1)).repartition(3)
    got = pr.mlp_predictions(df, "v", "label", "id % 2 = 0", [0, 1], ["k"], epochs=60, rate=0.02)
    acc = {r.k: r.a for r in got.groupBy("k").agg(pr.F.avg(pr.right("label")).alias("a")).collect()}
    ridge = {r.k: r.accuracy for r in pr.ridge_probe(df, "v", "label", "id % 2 = 0", [0, 1], keys=["k"]).collect()}
    assert acc[0] > 0.9 > 0.65 > ridge[0]
    assert abs(acc[1] - 0.5) < 0.1


def test_hidden_layer_does_not_depend_on_how_rows_are_dealt(spark):
    x, y = ring(200, 3)
    df = table(spark, x, y)
    a, b = ({r.id: r.predicted for r in pr.mlp_predictions(df.repartition(n), "v", "label", "id % 2 = 0", [0, 1], keep=["id"], hidden=16, epochs=8).collect()} for n in (1, 5))
    assert a == b and len(a) == 100


def test_best_weights_are_restored_and_waiting_ends():
    net = pr.Layers(2, 3, 2, 0)
    first = net.w
    for accuracy in (0.8, 0.7, 0.8, 0.6):
        net.judged(accuracy)
        net.step(np.ones_like(net.w), 1, 0.0, 0.1)
    assert (net.best == first).all() and net.best_accuracy == 0.8 and net.waited == 3


def test_report_of_known_rows(spark):
    rows = [("a", u, 1, 1 if u % 2 else 0) for u in range(40) for _ in range(3)]
    predictions = spark.createDataFrame(rows, "k string, unit int, label int, predicted int")
    training = spark.createDataFrame([("a", 0)] * 5 + [("a", 1)] * 6, "k string, label int")
    r = pr.probe_report(predictions, training, "label", ["k"], "unit", 500).first()
    assert (r.accuracy, r.chance, r.delta, r.n_eval, r.units) == (0.5, 1.0, -0.5, 120, 40)
    assert r.ci_high - r.ci_low == pytest.approx(2 * 1.96 * 0.5 / 40**0.5, rel=0.15)  # 40 units, not 120 rows


def test_sweep_marks_the_best_and_the_first_readable_step(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        t = i % 2
        for s in (0.1, 0.5, 0.9):
            for layer in (0, 1):
                clear = 3.0 if s >= 0.5 and layer == 1 else 0.0
                rows.append((i, t, s, layer, [float(rng.normal() + clear * t), float(rng.normal())]))
    df = spark.createDataFrame(rows, "id int, label int, s double, layer int, x array<double>")
    sweep = pr.probe_sweep(df, "x", "label", "id % 3 > 0", [0, 1], families=("ridge",))
    best = {r.s: r for r in sweep.where("best").collect()}
    assert best[0.5].layer == best[0.9].layer == 1 and best[0.5].accuracy > 0.85 > 0.65 > best[0.1].accuracy and best[0.1].chance == 0.5
    assert pr.first_readable(sweep).first().s_read == 0.5 and pr.first_readable(sweep, theta=1.1).first().s_read is None
