"""Probes of what vectors tell about labels: ridge from summed Gram blocks, a hidden layer trained on gradient sums, projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .resampling import SAMPLE, mean, replicate_sums

MODEL_BYTES = 64 << 20  # weights that go to the tasks at a time


def _stack(series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in series])


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def ridge_predictions(df: DataFrame, vector: str, label: str, train: str, classes: list, lam: float = 1.0, keys: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows held out (where ``train`` does not hold): keys, columns ``keep``, label, predicted.

    One-vs-all ridge on standardised features. Tasks send sums (d x d and d x classes) per key, never rows; the solve is
    one small group per key. Rows with a null label or vector take no part. With one class in training all is that class.
    """
    keys, keep, ks = keys or [], keep or [], len(classes)
    by = keys or ["_one"]
    used = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).withColumn("_train", F.expr(train))
    used = used if keys else used.withColumn("_one", F.lit(0))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                x = _stack(part[vector])
                x1 = np.hstack([x, np.ones((len(x), 1))])
                y = (part[label].to_numpy()[:, None] == np.array(classes)[None, :]).astype(np.float64)
                g, h = held.get(key, (0, 0))
                held[key] = g + x1.T @ x1, h + x1.T @ y
        yield pd.DataFrame([(*key, g.ravel().tolist(), h.ravel().tolist()) for key, (g, h) in held.items()], columns=[*by, "g", "h"])

    blocks = used.where("_train").select(*by, vector, label).mapInPandas(gram, f"{_kinds(used, by)}g array<double>, h array<double>")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.asarray(v) for v in pdf["g"]], axis=0)
        h = np.sum([np.asarray(v) for v in pdf["h"]], axis=0)
        d = int(round(len(g) ** 0.5)) - 1
        g, h = g.reshape(d + 1, d + 1), h.reshape(d + 1, ks)
        n, center = g[d, d], g[d, :d] / g[d, d]
        std = np.sqrt(np.maximum(np.diag(g)[:d] / n - center**2, 0)) + 1e-12
        z = (g[:d, :d] - n * np.outer(center, center)) / np.outer(std, std)
        zy = (h[:d] - np.outer(center, h[d])) / std[:, None]
        weights = np.linalg.solve(z + lam * np.eye(d), zy) / std[:, None]
        out = pdf[by].head(1).copy()
        out["w"], out["b"] = [weights.ravel().tolist()], [(h[d] / n - center @ weights).tolist()]
        return out

    solved = written(blocks.groupBy(*by).applyInPandas(solve, f"{_kinds(used, by)}w array<double>, b array<double>"))

    @F.pandas_udf("int")
    def best(x: pd.Series, w: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int((np.asarray(xi) @ np.asarray(wi).reshape(len(xi), ks) + np.asarray(bi)).argmax()) for xi, wi, bi in zip(x, w, b, strict=True)])

    names = F.array(*map(F.lit, classes))
    scored = used.where("not _train").join(solved, by)
    return scored.select(*keys, *keep, label, F.get(names, best(vector, "w", "b")).alias("predicted"))


def right(label: str) -> Column:
    return F.coalesce((F.col("predicted") == F.col(label)).cast("int"), F.lit(0))


def ridge_probe(df: DataFrame, vector: str, label: str, train: str, classes: list, lam: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """keys, accuracy, n of ``ridge_predictions``."""
    got = ridge_predictions(df, vector, label, train, classes, lam, keys)
    return got.groupBy(*(keys or [])).agg(F.avg(right(label)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def gaussian_projection(df: DataFrame, vector: str, d_in: int, d_out: int, seed: int) -> DataFrame:
    """Add ``projected``: the vector times a fixed N(0, 1 / d_out) matrix of d_in x d_out, sent with the job."""
    matrix = np.random.default_rng(seed).normal(0, 1 / np.sqrt(d_out), (d_in, d_out))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(_stack(x) @ matrix))

    return df.withColumn("projected", project(vector))


class Layers:
    """One hidden layer with ReLU and a softmax, its Adam state, and the best weights by validation accuracy."""

    def __init__(self, d: int, hidden: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.shapes = [(d, hidden), (hidden,), (hidden, classes), (classes,)]
        bound = [np.sqrt(6 / (d + hidden)), 0, np.sqrt(6 / (hidden + classes)), 0]
        self.w = np.concatenate([rng.uniform(-b, b, s).ravel() if b else np.zeros(s) for s, b in zip(self.shapes, bound, strict=True)])
        self.decayed = np.concatenate([np.full(int(np.prod(s)), float(len(s) == 2)) for s in self.shapes])
        self.m, self.v, self.t = np.zeros_like(self.w), np.zeros_like(self.w), 0
        self.best, self.best_accuracy, self.waited = self.w, -1.0, 0

    def step(self, gradient: np.ndarray, rows: float, decay: float, rate: float) -> None:
        g = gradient / rows + decay * self.decayed * self.w / rows
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w = self.w - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)

    def judged(self, accuracy: float, least: float = 1e-4) -> None:
        """Take note of the accuracy that the present weights have on validation rows."""
        if accuracy > self.best_accuracy + least:
            self.best, self.best_accuracy, self.waited = self.w, accuracy, 0
        else:
            self.waited += 1


def unpacked(w: np.ndarray, shapes) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [part.reshape(s) for part, s in zip(np.split(w, ends[:-1]), shapes, strict=True)]


def forward(x: np.ndarray, w: np.ndarray, shapes) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = unpacked(w, shapes)
    hidden = np.maximum(x @ w1 + b1, 0)
    z = hidden @ w2 + b2
    e = np.exp(z - z.max(1, keepdims=True))
    return hidden, e / e.sum(1, keepdims=True)


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, shapes) -> np.ndarray:
    """Sum over rows of the gradient of the cross-entropy."""
    hidden, p = forward(x, w, shapes)
    dz = p.copy()
    dz[np.arange(len(y)), y] -= 1
    dh = (dz @ unpacked(w, shapes)[2].T) * (hidden > 0)
    return np.concatenate([(x.T @ dh).ravel(), dh.sum(0), (hidden.T @ dz).ravel(), dz.sum(0)])


def mlp_predictions(df: DataFrame, vector: str, label: str, train: str, classes: list, keys: list[str] | None = None, keep: list[str] | None = None, hidden: int = 256, decay: float = 1e-3, epochs: int = 300, validation: float = 0.2, patience: int = 15, rate: float = 1e-2, seed: int = 0) -> DataFrame:
    """Held-out rows as ``ridge_predictions``, by a network with one hidden layer, L2 decay, early stopping and restored best weights.

    Features are standardised on the training rows. An epoch is one job: tasks add up gradients of their training rows
    and count right answers on their validation rows (chosen by a hash of the row), for all keys at once; the driver
    steps on the sums. So the result does not depend on how rows are dealt. Keys stop each on their own after
    ``patience`` epochs without a better validation accuracy. Weights travel in batches of keys of MODEL_BYTES at most.
    """
    keys, keep = keys or [], keep or []
    by = keys or ["_one"]
    used = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).withColumn("_train", F.expr(train))
    used = (used if keys else used.withColumn("_one", F.lit(0))).withColumn("_y", F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1)
    share = F.pmod(F.xxhash64(vector, label), F.lit(1000)) < int(1000 * validation)
    rows = written(used.withColumn("_val", F.col("_train") & share).select(*dict.fromkeys([*by, *keep, label]), "_train", "_val", F.col("_y").cast("int").alias("_y"), F.col(vector).cast("array<double>").alias("_x")))
    learn = rows.where("_train and _y >= 0")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                x = _stack(part["_x"])
                old = held.get(key, (0, 0, 0))
                held[key] = old[0] + len(x), old[1] + x.sum(0), old[2] + (x * x).sum(0)
        yield pd.DataFrame([(*k, float(n), a.tolist(), b.tolist()) for k, (n, a, b) in held.items()], columns=[*by, "n", "a", "b"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.head(1).copy()
        for c in pdf.columns:
            if c not in by:
                total = np.sum([np.asarray(v) for v in pdf[c]], axis=0)
                out[c] = [total.tolist()] if isinstance(total, np.ndarray) else [total]
        return out

    kinds = _kinds(rows, by)
    sums = learn.select(*by, "_x").mapInPandas(moments, f"{kinds}n double, a array<double>, b array<double>").groupBy(*by).applyInPandas(added, f"{kinds}n double, a array<double>, b array<double>")
    scales = {}
    for r in sums.collect():
        center = np.array(r["a"]) / r["n"]
        spread = np.sqrt(np.maximum(np.array(r["b"]) / r["n"] - center**2, 0))
        scales[tuple(r[k] for k in by)] = center, np.where(spread > 1e-12, spread, 1.0)
    parts = []
    order = sorted(scales, key=str)
    size = 8 * max((len(c) * hidden + hidden * len(classes) for c, _ in scales.values()), default=1)
    at_once = max(1, MODEL_BYTES // size)
    for first in range(0, len(order), at_once):
        models = {k: Layers(len(scales[k][0]), hidden, len(classes), seed) for k in order[first : first + at_once]}
        open_ = dict(models)
        for _ in range(epochs):
            sent = df.sparkSession.sparkContext.broadcast({k: (m.w, m.shapes, *scales[k]) for k, m in open_.items()})
            made = learn.mapInPandas(_epoch(by, sent), f"{kinds}g array<double>, n double, good double, seen double")
            for r in made.groupBy(*by).applyInPandas(added, f"{kinds}g array<double>, n double, good double, seen double").collect():
                m = open_[tuple(r[k] for k in by)]
                m.judged(r["good"] / r["seen"] if r["seen"] else 0.0)
                m.step(np.array(r["g"]), max(r["n"], 1.0), decay, rate)
            sent.unpersist()
            open_ = {k: m for k, m in open_.items() if m.waited < patience}
            if not open_:
                break
        final = df.sparkSession.sparkContext.broadcast({k: (m.best, m.shapes, *scales[k]) for k, m in models.items()})
        names = [*dict.fromkeys([*by, *keep, label])]
        parts.append(rows.where("not _train").mapInPandas(_scored(by, names, final), f"{_kinds(rows, names)}_p int"))
    if not parts:
        return rows.where("false").select(*keys, *keep, label, F.lit(None).cast(rows.schema[label].dataType).alias("predicted"))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored.select(*keys, *keep, label, F.get(F.array(*map(F.lit, classes)), F.col("_p")).alias("predicted"))


def _epoch(by: list[str], sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, held = sent.value, {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                if key not in models:
                    continue
                w, shapes, center, spread = models[key]
                x, y, val = (_stack(part["_x"]) - center) / spread, part["_y"].to_numpy(), part["_val"].to_numpy()
                good = int((forward(x[val], w, shapes)[1].argmax(1) == y[val]).sum()) if val.any() else 0
                g = gradient(x[~val], y[~val], w, shapes) if (~val).any() else np.zeros_like(w)
                old = held.get(key, (0, 0.0, 0.0, 0.0))
                held[key] = old[0] + g, old[1] + float((~val).sum()), old[2] + good, old[3] + float(val.sum())
        yield pd.DataFrame([(*k, v[0].tolist(), *v[1:]) for k, v in held.items()], columns=[*by, "g", "n", "good", "seen"])

    return run


def _scored(by: list[str], names: list[str], sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = sent.value
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                if key in models:
                    w, shapes, center, spread = models[key]
                    out = part[names].copy()
                    out["_p"] = forward((_stack(part["_x"]) - center) / spread, w, shapes)[1].argmax(1).astype("i4")
                    yield out

    return run


def probe_report(predictions: DataFrame, training: DataFrame, label: str, keys: list[str], unit: str, n_boot: int = 1000, seed: str = "probe") -> DataFrame:
    """keys, accuracy, chance, delta, ci_low, ci_high, n_eval, units: a probe's accuracy on held-out rows with its interval over units.

    chance: what the commonest training label (ties by text) gets on the same rows. A resampled unit brings all its rows.
    """
    counts = training.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    common = counts.groupBy(*keys).agg(F.min_by("_l", F.struct(-F.col("_n"), F.col("_l").cast("string"))).alias("_common"))
    rows = predictions.join(common, keys) if keys else predictions.join(common)
    per = rows.select(*keys, unit, right(label).alias("_right"), (F.col(label) == F.col("_common")).cast("int").alias("_chance"))
    sums = replicate_sums(per, keys, [unit], ["_right", "_chance"], n_boot, seed)
    own = lambda c: F.max(F.when(F.col("b") == SAMPLE, c))
    drawn = F.when(F.col("b") != SAMPLE, mean("_right"))
    got = sums.groupBy(*keys).agg(own(mean("_right")).alias("accuracy"), own(mean("_chance")).alias("chance"), F.percentile(drawn, F.lit(0.025)).alias("ci_low"), F.percentile(drawn, F.lit(0.975)).alias("ci_high"), own(F.col("n")).cast("long").alias("n_eval"))
    units = per.groupBy(*keys).agg(F.count_distinct(unit).alias("units"))
    out = got.join(units, keys) if keys else got.join(units)
    return out.select(*keys, "accuracy", "chance", (F.col("accuracy") - F.col("chance")).alias("delta"), "ci_low", "ci_high", "n_eval", "units")


def probe_sweep(df: DataFrame, vector: str, label: str, train: str, classes: list, step: str = "s", layer: str = "layer", families: tuple[str, ...] = ("ridge", "mlp"), **mlp) -> DataFrame:
    """family, step, layer, accuracy, chance, best: every probe family on every layer and step of one frozen split.

    chance is the commonest held-out label's share; ``best`` marks the highest accuracy of a step (ties: ridge, then the lower layer).
    """
    keys, parts = [step, layer], []
    for family in families:
        got = ridge_predictions(df, vector, label, train, classes, keys=keys) if family == "ridge" else mlp_predictions(df, vector, label, train, classes, keys, **mlp)
        parts.append(got.withColumn("family", F.lit(family)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    accuracy = rows.groupBy("family", step, layer).agg(F.avg(right(label)).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    held = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.expr(train)).groupBy(step, layer, label).agg(F.count(F.lit(1)).alias("_n"))
    chance = held.groupBy(step, layer).agg((F.max("_n") / F.sum("_n")).alias("chance"))
    first = F.row_number().over(Window.partitionBy(step).orderBy(F.desc("accuracy"), F.desc(F.col("family") == "ridge"), layer))
    return accuracy.join(chance, keys).withColumn("best", first == 1).select("family", step, layer, "accuracy", "chance", "n", "best")


def first_readable(sweep: DataFrame, step: str = "s", theta: float = 0.7, margin: float = 0.15) -> DataFrame:
    """s_read: the first step whose best accuracy reaches ``theta`` and chance plus ``margin``; null if none does."""
    ok = F.col("best") & (F.col("accuracy") >= theta) & (F.col("accuracy") >= F.col("chance") + margin)
    return sweep.agg(F.min(F.when(ok, F.col(step))).alias("s_read"))
