"""Quality classifier: Bradley-Terry scores from preference pairs, threshold by score quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold, written

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
SPACE = b" \t\n\r\x0b\x0c"
STOPS = b".,;:?'\"-()"
HIGH = bytes(range(128, 256))
N_FEATURES = 18
SLICE = 256  # texts turned into features at once


def text_features(text: str | None) -> list[float]:
    """Numbers that describe form, not topic: character classes, repetition of words, pairs and lines, lengths."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]

    def share(kind: bytes) -> float:
        return 1 - len(raw.translate(None, kind)) / n

    upper, lower, digit, space, stops, high = map(share, (UPPER, LOWER, DIGIT, SPACE, STOPS, HIGH))
    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    follows = sum(map(bytes.__eq__, words, words[1:]))
    lengths = list(map(len, words))
    return [
        upper, digit, space, stops, high, max(0.0, 1 - upper - lower - digit - space - stops - high),
        len(counts) / k, max(counts.values(), default=0) / k, len(pairs) / max(1, k - 1), follows / k,
        1 - len(set(lines)) / m, math.log1p(k), math.log1p(k / m), math.log1p(n / k), math.log1p(max(lengths, default=0)),
        raw.count(b".") / k, math.log(k) * (1 - len(counts) / k), 0.0,  # last: 1 for an empty text
    ]


class Ranker:
    """Linear Bradley-Terry strengths on standardised features and their squares; probability through a quantile."""

    def __init__(self, mean, scale, weights, cut, slope):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut), -500, 500)))


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs_each: int = 24, l2: float = 1e-3, steps: int = 40, seed: int = 7) -> Ranker:
    """Fit on (preferred, other) pairs: each row of the rarer class meets ``pairs_each`` rows of the other class.

    Loss: mean log(1 + exp(-w.(f(preferred) - f(other)))) + l2 |w|^2, by Newton steps. The threshold is the
    quantile of the training strengths at the share of rows labelled 0, so a score of 0.5 is that quantile.
    With one class only, every weight is 0 and the score is that class's side of 0.5.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    ranker = Ranker(mean, scale, np.zeros(2 * N_FEATURES), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        ranker.cut = -1.0 if len(good) or not len(bad) else 1.0
        return ranker
    f = ranker.expand(x)
    rng = np.random.default_rng(seed)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    a = np.repeat(few, pairs_each)
    b = rng.choice(many, len(a))
    diff = f[b] - f[a] if few is bad else f[a] - f[b]
    w = np.zeros(f.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        grad = -(diff * p[:, None]).mean(0) + 2 * l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 2 * l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    ranker.weights = w
    s = f @ w
    ranker.cut = float(np.quantile(s, len(bad) / len(y)))
    return ranker


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, max_train: int = 4000):
    """The ranker as a function of a text column."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )
    known = docs.sparkSession.createDataFrame([tuple(r) for r in known.collect()], "_id long, _y int")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    sample = bounded_rows(written(texts.withColumn("_h", F.xxhash64("_text"))), max_train)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), SLICE):
                part = pdf.iloc[i : i + SLICE]
                yield pd.DataFrame({"_y": part["_y"], "f": [text_features(t) for t in part["_text"]]})

    rows = sample.mapInPandas(featured, "_y int, f array<double>").collect()
    rows = sorted((r["_y"], *r["f"]) for r in rows)
    x = np.array([r[1:] for r in rows]).reshape(-1, N_FEATURES)
    ranker = fit_ranker(x, np.array([r[0] for r in rows]))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = (texts.iloc[i : i + SLICE] for i in range(0, len(texts), SLICE))
        got = [ranker.score(np.array([text_features(t) for t in part]).reshape(-1, N_FEATURES)) for part in parts]
        return pd.Series(np.concatenate(got) if got else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, **params) -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``, from whole texts alone.

    Learns from at most ``max_train`` labelled rows outside fold ``held`` (those whose id hashes lowest; of repeated
    labels the least counts, rows that repeat id and text count once, and the bound holds for rows, however many bear one
    id); features of these rows go to the driver. Null text counts as empty,
    labels other than 0 and 1 are ignored, repeated rows are scored alike, ids that hash alike are ordered by
    id, an empty label table scores every row above 0.5, an empty table of documents gives an empty result.
    Other columns are not read.
    """
    score = fitted(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held=held, **params)
    return docs.select(
        F.col(id_col), (fold(id_col, folds) == held).alias("held_out"), score(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows whose own text scores under 0.5; all columns stay, rows without an id are scored like others."""
    score = fitted(docs, labels, id_col=id_col, text_col=text_col, **params)
    return docs.where(score(F.col(text_col)) >= 0.5)
