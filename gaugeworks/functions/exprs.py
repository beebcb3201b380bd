"""Column expressions: gains, shares, intervals, evidence rules, vectors, ids. No function here starts a job."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def gain(a_fork: Column, a_ind: Column, on_saturated: str = "zero") -> Column:
    """(f - i) / (1 - i) in [0, 1]; where the baseline is 1: zero or null. Null stays null."""
    saturated = F.lit(0.0) if on_saturated == "zero" else F.lit(None).cast("double")
    return F.when(a_ind >= 1 - EPS, saturated).otherwise(clip01((a_fork - a_ind) / (1 - a_ind)))


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of closed intervals; both of length 0: 1 if they start alike, else 0."""
    union = F.greatest(a1, b1) - F.least(a0, b0)
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    joined = (a1 - a0) + (b1 - b0) - shared
    return F.when(joined <= 0, (a0 == b0).cast("double")).when(union.isNotNull(), shared / joined)


def timing_offset(presence: Column, anchor0: Column, anchor1: Column, onset0: Column, onset1: Column) -> Column:
    """struct(value, low, high, reason): offset of interval centres with its bounds, defined for present events only."""
    value = (onset0 + onset1) / 2 - (anchor0 + anchor1) / 2
    reason = F.when(presence != "present", F.concat(F.lit("presence_"), presence)).when(onset0.isNull() | onset1.isNull(), "onset_unknown").otherwise("ok")
    ok = reason == "ok"
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, onset0 - anchor1).alias("low"), F.when(ok, onset1 - anchor0).alias("high"), reason.alias("reason"))


def presence_state(target: Column, confident: Column, background: Column) -> Column:
    """present, absent or uncertain from nullable evidence; background alone never proves presence."""
    sure = F.coalesce(confident, F.lit(False))
    return F.when(~sure | target.isNull(), "uncertain").when(target, "present").otherwise("absent")


def two_choice(positive: Column, negative: Column, margin: float) -> Column:
    """Which of two similarities wins; indifferent within the margin, null if either is undefined."""
    return F.when(F.abs(positive - negative) <= margin, "indifferent").when(positive > negative, "positive").when(positive < negative, "negative")


def time_bin(t: Column, width: float, n: int) -> Column:
    """Bin number as text, the last bin open-ended; 'none' without an event."""
    return F.when(t.isNull(), "none").otherwise(F.least(F.floor(t / width), F.lit(n - 1)).cast("string"))


def keyword_class(text: Column, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first class one of whose substrings occurs in the lower-cased text."""
    low = F.lower(text)
    hits = [F.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), name) for name, words in rules]
    return F.coalesce(*hits, F.lit(other))


def judge_json(text: Column, schema: str) -> Column:
    """The JSON object in a reply: without a code fence, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).when(bare != "", bare), schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if a norm is 0 or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).when(norms.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def root_probabilities(a: Column) -> Column:
    """A vector's squares as shares of their sum, and the root of each share; null for a zero vector."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return F.get(F.transform(F.array(total), lambda t: F.when(t > 0, F.transform(a, lambda x: F.sqrt(x * x / t)))), F.lit(0))  # the sum is taken once, not per component


def safe_id(text: Column) -> Column:
    return F.translate(text, "/:", "__")


def rater_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def blind_id(secret: bytes, length: int = 12):
    """A keyed id: the first hex digits of HMAC-SHA256, as a vectorised function of a text column."""

    @F.pandas_udf("string")
    def blind(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else hmac.new(secret, k.encode(), hashlib.sha256).hexdigest()[:length])

    return blind


def natural_order(key: Column) -> list[Column]:
    """Sort columns: numeric keys first by number, then the others as text."""
    number = key.try_cast("long")
    return [number.isNull(), number, key]


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid, half, scale = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return (F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale))


def draw(seed: str, *parts) -> Column:
    """An unsigned 32-bit integer that seed and parts decide: the same in any engine that has md5."""
    key = F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
