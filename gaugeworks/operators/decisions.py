"""Verdict tables: which tokens a set of windows or conditions earns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import non_overlap, separation

# Fixed values of the decision rules.
COINCIDE = 0.05
NEAR_END = 0.85
READ_CEILING = 0.8
READ_LEAD, READ_LAG = -0.05, 0.15
LEAST_SEPARATION = 1.0
RESTRICTED = ("presence", "timing", "gross", "onset")


def tokens(*cases: tuple[str | Column, Column]) -> Column:
    """Array of the tokens whose condition holds, in the order given, each once; an unknown condition doesn't hold."""
    each = [F.when(F.coalesce(on, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for name, on in cases]
    return F.array_distinct(F.array_compact(F.array(*each)))


def feasibility(conditions: DataFrame, reliability: DataFrame, keys: list[str], least_axes: int = 3) -> DataFrame:
    """keys, tokens, reliable: GO_MAPS_PHASE, or every reason against it.

    ``conditions`` has keys, trajectory_ok, validation_token, manifest_ok, one row per key; ``reliability`` has keys, axis,
    passed. A null condition counts as failed (a null token as UNVALIDATED); a key without axes has none that are reliable.
    """
    n = reliability.groupBy(*keys).agg(F.count_if(F.col("passed")).alias("reliable"))
    both = conditions.join(n, keys, "left").withColumn("reliable", F.coalesce("reliable", F.lit(0)))
    given = F.coalesce("validation_token", F.lit("UNVALIDATED"))
    against = tokens(
        ("NO_TRAJECTORY_ACCESS", ~F.coalesce("trajectory_ok", F.lit(False))),
        (given, given != "OK"),
        ("STOP_PROJECT", ~F.coalesce("manifest_ok", F.lit(False)) | (F.col("reliable") < least_axes)),
    )
    return both.withColumn("tokens", F.when(F.size(against) == 0, F.array(F.lit("GO_MAPS_PHASE"))).otherwise(against)).select(*keys, "tokens", "reliable")


def map_decision(commit: DataFrame, read: DataFrame, keys: list[str], alpha_ok: bool = True, restricted: tuple[str, ...] = RESTRICTED) -> DataFrame:
    """keys, tokens, separation: every token that the windows of a key earn.

    ``commit`` has keys, axis, s_hat, ci_low, ci_high, underpowered, one row per axis; ``read`` has keys, axis, probe,
    target, s_hat, underpowered. Only results count: windows with an s_hat that are not underpowered. Axes whose name
    holds one of ``restricted`` license a restricted policy only. Both tables are small (axes by settings by probes).
    """
    result = F.col("s_hat").isNotNull() & ~F.col("underpowered")
    done = commit.where(result)
    early = F.col("s_hat") < NEAR_END
    lag = F.col("r_hat") - F.col("s_hat")
    pairs = read.where(result).withColumnRenamed("s_hat", "r_hat").drop("underpowered").join(done.select(*keys, "axis", "s_hat"), [*keys, "axis"])
    reads = pairs.groupBy(*keys, "axis").agg(
        F.bool_or(early & (F.col("r_hat") < READ_CEILING) & lag.between(READ_LEAD, READ_LAG)).alias("readable"),
        F.bool_or(lag > READ_LAG).alias("lagging"),
    )
    limited = F.lit(False)
    for part in restricted:
        limited = limited | F.lower("axis").contains(part)
    axes = done.join(reads, [*keys, "axis"], "left")
    facts = axes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("s_hat") - F.min("s_hat")).alias("spread"),
        (F.min("s_hat") >= NEAR_END).alias("near_end"),
        F.bool_or("readable").alias("readout"),
        F.bool_or(F.col("readable") & limited).alias("limited_read"),
        F.bool_or(early & ~limited).alias("other_early"),
        F.bool_or(F.coalesce("lagging", early)).alias("lags"),  # no read window at all: an early axis lags
    )
    facts = facts.join(separation(done, keys), keys).join(non_overlap(done, keys), keys)
    every = commit.select(*keys).distinct().join(facts, keys, "left")
    flat = (F.col("spread") <= COINCIDE) | F.col("near_end")
    found = tokens(
        ("FORK_ALPHA_NO_VALID_OPERATING_POINT", F.lit(not alpha_ok)),
        ("STOP_PROJECT", F.col("n").isNull()),
        ("STOP_ADSR", flat),
        ("GO_MAP", (F.col("n") >= 2) & ~flat & F.col("ordered") & (F.col("separation") > LEAST_SEPARATION)),
        ("GO_READOUT", F.col("readout")),
        ("GO_RESTRICTED", F.col("limited_read") & ~F.col("other_early")),
        ("GO_DIAGNOSTIC", F.col("lags")),
    )
    return every.select(*keys, F.when(F.size(found) == 0, F.array(F.lit("STOP_PROJECT"))).otherwise(found).alias("tokens"), "separation")


def trend_verdict(points: DataFrame, keys: list[str], quantity: str, x: str, y: str, expected: int = 3, eps: float = 1e-3) -> DataFrame:
    """keys, verdict, rising, falling: supported if all ``expected`` quantities rise with x, refuted if any falls, else inconclusive.

    A quantity rises (falls) if its least-squares slope lies beyond eps and its last value above (below) its first;
    null and NaN points are left out, and fewer than two points show no trend.
    """
    finite = ~F.isnan(F.coalesce(F.col(y), F.lit(float("nan"))))
    trend = points.groupBy(*keys, quantity).agg(
        F.regr_slope(F.when(finite, F.col(y)), x).alias("slope"),
        (F.max_by(y, F.when(finite, F.col(x))) - F.min_by(y, F.when(finite, F.col(x)))).alias("delta"),
    )
    rising = F.count_if((F.col("slope") > eps) & (F.col("delta") > 0))
    falling = F.count_if((F.col("slope") < -eps) & (F.col("delta") < 0))
    got = trend.groupBy(*keys).agg(rising.alias("rising"), falling.alias("falling"))
    verdict = F.when(F.col("rising") >= expected, "F1_SUPPORTED").when(F.col("falling") > 0, "F1_REFUTED").otherwise("F1_INCONCLUSIVE")
    return got.select(*keys, verdict.alias("verdict"), "rising", "falling")


def bridge_token(mean_recovery: Column) -> Column:
    """Tier of a mean headroom recovery."""
    return F.when(mean_recovery >= 0.5, "BRIDGE_METHOD").when(mean_recovery >= 0.2, "BRIDGE_PARTIAL").otherwise("BRIDGE_WEAK")


def conditioning_token(best: Column, chance: Column, internal_best: Column, margin: float = 0.15, gap: float = 0.15) -> Column:
    """A bottleneck if the best accuracy is near chance and well below the internal one; unknown values show none."""
    return F.when((best <= chance + margin) & (best <= internal_best - gap), "COND_BOTTLENECK").otherwise("COND_NOT_BOTTLENECK")


def seed_floor_token(best: Column, chance: Column, slope_low: Column, margin: float = 0.10) -> Column:
    """Tokens of a floor above chance and of a slope whose interval lies above zero, joined by +."""
    floor, rises = F.when(best - chance > margin, "SEED_FLOOR_CONFIRMED"), F.when(slope_low > 0, "SEED_AMPLIFICATION")
    return F.when(floor.isNull() & rises.isNull(), "NO_SEED_FLOOR").otherwise(F.concat_ws("+", floor, rises))


def categorical_token(majority_share: Column, effective_labels: Column, most_share: float, least_labels: float) -> Column:
    """Degenerate if one label holds too much or too few labels are in effect."""
    return F.when((majority_share >= most_share) | (effective_labels < least_labels), "DEGENERATE").otherwise("INFORMATIVE")


def material_token(relative_agreement: Column, least: float) -> Column:
    return F.when(relative_agreement < least, "DEGENERATE").otherwise("INFORMATIVE")
