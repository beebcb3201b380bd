"""Validation, completeness, reconciliation and integrity of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``errors``: the codes of all rules that a row breaks, in the rules' order."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules.items()])))


def completeness(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, extra or repeated: keys, problem, n."""
    seen = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(expected.select(*keys).distinct().withColumn("_want", F.lit(True)), keys, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem", F.coalesce("n", F.lit(0)).alias("n"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """Per field: matches, mismatches, largest difference; undefined must meet undefined, keys must be the same."""
    left = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("_b"))
    both = left.join(right, keys, "full_outer")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("double").alias("x"), F.col(f"b_{f}").cast("double").alias("y")) for f in fields]))
    rows = both.select(*keys, "_a", "_b", cells.alias("c")).select("c.*", (F.col("_a") & F.col("_b")).alias("both"))
    ok = F.coalesce("both", F.lit(False)) & ((F.abs(F.col("x") - F.col("y")) <= tolerance) | (F.col("x").isNull() & F.col("y").isNull()))
    ok = F.coalesce(ok, F.lit(False))
    return rows.groupBy("field").agg(F.count_if(ok).alias("matches"), F.count_if(~ok).alias("mismatches"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_delta"))


def rater_integrity(df: DataFrame, rater: str, item: str) -> DataFrame:
    """Per rater: items, and whether the item set equals that of the first rater by name.

    Sets are compared by their size and two sums over 64-bit hashes of their items, so none is put together.
    """
    text = F.col(item).cast("string")
    once = df.select(rater, text.alias("_i")).distinct()
    sums = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_i").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("_i", F.lit(1))).alias("x"))
    per = once.groupBy(rater).agg(F.count("_i").alias("items"), sums.alias("item_set"))
    first = per.agg(F.min_by("item_set", rater).alias("first_set"))
    return per.join(F.broadcast(first)).select(rater, "items", (F.col("item_set") == F.col("first_set")).alias("same_items"))
