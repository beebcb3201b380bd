"""Deterministic samples and splits: order comes from hashes, never from a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import draw
from ..sources.tables import written
from .ordering import numbered, running_total


def round_robin(df: DataFrame, stratum: str, unit: str, n: int, seed: str) -> DataFrame:
    """n units, one per stratum in turn; strata and members in hashed order. Only rows of the first rounds are sorted."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, unit), unit))
    near = df.withColumn("_round", place).where(F.col("_round") <= n)
    return near.orderBy("_round", draw(seed, stratum), stratum).limit(n).drop("_round")


def stratified_split(df: DataFrame, stratum: str, unit: str, share: float, seed: str) -> DataFrame:
    """Add ``split``: per stratum the first round(share * size), half to even, are train."""
    placed = numbered(df.withColumn("_h", draw(seed, unit)), [stratum], ["_h", unit], "_place")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return joined.withColumn("split", F.when(F.col("_place") < F.bround(F.col("_n") * share), "train").otherwise("eval")).drop("_h", "_place", "_s", "_n")


def hash_modulo(text: Column, modulus: int) -> Column:
    """SHA-256 of the text as a 256-bit number, modulo a small number, digit by digit."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, x: (a * 16 + F.coalesce(x, F.lit(0))) % modulus)


def ceil_sample(df: DataFrame, task: str, item: str, share: float, namespace: str) -> DataFrame:
    """Per task the ceil(share * size) items with the lowest SHA-256 of namespace, task and item."""
    key = F.sha2(F.concat(F.lit(namespace), F.lit("|"), F.col(task).cast("string"), F.lit("|"), F.col(item).cast("string")), 256)
    placed = numbered(df.withColumn("_h", key), [task], ["_h", item], "_p")
    sizes = df.groupBy(F.col(task).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, F.col(task).eqNullSafe(F.col("_s")))
    return joined.where(F.col("_p") < F.ceil(F.col("_n") * share)).drop("_h", "_p", "_s", "_n")


def derangement(units: DataFrame, unit: str, donor: str = "donor", seed: str = "donor") -> DataFrame:
    """unit, donor: every unit gets another one, the next in the order of a hash, the last one the first; none where there is one unit."""
    placed = written(numbered(units.select(unit).distinct().withColumn("_h", draw(seed, unit)), [], ["_h", unit], "_k")).drop("_h")
    n = placed.count()
    given = placed.select(F.col(unit).alias(donor), F.pmod(F.col("_k") - 1, F.lit(max(n, 1))).alias("_k"))
    return placed.join(given, "_k").where(F.col(unit) != F.col(donor)).select(unit, donor)


def pair_draw(seed: str, number: Column) -> Column:
    """60 bits that seed and number decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), number.cast("string"))), 1, 15), 16, 10).cast("long")


def sampled_pairs(units: DataFrame, unit: str, n: int, seed: str, within: list[str] | None = None) -> DataFrame:
    """u, w: ``n`` different unordered pairs of different units (all, if fewer), of one group where ``within`` names its columns.

    Pairs are numbered: group after group, (i, j) with i < j as j (j - 1) / 2 + i. Numbers are drawn by hash and turned
    back into pairs, so the work grows with the units and with ``n``, never with the pairs. Where there are at most
    4 n pairs, the n numbers of least hash are taken.
    """
    spark, groups = units.sparkSession, within or []
    placed = written(numbered(units.select(*groups, unit).distinct().withColumn("_h", draw(seed, unit)), groups, ["_h", unit], "_i"))
    sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).withColumn("_pairs", F.expr("_n * (_n - 1) div 2")).where("_pairs > 0")
    if not groups:
        sizes = sizes.withColumn("_g", F.lit(0))
    order = groups or ["_g"]
    spans = written(running_total(sizes, [], order, "_pairs", "_end")).withColumn("_start", F.col("_end") - F.col("_pairs"))
    total = spans.agg(F.max("_end")).first()[0] or 0
    if total <= 4 * n:
        drawn = spark.range(total).select(F.col("id").alias("_x")).orderBy(pair_draw(seed, F.col("_x")), "_x").limit(n)
    else:
        slots = 2 * n + 64  # at least three in four draws are new, so this is enough but for a chance that is retried
        while True:
            each = spark.range(slots).select("id", (pair_draw(seed, F.col("id")) % total).alias("_x")).groupBy("_x").agg(F.min("id").alias("_slot"))
            if each.count() >= n:
                break
            slots *= 2
        drawn = each.orderBy("_slot").limit(n).select("_x")
    at = drawn.join(spans, (F.col("_x") >= F.col("_start")) & (F.col("_x") < F.col("_end"))).withColumn("_y", F.col("_x") - F.col("_start"))
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("_y").cast("double"))) / 2)
    pairs = at.withColumn("_j", j).withColumn("_j", F.expr("_j - int(_j * (_j - 1) div 2 > _y) + int(_j * (_j + 1) div 2 <= _y)")).withColumn("_k", F.expr("_y - _j * (_j - 1) div 2"))
    left = placed.select(*groups, F.col("_i").alias("_k"), F.col(unit).alias("_a"))
    right = placed.select(*groups, F.col("_i").alias("_j"), F.col(unit).alias("_b"))
    both = pairs.select(*groups, "_k", "_j").join(left, [*groups, "_k"]).join(right, [*groups, "_j"])
    return both.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("w"))
