"""Order over whole tables without one task that sorts them: numbers, running totals, average ranks, exact quantiles.

Rows are dealt to ranges of their order and each range is handled on its own; what came before it is added from a
table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

BINS, LEFT = 4096, 50_000  # ranges a pass counts; distinct values that are sorted at last
_PART_BITS = 33  # of Spark's monotonically increasing ids


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``__part`` and ``__place``: ranges of the order and the place inside; written, so that both stay as they are."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    return written(placed).withColumn("__part", F.shiftright("__place", _PART_BITS))


def running_total(df: DataFrame, keys: list[str], order: list, value: Column | str | int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of its key up to and with this one, in ``order`` (columns or names).

    A key may hold all rows. Rows that are equal in the order are summed one after another, in an order that stays.
    """
    columns = [F.col(o).asc() if isinstance(o, str) else o for o in order]
    number = F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value
    placed = in_ranges(df.withColumn("__value", number), [*(F.col(k).asc() for k in keys), *columns])
    inside = F.sum("__value").over(Window.partitionBy(*keys, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    sums = placed.groupBy(*keys, "__part").agg(F.sum("__value").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"_k{i}" for i in range(len(keys))]
    starts = sums.withColumn("_start", before).where("_start is not null").select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("__part").alias("_p"), "_start")
    same = F.col("__part") == F.col("_p")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    total = F.col("__in") + F.coalesce("_start", F.lit(0))
    return placed.withColumn("__in", inside).join(starts, same, "left").select(*(c for c in df.columns if c != out), total.alias(out))


def numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """Add ``out``: gapless numbers from 0 per key in ``order``."""
    return running_total(df, keys, order, 1, out).withColumn(out, F.col(out).cast("long") - 1)


def average_rank(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Add ranks from 1 with ties at their mean: distinct values are counted, their running totals taken and joined back."""
    keys = keys or []
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = running_total(per, keys, [value], "_n", "_to")
    return df.join(totals.select(*keys, value, (F.col("_to") - (F.col("_n") - 1) / 2).alias(out)), [*keys, value])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and for every name in ``shares`` the exact quantile of the defined values, linear between neighbours.

    A pass counts values in ranges between the bounds of each rank's last range and keeps the range that holds the
    rank; when few distinct values are left, they are counted. No task sees more than counts and those.
    """
    rows = written(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_x")))
    one = [] if keys else [F.lit(0).alias("_one")]
    by = keys or ["_one"]
    rows = rows.select("*", *one)
    ends = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    spots = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for name, q in shares.items()))
    named = ends.select("*", F.explode(spots).alias("_q"))
    ranked = named.select(*by, F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))).alias("_r"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in")).distinct()
    found, open_ = [], written(ranked)
    while True:
        found.append(open_.where("_lo = _hi").select(*by, "_r", F.col("_lo").alias("_v")))
        open_ = open_.where("_lo < _hi")
        few = open_.where(F.col("_in") <= LEFT)
        inside = rows.join(few, by).where("_x >= _lo and _x <= _hi").groupBy(*by, "_r", "_below", "_x").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_x"))
        found.append(inside.withColumn("_to", upto).where("_r < _to and _r >= _to - _c").select(*by, "_r", F.col("_x").alias("_v")))
        many = open_.where(F.col("_in") > LEFT)
        if many.isEmpty():
            break
        at = F.least(F.lit(BINS - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS))
        bins = rows.join(many.drop("_in"), by).where("_x >= _lo and _x <= _hi").groupBy(*by, "_r", "_below", at.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_b"))
        held = bins.withColumn("_to", upto).where("_r < _to and _r >= _to - _c")
        open_ = written(held.select(*by, "_r", "_lo", "_hi", (F.col("_to") - F.col("_c")).alias("_below"), F.col("_c").alias("_in")))
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    values = written(values.distinct())
    low, high = (values.toDF(*by, r, v) for r, v in (("_rl", "_vl"), ("_rh", "_vh")))
    mixed = named.withColumn("_rl", F.floor("_q.at")).withColumn("_rh", F.ceil("_q.at")).join(low, [*by, "_rl"]).join(high, [*by, "_rh"])
    exact = F.col("_vl") + (F.col("_vh") - F.col("_vl")) * (F.col("_q.at") - F.col("_rl"))
    wide = mixed.groupBy(*by).agg(F.max("_n").alias("n"), *(F.max(F.when(F.col("_q.name") == name, exact)).alias(name) for name in shares))
    return wide if keys else wide.drop("_one")
