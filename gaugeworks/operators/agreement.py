"""Agreement of repeated labels and vectors, of raters, and accuracy measures. Everything works from label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def label_counts(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c"))


def pair_share(c: str = "c") -> Column:
    """Share of equal pairs from counts; fewer than two labels agree fully."""
    n = F.sum(c)
    return F.when(n < 2, 1.0).otherwise(F.sum(F.col(c) * (F.col(c) - 1)) / (n * (n - 1)))


def pairwise_agreement(df: DataFrame, keys: list[str], label: str = "label", out: str = "agreement") -> DataFrame:
    """Share of equal label pairs per key, from counts that combine before the shuffle."""
    return label_counts(df, keys, label).groupBy(*keys).agg(pair_share().alias(out), F.sum("c").alias("n"))


def confident_agreement(df: DataFrame, keys: list[str], label: str = "label", abstain: str = "abstain") -> DataFrame:
    """Agreement without abstentions: null below two confident labels; with their number and the abstain rate."""
    c = F.when(F.col(label) != abstain, F.col("c")).otherwise(0)
    n = F.sum(c)
    return label_counts(df, keys, label).groupBy(*keys).agg(
        F.when(n >= 2, F.sum(c * (c - 1)) / (n * (n - 1))).alias("agreement"), n.alias("n_conf"), (1 - n / F.sum("c")).alias("abstain_rate")
    )


def krippendorff_nominal(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Alpha of one coder's values: both disagreements count the same pairs, so it is 1 if all agree (or n < 2), else 0."""
    return label_counts(df, keys, label).groupBy(*keys).agg(F.when(F.count(F.lit(1)) <= 1, 1.0).otherwise(0.0).alias("alpha"), F.sum("c").alias("n"))


def vector_agreement(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """Mean cosine over pairs from the sum of unit vectors: (|sum|^2 - nonzero) / (n (n - 1)); one pass, no pairs."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x))
    unit = df.withColumn("_norm", norm).select(*keys, F.when(F.col("_norm") == 0, 0).otherwise(1).alias("_nz"), F.posexplode(F.transform(vector, lambda x: x / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm")))).alias("pos", "x"))
    sums = unit.groupBy(*keys, "pos").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("_nz").alias("nz"))
    n = F.max("n")
    return sums.groupBy(*keys).agg(F.when(n < 2, 1.0).otherwise((F.sum(F.col("t") * F.col("t")) - F.max("nz")) / (n * (n - 1))).alias("agreement"), n.alias("n"))


def dispatched_agreement(labels: DataFrame, vectors: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement by the metric that the registry (axis, metric) names for each axis."""
    def of(df: DataFrame, metric: str) -> DataFrame:
        return df.join(F.broadcast(registry.where(F.col("metric") == metric).select("axis")), "axis", "left_semi")

    exact = pairwise_agreement(of(labels, "exact_match"), keys).select(*keys, "agreement", "n")
    alpha = krippendorff_nominal(of(labels, "krippendorff"), keys).select(*keys, F.col("alpha").alias("agreement"), "n")
    cos = vector_agreement(of(vectors, "cosine"), keys).select(*keys, "agreement", "n")
    return exact.unionByName(alpha).unionByName(cos)


def rater_agreement(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """n, p_o, kappa, ac1, pabak of two raters per key, from one table of label pairs."""
    pairs = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("c"))
    sides = pairs.select(*keys, "c", F.explode(F.array(F.struct(F.col(a).alias("label"), F.lit(1).alias("one"), F.lit(0).alias("two")), F.struct(F.col(b).alias("label"), F.lit(0).alias("one"), F.lit(1).alias("two")))).alias("x"))
    margins = sides.groupBy(*keys, "x.label").agg(F.sum(F.col("c") * F.col("x.one")).alias("na"), F.sum(F.col("c") * F.col("x.two")).alias("nb"))
    n = F.sum("na")
    marg = margins.groupBy(*keys).agg(
        n.alias("n"), F.count(F.lit(1)).alias("q"), (F.sum(F.col("na") * F.col("nb")) / (n * n)).alias("pe"),
        F.sum((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb"))).alias("sq"),
    )
    same = pairs.groupBy(*keys).agg((F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)) / F.sum("c")).alias("p_o"))
    both = same.join(marg, keys) if keys else same.crossJoin(marg)
    p_o, q = F.col("p_o"), F.col("q")
    # Gwet: sum of pi (1 - pi) = 1 - sum of pi^2, pi the mean of both margins.
    pe1 = (1 - F.col("sq") / (4 * F.col("n") * F.col("n"))) / (q - 1)
    return both.select(
        *keys, "n", "p_o",
        F.when(p_o >= 1, 1.0).when(1 - F.col("pe") <= EPS, 0.0).otherwise((p_o - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"),
        F.when((p_o >= 1) | (q < 2), 1.0).otherwise((p_o - pe1) / (1 - pe1)).alias("ac1"),
        F.when(q < 2, 1.0).otherwise((q * p_o - 1) / (q - 1)).alias("pabak"),
    )


def confusion(df: DataFrame, labels: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Counts for every pair of the given labels, zeros included; other labels are skipped."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], "a string, b string")
    counts = df.where(F.col(a).isin(labels) & F.col(b).isin(labels)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def many_rater_ac1(df: DataFrame, scale: list[str], item: str = "item", label: str = "label") -> DataFrame:
    """Gwet AC1 over items with two ratings or more, items weighed alike, margins over the fixed scale; 0 where chance
    agreement is certain. A label off the scale is an error."""
    on_scale = F.when(F.col(label).isin(scale), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("label off the scale: "), F.col(label).cast("string"))))
    counts = label_counts(df.where(F.col(label).isNotNull()).withColumn(label, on_scale), [item], label)
    total = Window.partitionBy(item)
    shares = counts.withColumn("n", F.sum("c").over(total)).where("n >= 2")
    per_item = shares.groupBy(item).agg((F.sum(F.col("c") * (F.col("c") - 1)) / (F.max("n") * (F.max("n") - 1))).alias("p"))
    agree = per_item.agg(F.avg("p").alias("p_o"), F.count(F.lit(1)).alias("n_items"))
    margin = shares.groupBy(label).agg(F.sum(F.col("c") / F.col("n")).alias("w"))
    spread = margin.agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    q = len(scale)
    pe = (1 - F.col("w2") / (F.col("t") * F.col("t"))) / (q - 1)
    return agree.join(spread).select("n_items", "p_o", F.when(1 - pe <= EPS, 0.0).otherwise((F.col("p_o") - pe) / (1 - pe)).alias("ac1"))


def marginals(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """majority_share, entropy (nats), k_eff per key."""
    counts = label_counts(df, keys, label)
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.max("p").alias("majority_share"), F.sum(-F.col("p") * F.log("p")).alias("entropy"), (1 / F.sum(F.col("p") * F.col("p"))).alias("k_eff"), F.sum("c").alias("n"))


def majority(df: DataFrame, keys: list[str], label: str = "label", tie: Column | None = None) -> DataFrame:
    """Commonest label per key; ties by the smallest value of ``tie``, the label text by default."""
    order = Window.partitionBy(*keys).orderBy(F.desc("c"), tie if tie is not None else F.col(label))
    return label_counts(df, keys, label).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, label, "c")


def balanced_accuracy(df: DataFrame, classes: list[str], label: str = "label", correct: str = "correct") -> DataFrame:
    """Mean recall over the fixed classes; null if a class has no row."""
    per = df.where(F.col(label).isin(classes)).groupBy(label).agg(F.avg(F.col(correct).cast("double")).alias("r"))
    return per.agg(F.when(F.count(F.lit(1)) == len(classes), F.avg("r")).alias("balanced_accuracy"), F.count(F.lit(1)).alias("classes"))


def auroc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Rank statistic with half credit for ties, from counts per distinct score; null without both classes."""
    keys = keys or []
    per = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    wins = per.withColumn("w", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("q") / 2))
    return wins.groupBy(*keys).agg(F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auroc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def distribution_distance(a: DataFrame, b: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per key the total variation of two label distributions; abstentions are a category."""
    def share(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c")).withColumn(name, F.col("c") / F.sum("c").over(Window.partitionBy(*keys))).select(*keys, label, name)

    both = share(a, "p").join(share(b, "q"), [*keys, label], "full_outer")
    return both.groupBy(*keys).agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"))


def nested_means(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Mean of per-unit means; undefined values dropped, repeats inside a unit reduced first."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, unit).agg(F.avg(value).alias("_m"))
    return per.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("n_units"))


def profile_agreement(df: DataFrame, pairs: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per key: within (mean unit agreement), between (mean dot product of label profiles over unit pairs), relative."""
    within = pairwise_agreement(df, [*keys, "unit"], label).groupBy(*keys).agg(F.avg("agreement").alias("within"))
    counts = label_counts(df, [*keys, "unit"], label)
    prof = counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys, "unit")))
    x = prof.select(*keys, F.col("unit").alias("u"), label, F.col("p").alias("p1"))
    y = prof.select(*keys, F.col("unit").alias("w"), label, F.col("p").alias("p2"))
    dots = pairs.join(x, [*keys, "u"]).join(y, [*keys, "w", label]).groupBy(*keys, "u", "w").agg(F.sum(F.col("p1") * F.col("p2")).alias("d"))
    between = pairs.join(dots, [*keys, "u", "w"], "left").groupBy(*keys).agg(F.avg(F.coalesce("d", F.lit(0.0))).alias("between"))
    return within.join(between, keys).withColumn("relative", (F.col("within") - F.col("between")) / (1 - F.col("between")))
