"""How the test tables stand for measurements: Spark views of them, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    """Round a computed double to six places, so that summation order can't show."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c) if name or isinstance(c, str) else col


def measurements(spark: SparkSession, sf_dir: str, by_unit: bool = False) -> DataFrame:
    """unit, axis, s, role, label: parts measured on three axes along the line number; O lines are independents, F lines forks.

    ``by_unit`` deals the lines by unit first, in parts of bounded size: all counts by unit then need no other shuffle,
    and no task holds more groups as the table grows.
    """
    q, disc = F.col("l_quantity"), F.col("l_discount")
    axes = F.array(
        F.struct(F.lit("flag").alias("axis"), F.col("l_returnflag").alias("label")),
        F.struct(F.lit("size").alias("axis"), F.when(q.between(24, 27), "abstain").when(q < 24, "small").otherwise("large").alias("label")),
        F.struct(F.lit("disc").alias("axis"), F.when(disc < 0.045, "low").otherwise("high").alias("label")),
    )
    role = F.when(F.col("l_linestatus") == "O", "independent").otherwise("fork")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity", "l_discount")
    lines = dealt(lines, ["l_partkey"]) if by_unit else lines
    rows = lines.select(
        F.col("l_partkey").alias("unit"), (F.col("l_linenumber") / 7.0).alias("s"), role.alias("role"), F.explode(axes).alias("a")
    )
    return rows.select("unit", "a.axis", "s", "role", "a.label")


M = """m AS (
  SELECT l_partkey AS unit, 'flag' AS axis, l_linenumber / 7.0::DOUBLE AS s, CASE WHEN l_linestatus = 'O' THEN 'independent' ELSE 'fork' END AS role, l_returnflag AS label FROM lineitem
  UNION ALL SELECT l_partkey, 'size', l_linenumber / 7.0::DOUBLE, CASE WHEN l_linestatus = 'O' THEN 'independent' ELSE 'fork' END, CASE WHEN l_quantity BETWEEN 24 AND 27 THEN 'abstain' WHEN l_quantity < 24 THEN 'small' ELSE 'large' END FROM lineitem
  UNION ALL SELECT l_partkey, 'disc', l_linenumber / 7.0::DOUBLE, CASE WHEN l_linestatus = 'O' THEN 'independent' ELSE 'fork' END, CASE WHEN l_discount < 0.045 THEN 'low' ELSE 'high' END FROM lineitem)"""

AGREE = "CASE WHEN sum(c) < 2 THEN 1.0 ELSE sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) END"

#: m, ind (unit, axis, a_ind), curves (unit, axis, s, a_fork, a_ind, gain)
CURVES = f"""{M},
ind AS (SELECT unit, axis, {AGREE} AS a_ind FROM (SELECT unit, axis, label, count(*) AS c FROM m WHERE role = 'independent' GROUP BY ALL) GROUP BY ALL),
frk AS (SELECT unit, axis, s, {AGREE} AS a_fork FROM (SELECT unit, axis, s, label, count(*) AS c FROM m WHERE role = 'fork' GROUP BY ALL) GROUP BY ALL),
curves AS (SELECT unit, axis, s, a_fork, a_ind, CASE WHEN a_ind >= 1 - 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (a_fork - a_ind) / (1 - a_ind))) END AS gain FROM frk JOIN ind USING (unit, axis))"""


def documents_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, a (quality label), b (a rule on the text's length): two raters of one item."""
    rule = (F.col("n_chars") > 700).cast("int")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.col("quality").cast("string").alias("a"), rule.cast("string").alias("b"), "toxic"
    )


RATED = "rated AS (SELECT doc_id, lang, source, n_chars, quality::VARCHAR AS a, (n_chars > 700)::INT::VARCHAR AS b, toxic FROM labels JOIN documents USING (doc_id))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


VECTORS = "vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"
