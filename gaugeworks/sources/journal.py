"""Scans and sinks of measurement files: journals, result tables, nested documents, payloads, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running_total

TARGET = "axis_id string, kind string, label string, embedding array<double>"
EXTRA = "role string, clip string, j int, k int, s double, cfg double"
JOURNAL = f"gen_id string, axis_id string, target struct<{TARGET.replace(' ', ':').replace(',:', ',')}>, extra struct<{EXTRA.replace(' ', ':').replace(',:', ',')}>, ts timestamp"
MISSING = ("", "none", "nan")


def read_journal(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    """Journal lines as typed columns; broken lines keep their text in ``broken``. Keys come from fields, never from gen_id."""
    raw = spark.read.schema(f"{JOURNAL}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    flat = flattened(raw)
    return flat.where(F.col("role") == role) if role else flat


def flattened(raw: DataFrame) -> DataFrame:
    return raw.select("gen_id", "axis_id", "target.kind", "target.label", "target.embedding", "extra.role", "extra.clip", "extra.j", "extra.k", "extra.s", "extra.cfg", "ts", "broken")


def journal_line(rows: DataFrame, *keep: str) -> DataFrame:
    """Columns of measurements as journal JSON lines in ``value``; columns ``keep`` stay beside it."""
    return rows.select(*keep, F.to_json(F.struct(
        "gen_id", "axis_id",
        F.struct("axis_id", "kind", "label", F.lit(None).cast("array<double>").alias("embedding")).alias("target"),
        F.struct("role", "clip", F.lit(None).cast("int").alias("j"), F.lit(None).cast("int").alias("k"), "s", F.lit(None).cast("double").alias("cfg")).alias("extra"),
        "ts",
    )).alias("value"))


def undefined_to_null(col: Column, kind: str = "double") -> Column:
    """'', None, nan in any case mean undefined; NaN never leaves the scan."""
    x = F.when(~F.lower(F.trim(col)).isin(*MISSING), col).try_cast(kind)
    return F.nanvl(x, F.lit(None).cast("double")) if kind == "double" else x


def read_result_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV with a header, every column read as text, then cast with the dialect of missing values."""
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw.select(*[(F.col(c) if k == "string" else undefined_to_null(F.col(c), k)).alias(c) for c, k in columns.items()])


def flatten_unit_maps(df: DataFrame, unit: str, nested: str) -> DataFrame:
    """{axis: {s: value}} maps to rows unit, axis, s, value."""
    outer = df.select(unit, F.explode(nested).alias("axis", "inner"))
    return outer.select(unit, "axis", F.explode("inner").alias("s", "value")).withColumn("s", F.col("s").cast("double"))


def pack_keys(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """One map per group with keys joined by '|'."""
    entry = F.struct(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.col(value).alias("value"))
    return df.groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("packed"))


def unpack_keys(df: DataFrame, keys: dict[str, str], group: str, packed: str = "packed") -> DataFrame:
    rows = df.select(group, F.explode(packed).alias("key", "value"))
    part = F.split("key", r"\|")
    return rows.select(group, *[F.get(part, F.lit(i)).cast(t).alias(k) for i, (k, t) in enumerate(keys.items())], "value")


def decode_payloads(df: DataFrame, payload: str, magic: str, at: int = 1) -> DataFrame:
    """Add bytes' sha256, size and status (ok, decode_error, bad_magic) of base64 text; errors never stop the scan."""
    raw = F.try_to_binary(F.col(payload), F.lit("base64"))
    out = df.withColumn("_raw", raw)
    good = F.substring("_raw", at, len(magic)) == F.lit(magic).cast("binary")
    return out.withColumns({
        "status": F.when(F.col("_raw").isNull(), "decode_error").when(good, "ok").otherwise("bad_magic"),
        "sha256": F.sha2("_raw", 256), "size": F.octet_length("_raw").cast("long"),
    }).drop("_raw")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def pending(manifest: DataFrame, done: DataFrame, key: str, shards: int, shard: int) -> DataFrame:
    """Units of one shard that are not done: position by key, modulo the number of shards."""
    todo = numbered(manifest, [], [key], "_place").where(F.col("_place") % shards == shard).drop("_place")
    return todo.join(done.select(key), key, "left_anti")


def within_budget(calls: DataFrame, order: list[str], left: int) -> DataFrame:
    """Distinct calls by content key, as many as the budget still allows."""
    keyed = calls.groupBy("call_key").agg(*[F.min(c).alias(c) for c in order])
    return numbered(keyed, [], [*order, "call_key"], "_n").where(F.col("_n") < left).drop("_n")


def storage_rollup(df: DataFrame, category: str, size: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def running_cap(df: DataFrame, keys: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Running total per key and whether it is over the cap."""
    return running_total(df, keys, [order], size, "running").withColumn("over", F.col("running") > cap)
