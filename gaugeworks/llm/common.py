"""Shared steps of the corpus operators: tables in the shared folder, bounded key filters, components."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DIR = "file:///tmp/checkpoints/gaugeworks"  # for local masters only
PAGE_BITS = 32768  # bits in one page of Spark's bitmap_construct_agg
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # 128 KB and 32 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_DIR).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it back.

    A lost executor then costs a reread of its partitions, not the jobs before. It also gives both sides of a
    later join plain exchanges, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` texts at a time to Python workers in this session: a worker and its executor then hold some MB of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(0))


def bits_for(rows: int) -> int:
    """Bits of a key filter: eight a key, as a power of two between 128 KB and 32 MB, so that its broadcast stays bounded."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * max(1, rows) - 1).bit_length()))


def key_filter(keys: DataFrame, *cols: str, bits: int = 1 << 24) -> DataFrame:
    """A bitmap of ``bits`` bits over the hashes of ``cols``: at most bits / 32768 rows of 4 KB, whatever the input."""
    at = F.pmod(F.xxhash64(*cols), F.lit(bits))
    return (
        keys.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    )


def with_maybe(df: DataFrame, pages: DataFrame, *cols: str, bits: int = 1 << 24) -> DataFrame:
    """Add boolean ``_maybe``: false only for rows whose ``cols`` are certainly not among the keys of ``pages``.

    The pages are broadcast: their size is fixed by ``bits`` (2 MB at the default), not by the data.
    """
    at = F.pmod(F.xxhash64(*cols), F.lit(bits))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumn("_page", F.bitmap_bucket_number(at))
        .withColumn("_bit", bit)
        .join(F.broadcast(pages.withColumnRenamed("page", "_page")), "_page", "left")
        .withColumn("_maybe", F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False)))
        .drop("_page", "_bit", "bitmap")
    )


def without_rows(docs: DataFrame, dropped: DataFrame, **keys: Column) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are not a row of ``dropped`` (columns of these names); null equals null.

    Whole rows are shuffled only where the bitmap can't rule them out. A row travels as one struct, so that no
    column of ``docs`` can clash with the keys or with columns of this step.
    """
    dropped = written(dropped.select(*keys).distinct())
    bits = bits_for(dropped.count())
    packed = docs.select(F.struct("*").alias("_row"), *[key.alias(name) for name, key in keys.items()])
    marked = with_maybe(packed, written(key_filter(dropped, *keys, bits=bits)), *keys, bits=bits)
    sure = marked.where(~F.col("_maybe")).select("_row.*")
    rest = marked.where("_maybe")
    gone = dropped.toDF(*(f"_gone_{name}" for name in dropped.columns))
    same = reduce(Column.__and__, (rest[name].eqNullSafe(gone[f"_gone_{name}"]) for name in keys))
    return sure.unionAll(rest.join(gone, same, "left_anti").select("_row.*"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each (id, text), null equal to null and null text to an empty one: of several the least in the order of all
    columns. Whole rows are shuffled only where the bitmap can't rule out that they repeat, and combine before that."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("_text"))
    repeated = written(packed.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id", "hash"))
    n = repeated.count()
    if not n:
        return docs
    bits = bits_for(n)
    marked = with_maybe(packed, written(key_filter(repeated, "id", "hash", bits=bits)), "id", "hash", bits=bits)
    rest = marked.where("_maybe").groupBy("id", F.sha2("_text", 256)).agg(F.min("_row").alias("_row"))
    return marked.where(~F.col("_maybe")).select("_row.*").unionAll(rest.select("_row.*"))


def bounded_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a written table with columns _id and _h (a hash of the text): one row of each pair, those whose
    id hashes lowest. Only pairs of numbers, ``most`` of them, pass through the driver."""
    keys = rows.select("_id", "_h").distinct().orderBy(F.xxhash64("_id"), "_id", "_h").limit(most).collect()
    kept = rows.sparkSession.createDataFrame([tuple(k) for k in keys], rows.select("_id", "_h").schema)
    return rows.join(F.broadcast(kept), ["_id", "_h"]).dropDuplicates(["_id", "_h"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst): one row (id, component) per end, component its smallest id.

    Contraction: every node moves to the smallest id of its closed neighbourhood, edges follow their ends, and
    the step repeats on what is left (a star ends in one step, a path halves). The smallest id of a component
    never moves, so it names the result. Nothing is collected but the emptiness of the edge table.
    """
    left = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst")
    left = written(left.distinct())
    moves = []
    while not left.isEmpty():
        both = left.select("src", "dst").unionAll(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        move = written(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("to")))
        moves.append(move)
        src = move.select(F.col("id").alias("src"), F.col("to").alias("s"))
        dst = move.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        left = written(
            left.join(src, "src").join(dst, "dst")
            .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
            .where("src <> dst").distinct()
        )
    if not moves:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    out = moves[-1].withColumnRenamed("to", "component")
    for move in reversed(moves[:-1]):
        later = out.select(F.col("id").alias("to"), F.col("component"))
        out = written(move.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component")))
    return out


def with_node(classes: DataFrame) -> DataFrame:
    """``classes`` (digest, id: the smallest of the class) with a name ``node`` for each: its id, or a hash of its
    digest where rows that repeat an id make it the smallest of several classes."""
    repeated = written(classes.groupBy("id").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"))
    if repeated.isEmpty():
        return classes.withColumn("node", F.col("id"))
    node = F.when(F.col("_times") > 1, F.xxhash64("digest")).otherwise(F.col("id"))
    return classes.join(repeated, "id", "left").withColumn("node", node).drop("_times")


def named_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Per class (digest, id, node) the smallest id of its component of ``links``, and the digest of the class that bears it."""
    part = components(links).withColumnRenamed("id", "node")
    named = classes.select("digest", "id", "node").join(part, "node", "left")
    alone = named.where("component is null").select("digest", F.col("id").alias("component"), F.col("digest").alias("keeper"))
    linked = named.where("component is not null").withColumnRenamed("component", "c")
    low = linked.groupBy("c").agg(F.min(F.struct("id", "digest")).alias("low"))
    return written(alone.unionAll(linked.join(low, "c").select("digest", F.col("low.id").alias("component"), F.col("low.digest").alias("keeper"))))
