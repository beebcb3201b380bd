"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, key_filter, one_of_each, with_maybe, without_rows, written


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """Groups of two or more equal texts: (digest, keep_id, group_size), keep_id the largest id.

    Level 1 counts byte lengths, level 2 (length, hash of the first ``prefix`` characters) among lengths that
    occur twice, level 3 hashes the whole text of rows whose level-2 key occurs twice. Between levels only a
    bitmap of fixed size travels, so no text is shuffled and a hot group is counted before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumns({
        "_len": F.octet_length("_text"),
        "_pre": F.xxhash64(F.substring("_text", 1, prefix)),
    })
    narrow = written(rows.select("_len", "_pre"))
    bits = bits_for(narrow.count())
    lengths = written(key_filter(narrow.groupBy("_len").count().where("count > 1"), "_len", bits=bits))
    level2 = with_maybe(narrow, lengths, "_len", bits=bits).where("_maybe")
    keys = written(key_filter(level2.groupBy("_len", "_pre").count().where("count > 1"), "_len", "_pre", bits=bits))
    level3 = with_maybe(rows, keys, "_len", "_pre", bits=bits).where("_maybe")
    return (
        level3.select("_id", F.sha2("_text", 256).alias("digest"))
        .groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Rows that repeat an id stay or go together; null ids never win over others, and a
    group of null ids only keeps all of them. An empty table gives an empty result. Other columns are not read.
    """
    groups = written(copy_groups(docs, id_col, text_col, prefix))
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col), F.sha2(text, 256).alias("text_sha256"))
    found = every.join(groups.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left")
    grouped = F.col("group_size").isNotNull()
    return found.select(
        id_col,
        F.when(grouped, F.col("keep_id")).otherwise(F.col(id_col)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col(id_col).eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay.

    Decisions hold for (id, text): of rows that repeat an id only those go whose own text stays elsewhere. Of rows that
    repeat both one stays, the least in the order of all columns: a table read twice leaves what it leaves read once.
    """
    dropped = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"))
    left = without_rows(docs, dropped, id=F.col(id_col), digest=F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return one_of_each(left, id_col, text_col)
