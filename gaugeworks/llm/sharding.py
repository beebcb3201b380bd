"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLOTS = 1024  # ranges into which a shard's rows are dealt for ranking; ranks need counts of ranges only


def uniform(*cols) -> Column:
    """A number in [0, 1) that the values decide."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def ranked(rows: DataFrame, place: str, order: list[str], at: Column, weight: str | None = None) -> DataFrame:
    """Add ``rank``: how many rows (or how much ``weight``) of the same ``place`` come before, by ``at`` (a number in
    [0, 1)) and then ``order``; without weight it is gapless from 0.

    Rows are dealt to SLOTS ranges of ``at``; each range is ranked on its own and starts at the sum of those
    before it. Only the table of sums, places times SLOTS rows whatever the input, is summed up in one place.
    """
    each = F.col(weight) if weight else F.lit(1)
    dealt = rows.withColumn("_range", F.least(F.floor(at * SLOTS), F.lit(SLOTS - 1)).cast("int")).withColumn("_at", at)
    counts = dealt.groupBy(place, "_range").agg(F.sum(each).alias("_n"))
    before = Window.partitionBy(place).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(place, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(place, "_range").orderBy("_at", *order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(each).over(inside), F.lit(0)))
    return (
        own.join(F.broadcast(written(starts)), [place, "_range"])
        .withColumn("rank", (F.col("_own") + F.col("_start")).cast("long"))
        .drop("_range", "_at", "_own", "_start")
    )


def propagate(nodes: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """Labels for ``nodes`` (node, link, n_link, payload), by at most ``rounds`` rounds; adds block and label.

    Documents start at hashed labels. A round counts labels per link (combined before the shuffle), lets every
    linked document ask for the commonest label of its link that has places left (ties: by hash of link and
    label), and grants requests into a label only as far as linked documents fit into its even share. A link
    larger than a sixteenth of a share is dealt into blocks; the documents of a block are granted together, so a
    link moves whole or, when it outgrows a share, fills one share after the other. The driver sees counts by
    label, never links or documents.
    """
    quota = total / shards
    block = max(1, total // (shards * 16))
    pieces = F.ceil(F.col("n_link") / F.lit(block))
    state = written(nodes.withColumns({
        "block": F.pmod(F.xxhash64("node"), pieces).cast("long"),
        "label": F.pmod(F.xxhash64(F.lit("start"), "node"), F.lit(shards)).cast("int"),
    }))
    for i in range(rounds):
        counts = written(state.where("n_link > 1").groupBy("link", "label").agg(F.count(F.lit(1)).alias("n")))
        load = {r[0]: r[1] for r in counts.groupBy("label").agg(F.sum("n")).collect()}
        open_ = [s for s in range(shards) if load.get(s, 0) < quota]
        best = F.max(F.when(F.col("label").isin(open_), F.struct("n", F.xxhash64("link", "label").alias("h"), "label")))
        wishes = written(
            counts.groupBy("link").agg(best.alias("top"), F.count(F.lit(1)).alias("k"))
            .where("k > 1 and top is not null").select("link", F.col("top.label").alias("wish"))
        )
        asks = F.col("label").isin(open_) & (F.col("label") != F.col("wish"))
        flows = counts.join(wishes, "link").where(asks).groupBy("label", "wish").agg(F.sum("n").alias("n")).collect()
        if not flows:
            break
        out, into = [0] * shards, [0] * shards
        for r in flows:
            out[r["label"]] += r["n"]
            into[r["wish"]] += r["n"]
        grant = [min(1.0, max(0.0, quota - load.get(s, 0) + out[s]) / into[s]) if into[s] else 0.0 for s in range(shards)]
        granted = uniform(F.lit(i), "link", "block") < F.get(F.array(*map(F.lit, grant)), F.col("wish"))
        label = F.when(asks & granted, F.col("wish")).otherwise(F.col("label"))
        state = written(state.join(wishes, "link", "left").withColumn("label", label).drop("wish"))
    return state


def evened(state: DataFrame, total: int, shards: int) -> DataFrame:
    """Shards from labels, counts at most one apart: node, link, payload, shard.

    A block of linked rows (a whole link, unless it is larger than a sixteenth of a share) takes the commonest label
    of its rows. Blocks of a label stay, link by link, as long as they fit whole into its share. The others fill the
    places that are left, shard after shard, and single rows fill the rest. So a link is cut only where such a block
    lies across the end of a shard's free places, one for a shard at most, or where a link outgrows its share.
    """
    linked = state.where("n_link > 1")
    votes = linked.groupBy("link", "block", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", F.xxhash64("link", "label").alias("h"), "label"))
    units = votes.groupBy("link", "block").agg(F.sum("n").alias("n"), top["label"].alias("label"))
    units = written(ranked(units, "label", ["link", "block"], uniform("link"), "n").withColumnRenamed("rank", "start"))
    load = {r[0]: r[1] for r in units.groupBy("label").agg(F.sum("n")).collect()}
    share = [total // shards] * shards
    # The fullest labels keep one row more: fewer rows have to leave.
    for s in sorted(range(shards), key=lambda s: (-load.get(s, 0), s))[: total % shards]:
        share[s] += 1
    stays = F.col("start") + F.col("n") <= F.get(F.array(*map(F.lit, share)), F.col("label"))
    kept = {r[0]: r[1] for r in units.where(stays).groupBy("label").agg(F.sum("n")).collect()}
    free = place_of(share, [kept.get(s, 0) for s in range(shards)])
    columns = ["node", "link", "payload"]
    rows = linked.drop("label").join(units, ["link", "block"])
    moved = ranked(units.where(~stays).drop("start").withColumn("all", F.lit(0)), "all", ["link", "block"], uniform("link"), "n")
    moved = written(moved.select("link", "block", F.col("rank").alias("first")))
    inside = F.row_number().over(Window.partitionBy("link", "block").orderBy("node")) - 1
    again = rows.where(~stays).join(moved, ["link", "block"]).withColumn("rank", F.col("first") + inside)
    before = sum(load.values()) - sum(kept.values())
    single = ranked(state.where("n_link = 1").withColumn("all", F.lit(0)), "all", ["link", "node"], uniform("link", "node")).withColumn("rank", F.col("rank") + before)
    return (
        rows.where(stays).select(*columns, F.col("label").alias("shard"))
        .unionByName(again.select(*columns, free.alias("shard"))).unionByName(single.select(*columns, free.alias("shard")))
    )


def place_of(share: list[int], loads: list[int]) -> Column:
    """The shard whose run of free places holds ``rank``."""
    ends, names, end = [], [], 0
    for s, (most, load) in enumerate(zip(share, loads, strict=True)):
        if most > load:
            end += most - load
            ends.append(end)
            names.append(s)
    found = F.lit(None).cast("int")
    for e, s in zip(reversed(ends), reversed(names), strict=True):
        found = F.when(F.col("rank") < e, F.lit(s)).otherwise(found)
    return found


def shard_documents(docs: DataFrame, *, shards: int = 16, rounds: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row: law ``rows``, links between equal texts.

    Null text counts as empty; empty texts are equal texts like any others. Rows that repeat an id are rows of
    their own, null ids too. ``slot`` is gapless from 0 inside a shard, in the order of a hash of id and text, then of the
    id; rows equal in both take any of their places. Texts of any length count by their bytes and travel as a hash.
    Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("node"),
        F.sha2(text, 256).substr(1, 32).alias("link"),
        F.struct((F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")).alias("payload"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("link").agg(F.count(F.lit(1)).alias("n_link")))
    total = rows.count()
    state = propagate(rows.join(groups, "link"), total, shards, rounds)
    placed = written(evened(state, total, shards))
    slotted = ranked(placed, "shard", ["node"], uniform("node", "link"))
    return slotted.select(
        F.col("node").alias(id_col), F.col("payload.size").alias("size"), F.col("payload.crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(placed: DataFrame, link: str = "link") -> DataFrame:
    """One row: links that lie in more than one shard, and all links of two rows or more."""
    per = placed.groupBy(link).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("k")).where("n > 1")
    return per.agg(F.count_if(F.col("k") > 1).alias("cut"), F.count(F.lit(1)).alias("links"))
