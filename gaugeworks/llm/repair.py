"""Conversation structure repair: cheapest edits to alternating turns, by rank-convergence parallel Viterbi.

A conversation is a chain of rows. Edits keep, rerole or delete a row or insert an empty turn so that the role
initials read ``(s?(ua)+)?``. The costs to reach the end form a vector of four numbers before each row, one for each
state of that pattern. Chunks of rows compute their vectors at once, from speculative vectors at their ends; fix-up
passes rerun a chunk from what its successor found, until new and old vectors differ only by a constant, as they
soon do. Edits are then traced forwards along the stitched vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK_BITS = 12  # at most 4,096 different rows a chunk
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States of the pattern: nothing yet, after s, after u, after a; and what one more turn of the alternation makes of each.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)  # costs to finish where no row is left
# A row's code is its initial (s, u, a, other) plus four times its fault.
INITIALS, OTHER = "sua", 3
SOUND, SHORT, GONE = 0, 1, 2
SPACE = " \t\n\x0b\f\r"
COSTS = np.dtype([("rel", "<i2", (4,)), ("base", "<i8")])  # a vector is rel + base; base counts from the chunk's end


def kept(state: int, code: int) -> int | None:
    """The state after keeping a row, None where the pattern or a fault forbids it."""
    initial = code % 4
    if code // 4 == GONE or initial == OTHER:
        return None
    if initial == 0:
        return SYSTEM if state == EMPTY else None
    return NEXT[state] if NEXT[state] == initial + 1 else None


@lru_cache(maxsize=1 << 16)
def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row from the one after it, with least number zero, and the number taken off.

    A few edits lead from any state into any other's future, so vectors come from a small set and steps are remembered.
    """
    extra = TRUNCATED if code // 4 == SHORT else 0
    out = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if code // 4 != GONE:
            ways.append(REROLE + extra + after[NEXT[state]])
        to = kept(state, code)
        if to is not None:
            ways.append(extra + after[to])
        out.append(min(ways))
    for _ in range(2):  # turns inserted before the row; a third would lead nowhere new
        out = [min(cost, INSERT + out[NEXT[state]]) for state, cost in enumerate(out)]
    least = min(out)
    return tuple(cost - least for cost in out), least


def costs(codes: bytes, extra: list[int], tail: tuple[int, ...], old: np.ndarray | None = None) -> np.ndarray:
    """Cost vectors before every row of a chunk, backwards from ``tail``; ``extra`` counts further copies of a row, all deleted.

    With the vectors of an earlier pass, the run stops at the first row where new and old differ only by a constant:
    so they do at all rows before it.
    """
    out = np.zeros(len(codes), COSTS) if old is None else old.copy()
    now, base = tail, 0
    for i in range(len(codes) - 1, -1, -1):
        now, least = step(now, codes[i])
        base += least + DELETE * extra[i]
        if old is not None and tuple(out["rel"][i].tolist()) == now:
            out["base"][: i + 1] += base - out["base"][i]
            break
        out[i] = now, base
    return out


def trace(codes: bytes, extra: list[int], rel: list[list[int]], tail: tuple[int, ...], last: bool, state: int) -> tuple[int, list[str]]:
    """The state at a chunk's end and each row's edits, from ``state`` at its start: at every point the first in ASCII
    order (D, I, K, R) of the edits on a cheapest way. A conversation's last row also bears the turns inserted after it."""
    edits = []
    for code, more, after in zip(codes, extra, [*rel[1:], list(tail)], strict=True):
        here, least = step(tuple(after), code)
        add = TRUNCATED if code // 4 == SHORT else 0
        own = ""
        while DELETE + after[state] != here[state] + least and INSERT + here[NEXT[state]] == here[state]:
            own, state = own + "I", NEXT[state]
        to = kept(state, code)
        if DELETE + after[state] == here[state] + least:
            own += "D"
        elif to is not None and add + after[to] == here[state] + least:
            own, state = own + "K", to
        else:
            own, state = own + "R", NEXT[state]
        edits.append(own + "D" * more)
    while last and END[state]:
        edits[-1], state = edits[-1] + "I", NEXT[state]
    return state, edits


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults chosen by crc32 of ``conv:turn`` modulo 20 (nulls: one space): 0 dropped, 1 emptied, 2 without stops,
    3 twice, 4 from the user."""
    chosen = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))) % 20
    said, by = (F.coalesce(F.col(c), F.lit(" ")) for c in (text, role))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), by.alias("role"), said.alias("text"), chosen.alias("_fault")).where("_fault <> 0").select(
        "conv", "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_fault") == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, times) with their place ``at``, which grows along a conversation; written.

    Equal rows are counted before they are shuffled. A range shuffle by conversation, turn, role and a hash of what is
    said deals a long conversation over many tasks.
    """
    merged = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times"))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    keyed = written(merged.withColumns({
        "said": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
        "blank": last == "",
        "short": ~last.isin(".", "!", "?"),
        "initial": F.coalesce(*(F.when(F.substring("role", 1, 1) == c, F.lit(i)) for i, c in enumerate(INITIALS)), F.lit(OTHER)),
    }))
    key = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("said")]
    return written(keyed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def chunks_of(placed: DataFrame) -> DataFrame:
    """Chunks of neighbouring rows: conv, chunk (grows along a conversation), first and last in it, ats, codes, extra
    (further copies of a row), counts of faults and of illegal pairs; written.

    Of rows with one role and text all but the first are duplicates; what is said is compared by its hash, counted
    before the shuffle, and only what was said twice is joined back.
    """
    firsts = placed.groupBy(F.col("conv").alias("_conv"), F.col("said").alias("_said")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = placed.select("conv", "said", "at").join(firsts, same("conv", "_conv") & (F.col("said") == F.col("_said")))
    later = written(again.where("at > _first").select(F.col("at").alias("_later")))
    marked = placed.select("conv", "at", "times", "blank", "short", "initial").join(later, F.col("at") == F.col("_later"), "left")
    dup = F.col("_later").isNotNull()
    fault = F.when(F.col("blank") | dup, GONE).when(F.col("short"), SHORT).otherwise(SOUND)
    entry = F.struct("at", (F.col("initial") + 4 * fault).cast("int").alias("code"), (F.col("times") - 1).alias("extra"))
    grouped = marked.groupBy("conv", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(dup, F.col("times")).otherwise(F.col("times") - 1)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~dup & F.col("short"), 1).otherwise(0)).alias("truncated"),
        F.sum(F.col("times") - 1).alias("copies"),
    )
    legal = lambda a, b: (b % 4).isin(1, 2) & ((a % 4 == 0) & (b % 4 == 1) | (a % 4).isin(1, 2) & (a % 4 != b % 4))
    codes = F.col("rows.code")
    inside = F.size(F.filter(F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: b.isNotNull() & ~legal(a, b)), lambda x: x))
    along = Window.partitionBy("conv").orderBy("chunk")
    flat = written(grouped.select(
        "conv", "chunk", F.col("rows.at").alias("ats"), codes.alias("codes"), F.col("rows.extra").alias("extra"), "blank", "duplicate", "truncated", (F.col("copies") + inside).alias("inside"),
    ))
    ends = flat.select("conv", "chunk", F.get("codes", F.lit(0)).alias("a"), F.element_at("codes", -1).alias("z")).withColumns({
        "first": F.lag("z").over(along).isNull(), "last": F.lead("a").over(along).isNull(),
        "between": F.when(F.lag("z").over(along).isNotNull() & ~legal(F.lag("z").over(along), F.col("a")), 1).otherwise(0),
    }).select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), "first", "last", "between")
    joined = flat.join(ends, same("conv", "_conv") & (F.col("chunk") == F.col("_chunk")))
    return written(joined.withColumn("illegal", F.col("inside") + F.col("between")).drop("_conv", "_chunk", "inside", "between"))


def batches_with(new: dict[str, pa.DataType], read: list[str], row):
    """A function for ``mapInArrow`` that adds or replaces columns ``new`` by what ``row`` makes of columns ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row(**r) for r in batch.select(read).to_pylist()]
            kept = [n for n in batch.schema.names if n not in new]
            yield pa.record_batch([*(batch.column(n) for n in kept), *(pa.array([m[i] for m in made], t) for i, t in enumerate(new.values()))], names=[*kept, *new])

    return run


def schema_with(df: DataFrame, new: str) -> str:
    names = {part.split()[0] for part in new.split(", ")}
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names), new])


NEW = {"tail": pa.list_(pa.int32()), "head": pa.list_(pa.int32()), "base": pa.int64(), "vectors": pa.binary()}
NEW_SQL = "tail array<int>, head array<int>, base long, vectors binary"


def solved(codes, extra, tail, old=None) -> tuple:
    found = costs(bytes(codes), extra, tail, old)
    return list(tail), found["rel"][0].tolist(), int(found["base"][0]), found.tobytes()


def speculative(chunks: DataFrame) -> DataFrame:
    """The first pass: the last chunk of a conversation starts from the true costs at its end, all others from zeros."""
    return chunks.mapInArrow(batches_with(NEW, ["codes", "extra", "last"], lambda codes, extra, last: solved(codes, extra, END if last else (0, 0, 0, 0))), schema_with(chunks, NEW_SQL))


def fixed_up(state: DataFrame) -> DataFrame:
    """One fix-up pass: chunks with a tail in ``asked`` rerun from it, the others stay as they are."""

    def row(codes, extra, tail, head, base, vectors, asked):
        return (tail, head, base, vectors) if asked is None else solved(codes, extra, tuple(asked), np.frombuffer(vectors, COSTS))

    return state.mapInArrow(batches_with(NEW, ["codes", "extra", *NEW, "asked"], row), schema_with(state, NEW_SQL)).drop("asked")


def converged(chunks: DataFrame) -> DataFrame:
    """Chunks with their vectors, true up to one constant a chunk: passes run until every tail is its successor's head."""
    state = written(speculative(chunks))
    alone = state.where("first and last")
    rest = state.where("not (first and last)")
    following = F.lead("head").over(Window.partitionBy("conv").orderBy("chunk"))
    while True:
        asked = rest.withColumn("asked", following).withColumn("asked", F.when(F.col("asked") != F.col("tail"), F.col("asked")))
        if asked.where("asked is not null").isEmpty():
            return alone.unionByName(rest)
        rest = written(fixed_up(asked))


def starts(state: DataFrame) -> DataFrame:
    """The state in which each chunk of a conversation of several begins: _conv, _chunk, start.

    Tasks trace every chunk from all four states at once; then one sorted pass carries the state along a
    conversation's chunks, four numbers each.
    """
    several = state.where("not (first and last)")
    row = lambda codes, extra, vectors, tail, last: ([
        trace(bytes(codes), extra, np.frombuffer(vectors, COSTS)["rel"].tolist(), tuple(tail), last, s)[0] for s in range(4)
    ],)
    narrow = several.select("conv", "chunk", "first", "last", "codes", "extra", "tail", "vectors")
    ends = narrow.mapInArrow(batches_with({"ends": pa.list_(pa.int32())}, ["codes", "extra", "vectors", "tail", "last"], row), schema_with(narrow, "ends array<int>"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = EMPTY
        for batch in batches:
            out = []
            for first, ends in zip(batch.column("first").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                out.append(EMPTY if first else now)
                now = ends[out[-1]]
            yield pa.record_batch([batch.column("conv"), batch.column("chunk"), pa.array(out, pa.int32())], names=["_conv", "_chunk", "start"])

    near = ends.select("conv", "chunk", "first", "ends").repartition("conv").sortWithinPartitions("conv", "chunk")
    return near.mapInArrow(carry, f"_conv {several.schema['conv'].dataType.simpleString()}, _chunk long, start int")


def edits_of(state: DataFrame) -> DataFrame:
    """conv, ats, start and the edits of each row of a chunk."""
    def row(codes, extra, vectors, tail, last, start):
        return (trace(bytes(codes), extra, np.frombuffer(vectors, COSTS)["rel"].tolist(), tuple(tail), last, start)[1],)

    began = state.join(written(starts(state)), same("conv", "_conv") & (F.col("chunk") == F.col("_chunk")), "left").withColumn("start", F.coalesce("start", F.lit(EMPTY)))
    narrow = began.select("conv", "ats", "codes", "extra", "vectors", "tail", "last", "start")
    return narrow.mapInArrow(batches_with({"edits": pa.list_(pa.string())}, ["codes", "extra", "vectors", "tail", "last", "start"], row), schema_with(narrow, "edits array<string>")).select("conv", "ats", "start", "edits")


def repaired(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """Every edit in order: conv, edit (I, K, R or D), role and text (null where deleted); rows of a conversation stand together.

    Edits and texts of a conversation meet in one task, as what follows needs them in order; they stream through it.
    """
    conv_type = placed.schema["conv"].dataType.simpleString()
    texts = placed.select("conv", "at", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("array<string>").alias("edits"), F.lit(None).cast("int").alias("start"))
    plans = edits.select("conv", F.get("ats", F.lit(0)).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, state = iter(()), EMPTY
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    plan, state = iter(r["edits"]), r["start"]
                    continue
                for edit in next(plan):
                    if edit == "D":
                        out.append((r["conv"], "D", None, None))
                        continue
                    state = SYSTEM if edit == "K" and r["role"][:1] == "s" else NEXT[state]
                    out.append((r["conv"], edit, r["role"] if edit == "K" else ROLES[state], "" if edit == "I" else r["text"]))
            yield pa.record_batch([pa.array([o[0] for o in out], batch.schema.field("conv").type), *(pa.array([o[i] for o in out], pa.string()) for i in (1, 2, 3))], names=["conv", "edit", "role", "text"])

    near = plans.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "at", "kind")
    return near.mapInArrow(run, f"conv {conv_type}, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``repaired``: conv, audit (the edits' initials) and the sha256 of its turns, ``role:text`` a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, any_turn = None, None, None, False

        def closed(kind):
            return pa.record_batch([pa.array([now], kind), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is None or conv != now:
                    if audit is not None:
                        yield closed(kind)
                    now, audit, sha, any_turn = conv, [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    sha.update(f"{chr(10) if any_turn else ''}{role}:{text}".encode())
                    any_turn = True
        if audit is not None:
            yield closed(kind)

    return turns.mapInArrow(run, f"conv {turns.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of every conversation of ``rows`` (conv, turn, role, text, times) with the repaired turns, and its report.

    First: conv, edit, role, text, as ``repaired``. Second: conv, gaps, blank, duplicate, truncated, illegal, cost.
    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. Blank and duplicate rows must
    be deleted. Rows of one turn go by role, then by a hash of what is said; null turns come first, a null conversation
    is one conversation, ``times`` copies of a row stand next to each other. Roles count by their first letter; one
    outside s, u, a can't be kept. Texts and conversations may be of any length: a conversation is dealt to chunks, and
    passes through one task only where its repaired texts come out in order. An empty table gives empty results.
    """
    placed = in_order(rows)
    state = converged(chunks_of(placed))
    turns = placed.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv", "_conv")
    sums = state.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
        (F.sum("base") + F.max(F.when(F.col("first"), F.get("head", F.lit(EMPTY))))).alias("cost"),
    )
    report = sums.join(turns, same("conv", "_conv")).drop("_conv")
    return repaired(placed, edits_of(state)), report
