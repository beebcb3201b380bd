"""Near-duplicate documents by SetSketch registers: banded candidates, joint likelihood estimate, exact check."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bits_for, components, key_filter, named_classes, one_of_each, with_maybe, with_node, without_rows, written

BANDS, BAND_ROWS = 32, 5
REGISTERS = BANDS * BAND_ROWS
BASE = 1.001  # spacing of the register values; close to 1, equal registers are about as likely as plain minima
RATE = 20.0
LIMIT = (1 << 16) - 2
SIDE, CHUNK = 1 << 19, 1 << 17  # shingles in a block of pivots and in a block of the documents they are compared with
STEP = 4_000_000  # cells of an overlap matrix, and pairs of a sparse column, made at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20210)
_MUL = (_RNG.integers(0, 1 << 31, (REGISTERS, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (REGISTERS, 1), dtype=np.uint32)
_BAND_MUL = _RNG.integers(1, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POWERS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of ``text``: A-Z lower-cased, cut at the six ASCII white-space characters only.

    A word's hash is a polynomial in random numbers of its bytes, modulo 2^64, then mixed.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    letter = _LETTER[raw]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    lengths = edge[1::2] - edge[::2]
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _POWERS[0]), dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[raw[letter]] * powers[place], first) + lengths.astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; one for a shorter text; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = mixed(w[: len(w) - k + 1] + np.uint64(k))
    for j in range(1, k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(hashes: np.ndarray) -> np.ndarray:
    """Truncated minima on an exponential scale: floor(1 - log_b(min of Exp(a))), clipped to 0..LIMIT+1.

    Registers of a union are the elementwise maximum, so sketches merge.
    """
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (_MUL * x[None, i : i + 2048] + _ADD).min(1), out=low)
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return mixed((rows * _BAND_MUL).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register pairs, given both set sizes.

    With u, v the shares of the two sizes, P(Ka > Kb) = p(u - vJ) and P(Ka < Kb) = p(v - uJ),
    p(x) = -log_b(1 - x (b - 1) / b); J runs over a grid of hundredths.
    """
    up, down = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    same = REGISTERS - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    pa, pb = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = up * np.log(pa + tiny) + down * np.log(pb + tiny) + same * np.log(np.clip(1 - pa - pb, tiny, 1))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("_text"))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, digest of the set, registers, band keys. Empty sets have no digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                out = []
                for doc, key, text in pdf.iloc[i : i + 256].itertuples(index=False):
                    s = shingle_set(text, width)
                    if len(s):
                        r = registers(s)
                        out.append((doc, key, len(s), digest_of(s), r.tobytes(), band_keys(r)))
                    else:
                        out.append((doc, key, 0, None, None, None))
                yield pd.DataFrame(out, columns=["id", "text_key", "n_shingles", "digest", "regs", "bands"]).astype({"id": "Int64"})

    return named_rows(docs, id_col, text_col).mapInPandas(run, "id long, text_key long, n_shingles long, digest binary, regs binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The classes of ``wanted`` (id, digest, ...) with a column ``shingles``, from the whole texts of their rows."""
    bits = bits_for(wanted.count())
    rows = named_rows(docs, id_col, text_col).select("id", "_text")
    near = with_maybe(rows, written(key_filter(wanted, "id", bits=bits)), "id", bits=bits).where("_maybe").select("id", "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                sets = [shingle_set(t, width) for t in part["_text"]]
                yield pd.DataFrame({"id": part["id"], "digest": [digest_of(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    sets = near.mapInPandas(run, "id long, digest binary, shingles array<long>")
    return sets.join(wanted, ["id", "digest"]).dropDuplicates(["digest"])


def estimated(*columns: str) -> Column:
    """``similarity_estimate`` of register and size columns (ra, rb, na, nb)."""

    @F.pandas_udf("double")
    def run(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(ra), np.uint16).reshape(-1, REGISTERS)
        b = np.frombuffer(b"".join(rb), np.uint16).reshape(-1, REGISTERS)
        return pd.Series(similarity_estimate(a, b, na.to_numpy(float), nb.to_numpy(float)))

    return run(*columns)


def linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of ``pairs`` (a, b: nodes) those whose estimate comes near ``percent`` hundredths and whose full sets reach it, written."""
    regs = reps.select("node", "regs", "n_shingles")
    both = pairs.join(regs.toDF("b", "rb", "nb"), "b").join(regs.toDF("a", "ra", "na"), "a")
    close = written(both.where(estimated("ra", "rb", "na", "nb") >= max(0.0, percent / 100 - 0.1)).select("a", "b"))
    ends = close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).distinct()
    wanted = written(reps.select("node", "id", "digest").join(ends, "node"))
    sets = written(shingle_sets(docs, wanted, width, id_col, text_col).select("node", "shingles"))
    sided = close.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return written(sided.where(shared * 100 >= (total - shared) * percent).select(F.col("a").alias("src"), F.col("b").alias("dst")))


class Block:
    """Sets of a block of pivots, ready to be compared with other sets; links join their components as they are found."""

    def __init__(self, nodes: list[int], parts: list[int], sets: list[np.ndarray], percent: int):
        self.nodes, self.parts, self.percent = nodes, parts, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.vocab, column = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.owner = owner[order]
        self.n = np.bincount(column, minlength=len(self.vocab))
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.to: dict[int, int] = {}

    def find(self, c: int) -> int:
        while (up := self.to.get(c, c)) != c:
            c = up
        return c

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        """How many shingles each pivot shares with each of ``sets``. Common columns go through matrix products, rare ones pair by pair."""
        rows, cols = len(self.nodes), len(sets)
        out = np.zeros((rows, cols), np.int64)
        if not len(self.vocab):
            return out
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(cols), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(self.vocab, values), len(self.vocab) - 1)
        hit = self.vocab[column] == values
        owner, column = owner[hit], column[hit]
        heavy = self.n * np.bincount(column, minlength=len(self.vocab)) * 250 > rows * cols
        dense = np.flatnonzero(heavy)
        for i in range(0, len(dense), 1024):
            part = dense[i : i + 1024]
            place = np.full(len(self.vocab), -1)
            place[part] = np.arange(len(part))
            x, y = np.zeros((rows, len(part)), np.float32), np.zeros((len(part), cols), np.float32)
            for k, c in enumerate(part):
                x[self.owner[self.start[c] : self.start[c + 1]], k] = 1
            at = place[column]
            y[at[at >= 0], owner[at >= 0]] = 1
            out += (x @ y).astype(np.int64)
        light = ~heavy[column]
        owner, column = owner[light], column[light]
        many = np.cumsum(self.n[column])
        begin = 0
        while begin < len(column):
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + STEP, "right")))
            c = column[begin:end]
            n = self.n[c]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pivot = self.owner[np.repeat(self.start[c], n) + inside]
            out += np.bincount(pivot * cols + np.repeat(owner[begin:end], n), minlength=rows * cols).reshape(rows, cols)
            begin = end
        return out

    def links(self, nodes: list[int], parts: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links to other components, none between components that links found before have joined."""
        sizes = np.array([len(s) for s in sets], np.int64)
        shared = self.overlaps(sets)
        near = shared * 100 >= (self.sizes[:, None] + sizes[None, :] - shared) * self.percent
        near &= np.array(self.parts)[:, None] != np.array(parts)[None, :]
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = self.find(self.parts[i]), self.find(parts[j])
            if a != b:
                self.to[max(a, b)] = min(a, b)
                yield self.nodes[i], nodes[j]


def block_links(units: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) inside the units (group, px, py): pivots (side 0) against the rest (side 1), some rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, block, pivots = None, None, []
        for pdf in batches:
            out, waiting = [], []

            def compare():
                step = max(1, STEP // max(1, len(block.nodes)))
                for k in range(0, len(waiting), step):
                    out.extend(block.links(*zip(*waiting[k : k + step], strict=True)))
                waiting.clear()

            for group, px, py, side, node, part, shingles in pdf.itertuples(index=False):
                if (group, px, py) != unit:
                    if waiting:
                        compare()
                    unit, block, pivots = (group, px, py), None, []
                if side == 0:
                    pivots.append((node, part, np.asarray(shingles)))
                    continue
                if block is None:
                    if not pivots:
                        continue
                    block = Block(*map(list, zip(*pivots, strict=True)), percent)
                    pivots = []
                waiting.append((node, part, np.asarray(shingles)))
                if len(waiting) == 512:
                    compare()
            if waiting:
                compare()
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    order = ["group", "px", "py"]
    near = units.select(*order, "side", "node", "c", "shingles").repartition(*order).sortWithinPartitions(*order, "side")
    return near.mapInPandas(run, "src long, dst long")


def rest_of_buckets(members: DataFrame, links: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """Links between the components that buckets still hold; None if none holds several.

    Buckets that share documents form a group. Each document outside its group's largest component is a pivot, and
    is compared with all documents of the group: block by block in tasks, which give back only links that join
    components. A pair of a bucket whose ends lie in different components has a pivot at one end at least, so
    none is left out, and no pair is a row of a table.
    """
    at = members.join(components(links).withColumnRenamed("id", "node"), "node", "left")
    at = written(at.withColumn("c", F.coalesce("component", "node")).drop("component"))
    open_ = written(at.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("node").alias("first")).where("low <> high").select("band", "first"))
    held = written(at.join(open_, "band").select("node", "c", "first").distinct())
    if held.isEmpty():
        return None
    groups = components(held.select(F.col("node").alias("src"), F.col("first").alias("dst"))).withColumnRenamed("id", "node")
    placed = held.select("node", "c").distinct().join(groups, "node").join(reps.select("node", "id", "digest", "n_shingles"), "node")
    placed = written(placed.withColumn("weight", F.col("n_shingles") + 64).withColumnRenamed("component", "group"))
    sizes = placed.groupBy("group", "c").agg(F.sum("weight").alias("w"))
    largest = F.max(F.struct("w", "c"))
    totals = sizes.groupBy("group").agg(F.sum("w").alias("all"), (F.sum("w") - largest["w"]).alias("outside"), largest["c"].alias("main"))
    nx = F.ceil(F.col("outside") / SIDE)
    # Blocks of the others are larger where pivots fill many blocks, so that pivots are not sent further than the others.
    ny = F.greatest(F.lit(1), F.least(F.ceil(F.col("all") / CHUNK), F.ceil(2 * nx * F.col("all") / F.col("outside"))))
    totals = written(totals.select("group", "main", nx.alias("nx"), ny.alias("ny")))
    wanted = written(placed.join(totals, "group").select("node", "id", "digest", "c", "group", "nx", "ny", (F.col("c") != F.col("main")).alias("pivot")))
    sets = written(shingle_sets(docs, wanted, width, id_col, text_col))
    px, py = F.pmod(F.xxhash64("node"), F.col("nx")), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("ny"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    columns = ["group", "px", "py", "side", "node", "c", "shingles"]
    pivots = sets.where("pivot").withColumns({"px": px, "side": F.lit(0)}).withColumn("py", every("ny")).select(*columns)
    others = sets.withColumns({"py": py, "side": F.lit(1)}).withColumn("px", every("nx")).select(*columns)
    return written(block_links(pivots.unionAll(others), percent))


def near_classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_key, n_shingles, digest) and, per set that occurs, (digest, component, keeper): see ``near_dedup``."""
    sketch = written(sketches(docs, width, id_col, text_col))
    full = sketch.where("digest is not null and id is not null")
    # Equal sets have equal registers and bands: one row a class, combined before the shuffle.
    reps = written(full.groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "regs", "bands")]))
    reps = with_node(reps)
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    bits = bits_for(buckets.count())
    near = with_maybe(banded, written(key_filter(buckets, "band", bits=bits)), "band", bits=bits).where("_maybe").select("band", "node")
    shared = written(near.join(buckets, "band"))
    # Documents that meet many others come first: the least changed copy of a group is near more of the group.
    meets = written(shared.groupBy("node").agg(F.sum("n").alias("met")))
    members = written(shared.select("band", "node").join(meets, "node"))
    hub = F.struct("met", (-F.col("node")).alias("negative"))
    firsts = written(members.groupBy("band").agg((-F.max(hub)["negative"]).alias("hub")))
    members = members.select("band", "node")
    tried = written(
        members.join(firsts, "band").where("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    )
    check = (docs, reps, width, percent, id_col, text_col)
    links = linked(tried, *check)
    more = rest_of_buckets(members, links, *check)
    named = named_classes(reps, links if more is None else links.unionAll(more))
    return sketch.select("id", "text_key", "n_shingles", "digest"), named


def near_dedup(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``.

    Equal sets are one class, named by its smallest id. Classes that share a band of registers are candidates:
    first each with the hub of its bucket (the document that meets most others), estimated by likelihood and
    checked on full sets; then, where buckets still hold several components, all their pairs between components,
    checked on full sets in blocks. So the estimate only decides what is checked first, and the one place
    where a link can be missed is the banding: a pair at the threshold shares no band with probability
    (1 - 0.8^5)^32 < 4e-6.

    Null or empty texts, and texts of white space only, have an empty set and link with nothing. Rows that repeat
    an id and a text are one document; rows that repeat an id with other texts are documents of their own that
    bear the same id. Rows without an id have no component and are kept. Other columns are not read.
    """
    rows, named = near_classes(docs, width, percent, id_col, text_col)
    component = F.coalesce("component", "id")
    return rows.join(named, "digest", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, the one of the smallest id; all columns stay.

    Decisions hold for (id, text): of rows that repeat an id only those go whose own text has a near copy that stays. Of rows
    that repeat both one stays, the least in the order of all columns.
    """
    rows, named = near_classes(docs, width, percent, id_col, text_col)
    mine = rows.where("id is not null").join(named, "digest")
    gone = mine.where((F.col("id") != F.col("component")) | (F.col("digest") != F.col("keeper")))
    return one_of_each(without_rows(docs, gone, id=F.col(id_col).cast("long"), text_key=F.xxhash64(text_col)), id_col, text_col)
