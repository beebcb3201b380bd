"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named_classes, with_node, written

BLOCK = 8192  # vectors in a subtree, about; a task holds two
RADII = (0.8, 0.4, 0.2, 0.1)  # nested levels below a subtree's root, halving
TOP_SAMPLE = 4096  # vectors that the top level is chosen from
SUPER = 64  # nodes of the level above the subtrees
FAN, SPLIT_SAMPLE = 64, 1024  # centres that a large cell is split by, and the vectors that they are chosen from
CELLS = 1 << 17  # pairs whose distance is taken at once
SLACK = 1e-9


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; the largest component goes first, so that no square overflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v) -> np.ndarray | None:
    """The vector as stored (single or double precision), or None if it is null, zero or holds null or non-finite components."""
    if v is None or not len(v):
        return None
    a = np.asarray(v)
    if a.dtype != np.float32:
        a = a.astype(np.float64)
    return a if np.isfinite(a).all() and a.any() else None


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def net(x: np.ndarray, r: float) -> np.ndarray:
    """The number of its centre for each row: centres are taken in order, no two within ``r`` (in single precision), all rows within it."""
    least = np.float32(1 - r * r / 2)
    single = x.astype(np.float32)
    own = np.full(len(x), -1)
    centres: list[int] = []
    for i in range(0, len(x), 256):
        rows = np.arange(i, min(len(x), i + 256))
        if centres:
            s = single[rows] @ single[centres].T
            best = s.argmax(1)
            near = s[np.arange(len(rows)), best] >= least
            own[rows[near]] = np.array(centres)[best[near]]
            rows = rows[~near]
        s = single[rows] @ single[rows].T >= least
        for k, row in enumerate(rows):
            if own[row] < 0:
                centres.append(row)
                own[rows[s[k] & (own[rows] < 0)]] = row
                own[row] = row
    return own


def grow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows put in tree order, and for each level and place the place where its node begins.

    A node's first member is its centre; nodes of a level are runs of places and lie inside nodes of the level above.
    """
    order, levels = np.arange(len(x)), []
    begin = np.zeros(len(x), np.int64)
    for r in RADII:
        starts = np.unique(begin)
        fresh = np.empty_like(begin)
        for s, e in zip(starts, np.append(starts[1:], len(x)), strict=True):
            if e - s == 1:
                fresh[s] = s
                continue
            rows = order[s:e]
            own = net(x[rows], r)
            turn = np.lexsort((np.arange(e - s) != own, own))  # a centre stands before its members
            order[s:e] = rows[turn]
            own = own[turn]
            fresh[s:e] = s + np.searchsorted(own, own)
        # Rows were moved inside nodes of the levels above only: their starts stay.
        levels.append(fresh)
        begin = fresh
    return order, np.array(levels)


class Tree:
    """A subtree of vectors in tree order: node starts and covering radii by level, the root first."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.x, self.single, self.ids, self.weights = x, x.astype(np.float32), ids, weights
        self.links, self.label = np.zeros(len(x), np.int64), ids.copy()
        self.starts, self.radii = [], []
        for begin in (np.zeros(len(x), np.int64), *levels):
            starts = np.unique(begin)
            self.starts.append(starts)
            self.radii.append(np.sqrt(np.maximum.reduceat(((x - x[begin]) ** 2).sum(1), starts)))

    def members(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of members of each node."""
        ends = np.append(self.starts[level][1:], len(self.x))
        return self.starts[level][nodes], ends[nodes] - self.starts[level][nodes]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First number and count of each node's children on the next level."""
        first, n = self.members(level, nodes)
        low = np.searchsorted(self.starts[level + 1], first)
        return low, np.searchsorted(self.starts[level + 1], first + n) - low


class Pair:
    """Dual traversal of two subtrees, or of one with itself: counts links and finds edges that connect what is linked."""

    def __init__(self, a: Tree, b: Tree, cosine: float):
        self.a, self.b, self.cosine, self.same = a, b, cosine, a is b
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.edges: list[np.ndarray] = []

    def run(self) -> np.ndarray:
        p = q = np.zeros(1, np.int64)
        for level in range(len(RADII)):
            p, q = self.descend(level, p, q)
        self.compare(p, q)
        return np.concatenate(self.edges) if self.edges else np.empty((0, 2), np.int64)

    def descend(self, level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of the node pairs (p, q) that covering radii can't decide."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        pa, na = self.a.children(level, p)
        qb, nb = self.b.children(level, q)
        wide = na * nb > CELLS // 8
        for i in np.flatnonzero(wide):  # both nodes have many children: distances by matrix product, in single precision first
            found += self.wide(level + 1, np.arange(pa[i], pa[i] + na[i]), np.arange(qb[i], qb[i] + nb[i]))
        for i, j in self.pairs(pa[~wide], na[~wide], qb[~wide], nb[~wide]):
            found.append(self.undecided(level + 1, i, j))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def wide(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of the nodes i and j, by classes of similar radius of j, so that the widest sets the bound for few."""
        ca, ra, rb = self.a.starts[level][i], self.a.radii[level][i], self.b.radii[level][j]
        kinds = np.searchsorted((0.0, 0.1, 0.3, 0.6), rb)
        for kind in np.unique(kinds):
            own = j[kinds == kind]
            right, widest = self.b.single[self.b.starts[level][own]].T, float(rb[kinds == kind].max())
            for k in range(0, len(i), 512):
                least = 1 - (ra[k : k + 512] + widest + self.reach) ** 2 / 2 - 1e-4
                u, v = np.nonzero(self.a.single[ca[k : k + 512]] @ right >= least.astype(np.float32)[:, None])
                for m in range(0, len(u), CELLS):
                    yield self.undecided(level, i[k + u[m : m + CELLS]], own[v[m : m + CELLS]])

    def pairs(self, start_a: np.ndarray, na: np.ndarray, start_b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of the runs of numbers (start_a, na) x (start_b, nb), some at a time."""
        total = np.cumsum(na * nb)
        begin = 0
        while begin < len(na):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CELLS, "right")))
            i = ranges(start_a[begin:end], na[begin:end])
            width, low = np.repeat(nb[begin:end], na[begin:end]), np.repeat(start_b[begin:end], na[begin:end])
            yield np.repeat(i, width), ranges(low, width)
            begin = end

    def undecided(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drops node pairs that lie too far apart, and counts at once those that link member with member."""
        if self.same:
            keep = i <= j
            i, j = i[keep], j[keep]
        x, y = self.a.x[self.a.starts[level][i]], self.b.x[self.b.starts[level][j]]
        d = np.sqrt(((x - y) ** 2).sum(1))
        cover = self.a.radii[level][i] + self.b.radii[level][j]
        whole = (d + cover <= self.reach - SLACK) & (cover > 0)
        for u, v in zip(i[whole], j[whole], strict=True):
            self.join_all(level, u, v)
        left = ~whole & (d - cover <= self.reach + SLACK)
        return i[left], j[left]

    def join_all(self, level: int, u: int, v: int) -> None:
        """Every member of node u links with every member of node v."""
        (su,), (nu,) = self.a.members(level, np.array([u]))
        (sv,), (nv,) = self.b.members(level, np.array([v]))
        one, two = slice(su, su + nu), slice(sv, sv + nv)
        if self.same and u == v:
            self.a.links[one] += self.a.weights[one].sum() - self.a.weights[one]
        else:
            self.a.links[one] += self.b.weights[two].sum()
            self.b.links[two] += self.a.weights[one].sum()
        low = min(self.a.label[one].min(), self.b.label[two].min())
        for tree, part in ((self.a, one), (self.b, two)):
            self.lower(tree, np.arange(part.start, part.stop), np.full(part.stop - part.start, low))

    def lower(self, tree: Tree, at: np.ndarray, label: np.ndarray) -> bool:
        """Give smaller labels, each an edge from the vector to one that it is connected with."""
        changed = label < tree.label[at]
        at, label = at[changed], label[changed]
        tree.label[at] = label
        if len(at):
            self.edges.append(np.stack([tree.ids[at], label], 1))
        return bool(len(at))

    def compare(self, p: np.ndarray, q: np.ndarray) -> None:
        """Members of the node pairs of the last level, in double precision."""
        for i, j in self.pairs(*self.a.members(len(RADII), p), *self.b.members(len(RADII), q)):
            if self.same:
                keep = i < j
                i, j = i[keep], j[keep]
            hit = np.einsum("ij,ij->i", self.a.x[i], self.b.x[j]) >= self.cosine
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            np.add.at(self.a.links, i, self.b.weights[j])
            np.add.at(self.b.links, j, self.a.weights[i])
            while True:
                la, lb = self.a.label.copy(), self.b.label.copy()
                np.minimum.at(la, i, self.b.label[j])
                np.minimum.at(lb, j, self.a.label[i])
                if self.same:
                    la = np.minimum(la, lb)
                every = np.arange(len(la))
                again = self.lower(self.a, every, la)
                if not self.same:
                    again |= self.lower(self.b, np.arange(len(lb)), lb)
                if not again:
                    break


def centres_of(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows of ``sample``, each as far from those before as it can be."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < most and near.min() < 1 - 1e-6:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def split(placed: DataFrame, kind: type) -> DataFrame:
    """``placed`` (node, weight, raw, cell) with cells of more than BLOCK vectors split by distance, again and again, until every
    cell is small or too close together to be parted.

    A pass takes centres, each as far from the others as it can be, from a bounded sample of each large cell, and moves its
    vectors to the nearest. Centres travel to the parts of their cell as rows before the vectors, so a cell of any size
    is dealt over many tasks and none holds more than its centres. Only large cells are read again.
    """
    done, left, dims = [], placed, None
    while True:
        sizes = written(left.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        big = sizes.where(F.col("n") > BLOCK)
        if big.isEmpty():
            done.append(left)
            break
        rows = left.join(big, "cell")
        dims = dims or len(rows.select("raw").first()["raw"]) // np.dtype(kind).itemsize
        done.append(left.join(big, "cell", "left_anti"))
        chosen = rows.withColumn("_k", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(len(done))), "node"))).where(F.col("_k") <= SPLIT_SAMPLE)

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(pdf), -1))
            centres = centres_of(x, int(min(FAN, 2 * math.ceil(pdf["n"].iloc[0] / BLOCK))))
            return pd.DataFrame({"cell": pdf["cell"].iloc[0], "n": pdf["n"].iloc[0], "centres": [centres.tobytes()], "k": len(centres)})

        centres = written(chosen.select("cell", "n", "raw").groupBy("cell").applyInPandas(pick, "cell long, n long, centres binary, k int"))
        close = written(centres.where("k < 2").select("cell"))
        done.append(left.join(close, "cell", "left_semi"))
        parts = F.ceil(F.col("n") / BLOCK).cast("long")
        heads = centres.where("k > 1").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("weight"), F.col("centres").alias("raw"))
        body = rows.join(close, "cell", "left_anti").select("cell", F.pmod(F.xxhash64("node"), parts).alias("part"), "node", "weight", "raw")
        near = heads.unionByName(body).repartition("cell", "part").sortWithinPartitions("cell", "part", F.asc_nulls_first("node"))

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = None
            for pdf in batches:
                start = 0
                at = [*np.flatnonzero(pdf["node"].isna().to_numpy()), len(pdf)]
                for end in at:
                    part = pdf.iloc[start:end]
                    if len(part):
                        x = unit(np.frombuffer(b"".join(part["raw"]), kind).reshape(len(part), -1))
                        yield part[["node", "weight", "raw", "cell"]].assign(k=(x @ centres.T).argmax(1)).astype({"node": "int64", "weight": "int64"})
                    if end < len(pdf):
                        first = pdf["raw"].iloc[end]
                        centres = np.frombuffer(first).reshape(-1, dims)
                    start = end + 1

        moved = near.mapInPandas(move, "node long, weight long, raw binary, cell long, k int")
        left = written(moved.select("node", "weight", "raw", F.xxhash64("cell", "k").alias("cell")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return written(out)


def subtrees(classes: DataFrame, top: np.ndarray, n: int, kind: type) -> DataFrame:
    """The vectors of ``classes`` in subtrees of about BLOCK: block, place, node, weight, raw, levels; at place 0 also centre and cover."""
    centres = centres_of(top, max(1, math.ceil(n / BLOCK)))

    @F.pandas_udf("int")
    def nearest(raw: pd.Series) -> pd.Series:
        x = unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))
        return pd.Series((x @ centres.T).argmax(1).astype(np.int32))

    placed = split(written(classes.select("node", "weight", "raw").withColumn("cell", nearest("raw").cast("long"))), kind)
    # What no centre parts any more lies closer together than 1e-3: dealt by hash, its blocks link node with node.
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1").withColumnRenamed("cell", "_cell")
    dealt = placed.join(parts, F.col("cell") == F.col("_cell"), "left").withColumn("block", F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(pdf), -1))
        order, levels = grow(x)
        pdf = pdf.iloc[order]
        first = x[order[0]]
        cover = float(np.sqrt(((x - first) ** 2).sum(1).max()))
        out = pdf[["block", "node", "weight", "raw"]].assign(place=np.arange(len(pdf), dtype=np.int32), levels=list(levels.T.astype(np.int32)))
        out["centre"] = [first if k == 0 else None for k in range(len(pdf))]
        out["cover"] = [cover if k == 0 else None for k in range(len(pdf))]
        return out[["block", "place", "node", "weight", "raw", "levels", "centre", "cover"]]

    schema = "block long, place int, node long, weight long, raw binary, levels array<int>, centre array<double>, cover double"
    return written(dealt.select("block", "node", "weight", "raw").groupBy("block").applyInPandas(build, schema))


def block_pairs(blocks: DataFrame, top: np.ndarray, reach: float) -> DataFrame:
    """(owner, block): pairs of subtrees that covering radii can't keep apart, each once, by way of the level above."""
    supers = [list(map(float, c)) for c in centres_of(top, SUPER)]
    table = F.array(*[F.array(*map(F.lit, c)) for c in supers])
    away = F.transform(table, lambda c: distance(F.col("centre"), c))
    heads = blocks.where("place = 0").select("block", "centre", "cover").withColumn("away", away)
    heads = written(heads.withColumn("over", (F.array_position("away", F.array_min("away")) - 1).cast("int")))
    cover = {r["over"]: r["r"] for r in heads.groupBy("over").agg(F.max(F.get("away", F.col("over")) + F.col("cover")).alias("r")).collect()}
    radii = F.array(*[F.lit(float(cover.get(k, -1e9))) for k in range(len(supers))])
    near = F.filter(F.sequence(F.lit(0), F.lit(len(supers) - 1)), lambda k: F.get("away", k) <= F.get(radii, k) + F.col("cover") + reach)
    left = heads.select(F.col("block").alias("a"), F.col("centre").alias("x"), F.col("cover").alias("rx"), F.explode(near).alias("over"))
    both = left.join(heads.select(F.col("block").alias("b"), F.col("centre").alias("y"), F.col("cover").alias("ry"), "over"), "over")
    both = both.where((F.col("a") < F.col("b")) & (distance(F.col("x"), F.col("y")) <= F.col("rx") + F.col("ry") + reach))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    return written(both.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("block")))


def traversed(blocks: DataFrame, pairs: DataFrame, kind: type, cosine: float) -> DataFrame:
    """node, links, to: link counts (to is the node itself), and edges (links 0), from all pairs of subtrees.

    A task holds its owner's subtree and takes the others one after the other, as rows in tree order.
    """
    columns = ["owner", "block", "place", "node", "weight", "raw", "levels"]
    own = blocks.withColumn("owner", F.col("block")).select(*columns, F.lit(0).alias("side"))
    others = pairs.join(blocks, "block").select(*columns, F.lit(1).alias("side"))
    n = blocks.where("place = 0").count()
    sent = own.unionAll(others).repartition(max(1, min(2 * n, 8192)), "owner").sortWithinPartitions("owner", "side", "block", "place")

    def tree(parts: list[pd.DataFrame]) -> Tree:
        pdf = pd.concat(parts) if len(parts) > 1 else parts[0]
        x = unit(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(pdf), -1))
        return Tree(x, np.stack(pdf["levels"].to_numpy()).T.astype(np.int64), pdf["node"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64))

    def counted(t: Tree) -> pd.DataFrame:
        at = t.links > 0
        return pd.DataFrame({"node": t.ids[at], "links": t.links[at], "to": t.ids[at]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, held = None, [], None

        def finish() -> Iterator[pd.DataFrame]:
            nonlocal held
            t = tree(parts)
            if now[1] == 0:
                held = t
            edges = Pair(held, t, cosine).run()
            yield pd.DataFrame({"node": edges[:, 0], "links": 0, "to": edges[:, 1]})
            if t is not held:
                yield counted(t)

        for pdf in batches:
            for key, part in pdf.groupby(["owner", "side", "block"], sort=False):
                if key != now:
                    if parts:
                        yield from finish()
                        if key[0] != now[0]:
                            yield counted(held)
                    now, parts = key, []
                parts.append(part)
        if parts:
            yield from finish()
            yield counted(held)

    return written(sent.mapInPandas(run, "node long, links long, to long"))


def near_dedup(vectors: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for every row of ``vectors``.

    Equal vectors are one class. Every class goes to the nearest of the centres that a net over at most TOP_SAMPLE
    classes gives; cells of more than BLOCK are split by distance until they are small, and each becomes a subtree with
    nested levels of halving radii. Spark
    joins the subtrees whose covering radii can't keep them apart, by way of a level above; tasks traverse each pair
    from level to level, only children of undecided node pairs are looked at, and node pairs that link member with
    member are counted at once. Pairs of vectors are counted, never listed.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those of
    another length than the commonest (of equally common ones the greatest), nor rows without an id. Rows that
    repeat an id and a vector are one vector, those that repeat an id with other vectors are vectors of their own that bear
    one id. An empty table gives an empty result; other columns are not read.
    """
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 1024):
                out = []
                for i, v in pdf.iloc[k : k + 1024].itertuples(index=False):
                    a = None if pd.isna(i) else usable(v)
                    raw = None if a is None else a.astype(kind).tobytes()
                    out.append((i, raw, None if raw is None else hashlib.blake2b(raw, digest_size=16).digest()))
                yield pd.DataFrame(out, columns=["id", "raw", "digest"]).astype({"id": "Int64"})

    rows = written(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(clean, "id long, raw binary, digest binary"))
    size = F.octet_length("raw")
    common = rows.where("raw is not null").groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    alone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return alone
    fit = rows.where("raw is not null").where(size == common["size"])
    found = fit.groupBy("digest").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"), F.first("raw").alias("raw"))
    classes = written(with_node(found))
    top = [np.frombuffer(r["raw"], kind) for r in classes.orderBy(F.xxhash64("node"), "node").limit(TOP_SAMPLE).select("raw").collect()]
    top = unit(np.array(top))
    blocks = subtrees(classes, top, classes.count(), kind)
    pairs = block_pairs(blocks, top, math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)
    seen = traversed(blocks, pairs, kind, cosine)
    links = seen.groupBy("node").agg(F.sum("links").alias("links"))
    named = named_classes(classes, seen.where("node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst")))
    counts = classes.select("digest", "node", "weight").join(links, "node", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(written(named.join(counts, "digest")), "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
