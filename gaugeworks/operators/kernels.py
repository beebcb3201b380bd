"""Kernel two-sample tests by tiles: blocks of a cell's vectors meet two by two in tasks, as matrix products.

No table of pairs is made. A tile gives three sums per permutation, which add up; the bandwidth is the exact median of
all distances, found by counting ranges of their bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import draw
from ..sources.tables import written
from .ordering import numbered

TILE = 1024  # vectors of a block
SIDES, MOST = 4, 32  # a large cell's blocks are dealt to so many sides of tiles at least; blocks of a side at most
LOCAL = 4096  # rows of a cell whose permutations one task places
SOME = 4  # one of so many pairs of blocks guides the search for the median of a cell of more than 4 x SOME blocks
STRIP = 128  # rows of a block whose distances are looked at together, as many as a processor's cache holds
BINS = 8192  # ranges of a guess that are counted to place the median
FEW = 4_000_000  # distances in a range that are counted one by one
HELD = 300_000  # rows a tile holds before it adds them up
DENSE = 5  # places of cosines whose values are all counted in one table
SPAN, PART = 2_000_000, 500_000  # pairs that one task ranks, and that one row holds


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _draws(head: str, tails: pd.Series, n_perm: int) -> np.ndarray:
    """rows x permutations: the numbers that ``functions.exprs.draw`` gives, 32 bits each."""
    ends = [f":{t}".encode() for t in tails]
    out = np.empty((len(ends), n_perm), "i8")
    for p in range(n_perm):
        start = f"{head}:{p}".encode()
        out[:, p] = np.frombuffer(b"".join([hashlib.md5(start + t).digest()[:4] for t in ends]), ">u4")
    return out


def permuted_labels(df: DataFrame, keys: list[str], ident: str, grp: str, n_perm: int, seed: str) -> DataFrame:
    """keys, ident, labels: the row's group (0 or 1) and those of ``n_perm`` permutations, as text of one digit each.

    A permutation gives group 0 to as many rows of a cell as have it, first in the order of a hash. In a large cell the
    last row of group 0 is looked for among the few whose hash lies near where it must: parts of LOCAL rows are hashed
    twice, to find that row and to compare with it, and rows x permutations are never shuffled or sorted.
    """
    rows = df.select(*keys, ident, grp)
    own = F.col(grp).cast("int").cast("string")
    if not n_perm:
        return rows.select(*keys, ident, own.alias("labels"))
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(grp) == 0).alias("_n0")))
    small, large = (sizes.where(F.col("_n") <= LOCAL), sizes.where(F.col("_n") > LOCAL))
    text = [F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)).alias("_head"), F.col(ident).cast("string").alias("_tail")]
    out = f"{_kinds(df, [*keys, ident])}labels string"

    def labelled(pdf: pd.DataFrame, ones: np.ndarray) -> pd.DataFrame:
        made = pdf[[*keys, ident]].copy()
        made["labels"] = [r.tobytes().decode() for r in np.concatenate([pdf[grp].to_numpy("u1")[:, None], ones], 1) + np.uint8(48)]
        return made

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident, kind="stable").reset_index(drop=True)
        ones = np.ones((len(pdf), n_perm), "u1")
        np.put_along_axis(ones, np.argsort(_draws(pdf["_head"].iloc[0], pdf["_tail"], n_perm), axis=0, kind="stable")[: int((pdf[grp] == 0).sum())], 0, 0)
        return labelled(pdf, ones)

    near = rows.join(small.select(*keys), keys).select(*keys, ident, grp, *text)
    labels = near.groupBy(*keys).applyInPandas(placed, out)
    if large.isEmpty():
        return labels
    parts = F.ceil(F.col("_n") / LOCAL)
    many = rows.join(large, keys).select(*keys, ident, grp, *text, "_n", "_n0", F.pmod(F.xxhash64(ident), parts).alias("_part"))
    kind = df.schema[ident].dataType
    width = 8.0
    while True:
        def close(pdf: pd.DataFrame) -> pd.DataFrame:
            """For each permutation the rows whose hash lies near where the last row of group 0 must, and how many lie before."""
            n, n0 = (int(pdf[c].iloc[0]) for c in ("_n", "_n0"))
            margin = width * np.sqrt(n0 * (1 - n0 / n)) + 16
            drawn, who = _draws(pdf["_head"].iloc[0], pdf["_tail"], n_perm), pdf[ident].to_numpy()
            low, high = ((n0 + m) / n * float(1 << 32) for m in (-margin, margin))
            spots = [np.flatnonzero(x) for x in ((drawn >= low) & (drawn <= high)).T]
            made = pd.DataFrame({"_p": np.arange(n_perm, dtype="i4"), "_before": (drawn < low).sum(0), "_h": [drawn[x, p] for p, x in enumerate(spots)], "_i": [who[x] for x in spots]})
            for k in reversed(keys):
                made.insert(0, k, [pdf[k].iloc[0]] * len(made))
            return made

        found = many.groupBy(*keys, "_part").applyInPandas(close, f"{_kinds(df, keys)}_p int, _before long, _h array<long>, _i array<{kind.simpleString()}>")
        spots = found.groupBy(*keys, "_p").agg(F.sum("_before").alias("_before"), F.sort_array(F.flatten(F.collect_list(F.arrays_zip("_h", "_i")))).alias("_c")).join(large, keys)
        at = F.col("_n0") - 1 - F.col("_before")  # -1 where no row has group 0 and all are after
        last = F.when(F.col("_n0") == 0, F.struct(F.lit(-1).cast("long").alias("_h"), F.lit(None).cast(kind).alias("_i"))).when(at >= 0, F.get("_c", at.cast("int")))
        ends = spots.select(*keys, "_p", "_n", last.alias("_e"))
        ends = written(ends.groupBy(*keys, "_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_e"))), lambda x: x["_e"]).alias("_ends")))
        if ends.count() == large.count() and ends.where((F.size("_ends") < n_perm) | F.exists("_ends", lambda x: x.isNull())).isEmpty():
            break
        width *= 4  # all but impossible: the row lies outside; in the end every row is looked at
    ends = written(ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"), F.col("_ends._h").alias("_h"), F.col("_ends._i").alias("_i")))

    def compared(pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*keys, ident, "labels"])
        drawn, h, last = _draws(pdf["_head"].iloc[0], pdf["_tail"], n_perm), np.asarray(end["_h"].iloc[0]), end["_i"].iloc[0]
        ones, who = (drawn > h).astype("u1"), pdf[ident].to_numpy()
        for i, p in np.argwhere(drawn == h):
            ones[i, p] = who[i] > last[p]
        return labelled(pdf, ones)

    by = [*keys, "_part"]
    return labels.unionByName(many.groupBy(*by).cogroup(ends.groupBy(*by)).applyInPandas(compared, out))


def kernel_blocks(df: DataFrame, keys: list[str], ident: str, grp: str, vector: str, n_perm: int = 200, seed: str = "perm") -> DataFrame:
    """Blocks of about TILE vectors of a cell: keys, block, blocks (of the cell), labels, vectors; written.

    Rows whose vector is null or holds a null or NaN are left out. Cells may be of any size and number.
    """
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rows = written(df.where(ok & F.col(grp).isin(0, 1)).select(*keys, ident, grp, F.col(vector).cast("array<double>").alias("_v")))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    labelled = rows.join(permuted_labels(rows, keys, ident, grp, n_perm, seed), [*keys, ident]) if n_perm else rows.withColumn("labels", F.col(grp).cast("int").cast("string"))
    dealt = labelled.join(written(sizes), keys).withColumn("block", F.pmod(F.xxhash64(ident), F.col("blocks").cast("long")).cast("int"))
    packed = dealt.groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct("labels", "_v")).alias("_r"))
    return written(packed.select(*keys, "blocks", "block", F.col("_r.labels").alias("labels"), F.col("_r._v").alias("vectors")))


def over_tiles(blocks: DataFrame, keys: list[str], out: str, work, extra: DataFrame | None = None, by: tuple[str, ...] = (), labelled: bool = False, grouped: bool = True, some: int = 1) -> DataFrame:
    """``work(x, y, same, row)`` for every two blocks of a cell (a block with itself: ``same``): rows of ``out``, added up
    by ``by`` inside a task.

    x and y are (labels, vectors) as matrices, labels where ``labelled``; ``row`` holds the cell's columns of ``extra``.
    Blocks are dealt to sides and a task gets two sides: a block goes to as many tiles as its cell has sides, which are
    few, so what is shuffled grows with the vectors until a cell has more than SIDES x MOST blocks. Where rows are many
    (not ``grouped``) a tile is two blocks, so that a task holds the rows of those only. With ``some`` only one of so many
    pairs of blocks is seen in large cells, of every block alike, for work that need not see all.
    """
    more = [] if extra is None else [c for c in extra.columns if c not in keys]
    source = blocks if extra is None else blocks.join(extra, keys)
    count = F.greatest(F.least(F.col("blocks"), F.lit(SIDES)), F.ceil(F.col("blocks") / MOST).cast("int")) if grouped else F.col("blocks")
    sided = source.withColumn("_sides", count).withColumn("_side", F.col("block") % F.col("_sides"))
    other = F.explode(F.sequence(F.lit(0), F.col("_sides") - 1))
    tiles = sided.select("*", other.alias("_o")).select("*", F.least("_side", "_o").alias("_a"), F.greatest("_side", "_o").alias("_b"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        width = [r.strip().split()[0] for r in out.split(",")]
        first, last = (pdf[pdf["_side"] == pdf[c].iloc[0]] for c in ("_a", "_b"))
        row = pdf.iloc[0]
        stacks = {b: np.stack(list(v)) for b, v in zip(pdf["block"], pdf["vectors"], strict=True)}
        digits = {b: np.frombuffer("".join(v).encode(), "u1").reshape(len(v), -1) for b, v in zip(pdf["block"], pdf["labels"], strict=True)} if labelled else {}
        side = lambda b: (digits[b] - 48.0 if labelled else None, stacks[b])
        held, rows = [], 0
        for i in sorted(first["block"]):
            x = side(i)
            for j in sorted(last["block"]):
                if row["_a"] == row["_b"] and j < i or row["blocks"] > 4 * some and min(abs(i - j), row["blocks"] - abs(i - j)) % some:
                    continue
                held.append(work(x, x if i == j else side(j), i == j, row))
                rows += len(held[-1])
                if rows > HELD and len(held) > 1:
                    held = [_added(held, by)]
                    rows = len(held[0])
        if not held:
            return pd.DataFrame(columns=[*keys, *width])
        made = (_added(held, by) if grouped else pd.concat(held))[width]
        for k in reversed(keys):
            made.insert(0, k, [row[k]] * len(made))
        return made

    needed = tiles.select(*keys, "_a", "_b", "_side", "blocks", "block", *(["labels"] if labelled else []), "vectors", *more)
    return needed.groupBy(*keys, "_a", "_b").applyInPandas(one, f"{_kinds(blocks, keys)}{out}")


def _added(parts: list[pd.DataFrame], by: tuple[str, ...]) -> pd.DataFrame:
    whole = pd.concat(parts, ignore_index=True)
    return whole.groupby(list(by), as_index=False, sort=False).sum() if by else whole.sum().to_frame().T.astype(whole.dtypes.to_dict())


def counts_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole numbers and how often each occurs, by counting where their range is small."""
    if len(values) and (low := values.min()) >= 0 and values.max() - low < 4 * len(values) + 1024:
        n = np.bincount(values - low)
        at = np.flatnonzero(n)
        return at + low, n[at]
    return np.unique(values, return_counts=True)


def distances2(x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
    """Squared distances of rows; of a block with itself those above the diagonal."""
    d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0)
    return d2[np.triu_indices(len(x), 1)] if same else d2.ravel()


def _factors(x: np.ndarray, y: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product holds the squared distances of rows, times ``scale``."""
    left = np.concatenate([-2 * scale * x, scale * (x * x).sum(1)[:, None], np.full((len(x), 1), scale)], 1)
    return left, np.concatenate([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]], 1).T


def _rough(x: np.ndarray, y: np.ndarray, same: bool):
    """Strips of squared distances in single precision: first row, distances / unit, unit; of a block with itself those
    above the diagonal, the others infinite. A distance / unit is wrong by less than ``_slack``."""
    centre, width = x.mean(0), x.shape[1]
    a, b = x - centre, y - centre
    aa, bb = (np.einsum("ij,ij->i", v, v) for v in (a, b))
    unit = float(max(aa.max(), bb.max())) or 1.0
    left, right = np.ones((len(a), width + 2), "f4"), np.ones((len(b), width + 2), "f4")
    np.multiply(a, -2 / unit**0.5, out=left[:, :width], casting="same_kind")
    np.multiply(b, 1 / unit**0.5, out=right[:, :width], casting="same_kind")
    left[:, width], right[:, width + 1] = aa / unit, bb / unit
    right = right.T
    strip = np.empty((STRIP, len(y)), "f4")
    for at in range(0, len(x), STRIP):
        d = np.matmul(left[at : at + STRIP], right, out=strip[: len(x) - at])
        if same:
            d[np.arange(len(x)) <= np.arange(at, at + len(d))[:, None]] = np.inf
        yield at, d, unit


def _slack(x: np.ndarray) -> float:
    """A bound on the error of a sum of products in single precision, of rows whose norms are at most 1."""
    return 4 * (x.shape[1] + 10) * 2.0**-24


def _few(mask: np.ndarray) -> np.ndarray:
    """Where a flattened mask that hardly holds any is true: eight at once are passed over."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view("u8") != 0)[:, None] * 8 + np.arange(8)).ravel()
    near = np.r_[near, np.arange(whole, len(flat))]
    return near[flat[near]]


def _between(x: np.ndarray, y: np.ndarray, same: bool, low: float, high: float) -> tuple[int, np.ndarray]:
    """How many squared distances are below ``low``, and those from there to ``high``.

    Single precision tells which are surely outside; the others are computed from differences, each alike in every pass.
    """
    below, found = 0, [np.empty(0)]
    for at, d, unit in _rough(x, y, same):
        least, most = low / unit - _slack(x), high / unit + _slack(x)
        less = d < least
        below += int(np.count_nonzero(less))
        spots = _few((d < most) ^ less)
        for k in range(0, len(spots), 65_536):
            i, j = np.divmod(spots[k : k + 65_536], d.shape[1])
            gap = x[at + i] - y[j]
            exact = np.einsum("ij,ij->i", gap, gap)
            below += int(np.count_nonzero(exact < low))
            found.append(exact[(exact >= low) & (exact < high)])
    return below, np.concatenate(found)


def _uncounted(low: float, high: float, inside: int) -> int:
    """Low bits that a pass does not count: none where few distances lie between, else so many that 2^16 ranges are left."""
    first, last = (int(np.float64(v).view("i8")) for v in (low, high))
    return 0 if inside <= FEW else max(0, (last - first).bit_length() - 16)


def bandwidths(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h: the median of all distances in a cell, the mean of the two middle ones where their number is even; 1 where it is 0.

    A block's own distances give a range that should hold the median, a pass over some pairs of blocks in single precision
    narrows it. These only guide: the next pass counts all distances below the narrow range and those inside it exactly,
    by their bits (doubles sort like their bits). Where a rank turns out to lie elsewhere, the range is widened, in the end
    to all distances; ranges of many distances are counted by their leading bits, then by further ones. Only counts are
    shuffled.
    """
    def guessed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(list(pdf["vectors"].iloc[0]))
        d = distances2(x, x, True)
        share = min(0.5, 2 / np.sqrt(len(x)))
        low, high = np.quantile(d, [0.5 - share, 0.5 + share]) if len(d) else (0.0, np.inf)
        return pd.DataFrame([[*key, low, high + 1e-6 * d.max(initial=0.0) + 1e-30]], columns=[*keys, "low", "high"])

    sizes = blocks.groupBy(*keys).agg(F.sum(F.size("labels")).cast("long").alias("_m")).select(*keys, F.expr("_m * (_m - 1) div 2").alias("_n")).where("_n > 0")
    first = blocks.where("block = 0").select(*keys, "vectors").groupBy(*keys).applyInPandas(guessed, f"{_kinds(blocks, keys)}low double, high double")
    ends = sizes.join(first, keys, "left").select(*keys, "_n", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(float("inf"))).alias("high"))
    ends = written(ends.withColumn("_r", F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))

    def placed(x, y, same, row):
        low, high = float(row["low"]), float(row["high"])
        below, n = 0, np.zeros(BINS, "i8")
        for _, d, unit in _rough(x[1], y[1], same):
            less = d < low / unit
            below += int(np.count_nonzero(less))
            inner = d[(d < high / unit) ^ less].astype("f8")
            n += np.bincount(np.clip((inner * unit - low) * (BINS / (high - low)), 0, BINS - 1).astype("i8"), minlength=BINS)
        at, pairs = np.flatnonzero(n), len(x[1]) * (len(x[1]) - 1) // 2 if same else len(x[1]) * len(y[1])
        return pd.DataFrame({"bin": np.r_[-1, at, BINS].astype("i4"), "n": np.r_[below, n[at], pairs - below - n.sum()]})

    rough = over_tiles(blocks, keys, "bin int, n long", placed, ends.select(*keys, "low", "high"), ("bin",), some=SOME).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    rough = rough.join(ends, keys).withColumn("_to", upto).withColumn("_seen", F.sum("n").over(Window.partitionBy(*keys)))
    held = lambda share: F.filter("_r", lambda r: (r * share < F.col("_to")) & (r * share >= F.col("_to") - F.col("n")))
    spots = rough.withColumn("_f", F.size(held(F.col("_seen") / F.col("_n")))).where(f"_f > 0 and bin between 0 and {BINS - 1}")
    spots = spots.groupBy(*keys, "_seen").agg(F.min("bin").alias("_b0"), F.max("bin").alias("_b1"), F.sum("_f").alias("_f"), F.max("n").alias("_near"))
    width = (F.col("high") - F.col("low")) / BINS
    sure = (F.col("_f") == F.size("_r")) & (F.col("high") < float("inf"))
    wider = 1 + F.when(F.col("_seen") < F.col("_n"), F.ceil(3 * F.sqrt("_seen") / F.col("_near"))).otherwise(0)  # six deviations of a rank
    low, high = F.greatest(F.lit(0.0), F.col("low") + (F.col("_b0") - wider) * width), F.col("low") + (F.col("_b1") + 1 + wider) * width
    whole = {"low": F.lit(0.0), "high": F.lit(float("inf")), "_in": F.col("_n")}
    near = {"low": low, "high": high, "_in": F.least(F.col("_n"), F.ceil((2 + 2 * wider) * F.col("_near") * (F.col("_n") / F.col("_seen"))))}
    state = ends.join(spots, keys, "left").select(*keys, "_n", F.explode("_r").alias("_r"), *(F.when(sure, near[c]).otherwise(whole[c]).alias(c) for c in whole))

    def counted(x, y, same, row):
        out = []
        for low, high, inside in (map(float, r) for r in row["_ranges"]):
            below, d = _between(x[1], y[1], same, low, high)
            drop = _uncounted(low, high, inside)
            at, n = counts_of(d.view("i8") >> drop)
            out.append(pd.DataFrame({"low": low, "high": high, "dropped": drop, "bits": np.r_[-1, at], "n": np.r_[below, n]}))
        return pd.concat(out)

    @F.pandas_udf("double")
    def as_double(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy("i8").view("f8"))

    found = None
    while True:
        state = written(state)
        wanted = state.groupBy(*keys).agg(F.array_sort(F.collect_set(F.array("low", "high", F.col("_in").cast("double")))).alias("_ranges"))
        by = ("low", "high", "dropped", "bits")
        counts = over_tiles(blocks, keys, "low double, high double, dropped int, bits long, n long", counted, wanted, by).groupBy(*keys, *by).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "low", "high").orderBy("bits"))
        ranks = state.groupBy(*keys, "low", "high").agg(F.collect_list("_r").alias("_r"))
        at = counts.withColumn("_to", upto).where("bits >= 0").join(ranks, [*keys, "low", "high"]).withColumn("_r", F.explode(held(1)))
        at = written(at.select(*keys, "_r", "n", "dropped", *(as_double(F.expr(f"shiftleft(bits + {k}, dropped)")).alias(c) for k, c in enumerate(("low", "high")))))
        exact = at.where("dropped = 0").select(*keys, F.sqrt("low").alias("_d"))
        found = exact if found is None else found.unionByName(exact)
        left = state.select(*keys, "_n", "_r", F.col("low").alias("low0"), F.col("high").alias("high0"), F.col("_in").alias("in0")).join(at, [*keys, "_r"], "left").where("dropped is null or dropped > 0")
        if left.isEmpty():
            break
        past = (F.col("low0") > 0) & (F.col("high0") < float("inf"))  # a narrow range that the rank lies outside of
        gap = 16 * (F.col("high0") - F.col("low0"))
        more = {"low": F.greatest(F.lit(0.0), F.col("low0") - gap), "high": F.col("high0") + gap, "_in": F.least(F.col("_n"), 33 * F.col("in0"))}
        state = left.select(*keys, "_n", "_r", *(F.coalesce(F.col("n" if c == "_in" else c), F.when(past, more[c]).otherwise(v)).alias(c) for c, v in whole.items()))
    h = found.groupBy(*keys).agg(((F.min("_d") + F.max("_d")) / 2).alias("_h"))
    return h.select(*keys, F.when(F.col("_h") > 0, F.col("_h")).otherwise(1.0).alias("h"))


def mmd_permutations(blocks: DataFrame, keys: list[str], bandwidth: DataFrame) -> DataFrame:
    """keys, p, mmd2: the unbiased squared mean discrepancy with an RBF kernel of the cell's bandwidth, for the observed
    groups (p = -1) and every permutation. Null where a group has fewer than two rows."""

    def work(x, y, same, row):
        left, right = _factors(x[1], y[1], -0.5 / row["h"] ** 2)
        gx, gy = x[0], np.concatenate([y[0], np.ones((len(y[0]), 1))], 1)
        k, ky = np.empty((STRIP, len(gy))), np.empty((len(gx), gy.shape[1]))
        for at in range(0, len(gx), STRIP):
            strip = k[: len(gx) - at]
            np.matmul(left[at : at + STRIP], right, out=strip)
            np.exp(np.minimum(strip, 0.0, out=strip), out=strip)
            if same:
                strip[np.arange(len(strip)), np.arange(at, at + len(strip))] = 0.0
            np.matmul(strip, gy, out=ky[at : at + STRIP])
        ky, sums = ky[:, :-1], ky[:, -1]
        s11 = np.einsum("ij,ij->j", gx, ky)
        first, second = sums @ gx, ky.sum(0)
        cross, s00 = first + second - 2 * s11, sums.sum() - first - second + s11
        half = 0.5 if same else 1.0  # a block with itself holds every pair twice
        return pd.DataFrame({"p": np.arange(gx.shape[1]) - 1, "s00": half * s00, "s11": half * s11, "s01": half * cross})

    sums = over_tiles(blocks, keys, "p int, s00 double, s11 double, s01 double", work, bandwidth, ("p",), labelled=True)
    sums = sums.groupBy(*keys, "p").agg(*(F.sum(c).alias(c) for c in ("s00", "s11", "s01")))
    one = F.explode("labels")
    sizes = blocks.select(*keys, one.alias("_l")).groupBy(*keys).agg(F.count_if(F.substring("_l", 1, 1) == "0").alias("n0"), F.count_if(F.substring("_l", 1, 1) == "1").alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    value = 2 * F.col("s00") / (n0 * (n0 - 1)) + 2 * F.col("s11") / (n1 * (n1 - 1)) - 2 * F.col("s01") / (n0 * n1)
    return sums.join(sizes, keys).select(*keys, "p", F.when((n0 > 1) & (n1 > 1), value).alias("mmd2"))


def permutation_tests(df: DataFrame, keys: list[str], ident: str, grp: str, vector: str, n_perm: int = 200, seed: str = "perm") -> DataFrame:
    """keys, p, mmd2 as ``mmd_permutations``, with the bandwidth of each cell; written."""
    blocks = kernel_blocks(df, keys, ident, grp, vector, n_perm, seed)
    return written(mmd_permutations(blocks, keys, bandwidths(blocks, keys)))


def p_values(tests: DataFrame, keys: list[str], places: int = 9) -> DataFrame:
    """keys, mmd2, p_value: (1 + permutations that reach the observed value) / (1 + permutations)."""
    m = F.round("mmd2", places)
    obs = tests.where("p = -1").select(*keys, F.col("mmd2").alias("obs"))
    null = tests.where("p >= 0").select(*keys, m.alias("m"))
    reach = F.count_if(F.col("m") >= F.round("obs", places))
    return obs.join(null, keys, "left").groupBy(*keys).agg(F.max("obs").alias("mmd2"), F.when(F.max("obs").isNotNull(), (1 + reach) / (1 + F.count("m"))).alias("p_value"))


def power_control(df: DataFrame, unit: str, ident: str, vector: str, n_perm: int = 200, alpha: float = 0.05, seed: str = "power") -> DataFrame:
    """pairs, reject_rate, median, p95 of the test between every two unrelated units: it must reject nearly all of them to certify anything."""
    units = df.select(unit).distinct()
    pairs = written(units.select(F.col(unit).alias("u")).join(units.select(F.col(unit).alias("w")), F.col("u") < F.col("w")))
    sides = pairs.select("u", "w", F.explode(F.array(F.struct(F.col("u").alias("_unit"), F.lit(0).alias("_g")), F.struct(F.col("w").alias("_unit"), F.lit(1).alias("_g")))).alias("_s")).select("u", "w", "_s.*")
    cells = sides.join(written(df.select(F.col(unit).alias("_unit"), ident, vector)), "_unit")  # a vector is made once, not once a pair
    p = p_values(permutation_tests(cells, ["u", "w"], ident, "_g", vector, n_perm, seed), ["u", "w"])
    return p.agg(F.count("p_value").alias("pairs"), F.avg((F.col("p_value") < alpha).cast("int")).alias("reject_rate"), F.median("mmd2").alias("median"), F.percentile("mmd2", F.lit(0.95)).alias("p95"))


def halves(df: DataFrame, unit: str, ident: str, vector: str, seed: str = "half") -> DataFrame:
    """unit, ident, vector, _g: two halves (0 and 1) of each unit's own rows, split by hash; of an odd number the last is left out.

    A unit may hold all rows: its rows are numbered over ranges of their order, not in a window of one task.
    """
    rows = df.select(unit, ident, vector).withColumn("_h", draw(seed, unit, ident))
    placed = numbered(rows, [unit], ["_h", ident], "_k")
    sizes = placed.groupBy(F.col(unit).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    half = F.floor(F.col("_n") / 2)
    halved = placed.join(sizes, F.col(unit).eqNullSafe(F.col("_unit"))).where((F.col("_n") >= 4) & (F.col("_k") < 2 * half))
    return halved.select(unit, ident, vector, (F.col("_k") >= half).cast("int").alias("_g"))


def half_split_p(df: DataFrame, unit: str, ident: str, vector: str, n_perm: int = 200, seed: str = "half") -> DataFrame:
    """unit, p_value of the test between two halves of each unit's own rows, split by hash; units of fewer than four rows are left out."""
    return p_values(permutation_tests(halves(df, unit, ident, vector, seed), [unit], ident, "_g", vector, n_perm, seed), [unit]).select(unit, "p_value")


def uniformity(p: DataFrame, value: str = "p_value", least: int = 5) -> DataFrame:
    """n, ks, ks_p: the Kolmogorov-Smirnov distance of p-values from the uniform law and its series for p; null below ``least``.

    Ties are counted together, so only distinct values are put in order.
    """
    per = p.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_x"))  # at most one row a distinct p, of which there are 1 + permutations
    total = F.sum("_c").over(Window.partitionBy())
    gaps = per.withColumn("_to", upto).withColumn("_n", total).select("_n", F.greatest(F.col("_to") / F.col("_n") - F.col("_x"), F.col("_x") - (F.col("_to") - F.col("_c")) / F.col("_n")).alias("_d"))
    d, n = F.max("_d"), F.coalesce(F.max("_n"), F.lit(0))
    stated = gaps.agg(n.alias("n"), F.when(n >= least, d).alias("ks"))
    root = F.sqrt("n")
    x = (root + 0.12 + 0.11 / root) * F.col("ks")
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + term(k))
    return stated.withColumn("_l", x).withColumn("ks_p", F.when(F.col("ks").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))).drop("_l")


def _cosines(x: np.ndarray, y: np.ndarray, places: int) -> np.ndarray:
    """Cosines of rows, 0 where a norm is 0, as whole numbers of 10^-places from 0."""
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1.0)
    return (np.round(np.clip(unit(x) @ unit(y).T, -1, 1), places) * 10**places).round().astype("i8") + 10**places


def representation_similarity(df: DataFrame, ident: str, a: str, b: str, within: list[str] | None = None, places: int = 4) -> DataFrame:
    """pairs, rho: Spearman's correlation, over all unit pairs (of one group each), of the cosines that two embeddings give.

    With more than ``DENSE`` places the pairs of values get their mean ranks by two shuffles: exact and bounded in memory,
    but what is shuffled grows with the pairs. Else no pair leaves a tile. Cosines are rounded to ``places``, so they take
    at most 2 x 10^places + 1 values: a first pass counts them and gives each its mean rank, a table of that size which a
    second pass applies and sums over.
    Rows with a null or undefined vector are left out; null where there are fewer than two pairs or no spread.
    """
    keys = within or []
    ok = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    both = df.where(ok(a) & ok(b)).withColumn("_grp", F.lit(0)).withColumn("_both", F.concat(F.array(F.size(a).cast("double")), F.col(a).cast("array<double>"), F.col(b).cast("array<double>")))
    one = [] if keys else ["_one"]
    both = both if keys else both.withColumn("_one", F.lit(0))
    blocks = kernel_blocks(both, keys or one, ident, "_grp", "_both", 0)

    def sides(x, y, same):
        d = 1 + int(x[1][0, 0])
        for part in (slice(1, d), slice(d, None)):
            c = _cosines(x[1][:, part], y[1][:, part], places)
            yield c[np.triu_indices(len(c), 1)] if same else c.ravel()

    if places > DENSE:
        return _correlation(_ranked(blocks, keys or one, sides, 2 * 10**places))

    def counted(x, y, same, row):
        out = [pd.DataFrame({"side": i, "v": v, "n": n}) for i, c in enumerate(sides(x, y, same)) for v, n in [counts_of(c)]]
        return pd.concat(out).astype({"side": "i4", "v": "i8", "n": "i8"})

    found = over_tiles(blocks, keys or one, "side int, v long, n long", counted, by=("side", "v")).groupBy("side", "v").agg(F.sum("n").alias("n")).collect()
    ranks, pairs = np.zeros((2, 2 * 10**places + 1)), sum(r["n"] for r in found if r["side"] == 0)
    for side in (0, 1):
        before = 0
        for v, n in sorted((r["v"], r["n"]) for r in found if r["side"] == side):
            ranks[side, v] = before + (n + 1) / 2 - (pairs + 1) / 2  # from the mean rank
            before += n

    def summed(x, y, same, row):
        p, q = (ranks[i, c] for i, c in enumerate(sides(x, y, same)))
        return pd.DataFrame({"n": [len(p)], "xx": [p @ p], "yy": [q @ q], "xy": [p @ q]})

    return _correlation(over_tiles(blocks, keys or one, "n long, xx double, yy double, xy double", summed))


def _spans(blocks: DataFrame, keys: list[str], sides, top: int) -> list[tuple[np.ndarray, ...]]:
    """For both sides, ranges of the values 0 to ``top`` that hold at most SPAN pairs each, or one value alone: their ends
    (exclusive), whether they are one value, pairs before them and in them.

    Values are counted by their leading bits; only ranges of more than SPAN pairs are counted by further ones.
    """
    low, wanted, leaves = max(0, top.bit_length() - 14), None, ([], [])
    while True:
        def counted(x, y, same, row, low=low, wanted=wanted):
            out = []
            for i, c in enumerate(sides(x, y, same)):
                inner = c if wanted is None else c[np.isin(c >> wanted[0], wanted[1][i])]
                v, n = counts_of(inner >> low)
                out.append(pd.DataFrame({"side": i, "v": v, "n": n}))
            return pd.concat(out).astype({"side": "i4", "v": "i8", "n": "i8"})

        found = over_tiles(blocks, keys, "side int, v long, n long", counted, by=("side", "v")).groupBy("side", "v").agg(F.sum("n").alias("n")).collect()
        for r in found:
            if r["n"] <= SPAN or not low:
                leaves[r["side"]].append((r["v"] << low, (r["v"] + 1) << low, r["n"]))
        wanted = (low, [np.array([r["v"] for r in found if r["side"] == i and r["n"] > SPAN], "i8") for i in (0, 1)])
        if not low or not any(map(len, wanted[1])):
            break
        low = max(0, low - 8)
    made = []
    for side in leaves:
        spans = []  # end, single, pairs
        for start, end, n in sorted(side):
            if spans and spans[-1][2] + n <= SPAN:
                spans[-1] = (end, False, spans[-1][2] + n)
            else:
                spans.append((end, end - start == 1, n))
        n = np.array([x[2] for x in spans], "i8")
        made.append((np.array([x[0] for x in spans], "i8"), np.array([x[1] for x in spans], bool), n.cumsum() - n, n))
    return made


def _packed(values: np.ndarray, others: np.ndarray, ends: np.ndarray):
    """(range, bytes) of pairs: sorted by ``values``, cut at ``ends`` and into parts of bounded size. Bytes of one place lie
    together, so that the compression of a shuffle finds those that repeat."""
    order = np.argsort(values, kind="stable")
    both = np.stack([values[order], others[order]])
    cuts = np.searchsorted(both[0], ends)
    for k, (start, stop) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
        for at in range(start, stop, PART):
            part = np.ascontiguousarray(both[:, at : min(at + PART, stop)])
            yield k, np.ascontiguousarray(part.view("u1").reshape(-1, 8).T).tobytes()


def _unpacked(parts: pd.Series) -> np.ndarray:
    """The pairs of ``parts``, values and others, sorted by value."""
    both = np.concatenate([np.ascontiguousarray(np.frombuffer(b, "u1").reshape(8, -1).T).view("i8").reshape(2, -1) for b in parts], axis=1)
    return both[:, np.argsort(both[0], kind="stable")]


def _ranked(blocks: DataFrame, keys: list[str], sides, top: int) -> DataFrame:
    """pairs, rho: Spearman's correlation of the two values that ``sides`` gives for every pair, ties at their mean rank.

    Pairs are dealt to ranges of the first value, ranked there, dealt to ranges of the second with that rank, ranked and
    summed. A range holds a bounded number of pairs, or one value whose rank is known, so that its pairs may be dealt to
    any number of tasks. What is shuffled are two packed numbers a pair, twice.
    """
    spans = _spans(blocks, keys, sides, top)
    total = int(spans[0][3].sum())
    out = "span int, part long, data binary"

    def rows(side: int, values: np.ndarray, others: np.ndarray, part: int) -> pd.DataFrame:
        """``part`` names the task's pairs: those of a range of one value stay apart by it."""
        ends, single = spans[side][:2]
        made = [(k, part if single[k] else 0, b) for k, b in _packed(values, others, ends)]
        return pd.DataFrame(made, columns=["span", "part", "data"])

    def ranks(side: int, k: int, values: np.ndarray) -> np.ndarray:
        """Twice the mean ranks of a range's sorted values."""
        _, single, before, n = spans[side]
        if single[k]:
            return np.full(len(values), 2 * before[k] + n[k] + 1)
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        many = np.diff(np.r_[first, len(values)])
        return np.repeat(2 * (before[k] + first) + many + 1, many)

    def first(x, y, same, row):
        tile = ":".join(str(row[c]) for c in (*keys, "_a", "_b"))
        p, q = sides(x, y, same)
        return rows(0, p, q, int(hashlib.md5(tile.encode()).hexdigest()[:12], 16))

    def second(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = _unpacked(pdf["data"])
        return rows(1, q, ranks(0, key[0], p), (int(key[1]) * 31 + int(key[0])) % (1 << 60))

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = _unpacked(pdf["data"])
        x, y = ((v - (total + 1)).astype("f8") for v in (r, ranks(1, key[0], q)))
        return pd.DataFrame({"n": [len(x)], "xx": [x @ x], "yy": [y @ y], "xy": [x @ y]})

    dealt = over_tiles(blocks, keys, out, first, grouped=False).select("span", "part", "data")
    placed = dealt.groupBy("span", "part").applyInPandas(second, out)
    return placed.groupBy("span", "part").applyInPandas(summed, "n long, xx double, yy double, xy double")


def _correlation(sums: DataFrame) -> DataFrame:
    """pairs, rho of sums over centred ranks (n, xx, yy, xy)."""
    total = sums.agg(*(F.sum(c).alias(c) for c in ("n", "xx", "yy", "xy")))
    return total.select(F.coalesce("n", F.lit(0)).alias("pairs"), F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))
