"""Ranked lexical search: an inverted index in segments of documents, read by Block-Max MaxScore, shard heaps merged.

Scores are integers. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) and its impact in a document
(10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L; a score sums weight times impact.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 128  # postings of a block
SEGMENT_DOCS, SEGMENT_POSTINGS = 8192, 2_000_000  # a segment is closed at either
CLASSES = 4  # a block names its shortest document for tf 1, 2, 3 and more
BATCH_TERMS = 200_000  # query terms that go to the tasks at a time
NONE = 0xFFFFFFFF
HEAD = np.dtype([("first", "<u2"), ("last", "<u2"), ("tf", "<u4"), ("n", "<u4", (CLASSES,))])
INDEX = "segment string, term string, df long, total long, ids array<long>, lens array<long>, heads binary, docs binary, tfs binary"
INDEX_ARROW = pa.schema([
    ("segment", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())),
    ("lens", pa.list_(pa.int64())), ("heads", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary()),
])

# ASCII other than letters and digits parts terms; A-Z become a-z; every other byte is part of a term.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(FOLD).split() if text else []


class Segment:
    """Postings of some documents, gathered in order of the documents."""

    def __init__(self):
        self.names = defaultdict(count().__next__)
        self.term, self.tf, self.sizes = array("i"), array("I"), array("i")
        self.ids, self.lens = [], []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        terms = terms_of(text)
        if terms:
            found = Counter(terms)
            self.term.extend(map(self.names.__getitem__, found))
            self.tf.extend(found.values())
            self.sizes.append(len(found))
            self.ids.append(doc_id)
            self.lens.append(len(terms))

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.term) >= SEGMENT_POSTINGS

    def rows(self, name: str) -> pa.RecordBatch:
        """A row of the segment's own (its documents and lengths) and one row a term."""
        term, tf = np.frombuffer(self.term, "i4"), np.frombuffer(self.tf, "u4")
        doc = np.repeat(np.arange(len(self.ids), dtype="i4"), np.frombuffer(self.sizes, "i4"))
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        n = np.minimum(np.array(self.lens, "i8"), NONE - 1)[doc]
        df = np.bincount(term, minlength=len(self.names))
        start = np.concatenate([[0], np.cumsum(df)])
        blocks = (df + BLOCK - 1) // BLOCK
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        at = np.repeat(start[:-1], blocks) + (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)) * BLOCK
        ends = np.append(at[1:], len(term)) - 1
        heads = np.empty(len(at), HEAD)
        heads["first"], heads["last"], heads["tf"] = doc[at], doc[ends], np.maximum.reduceat(tf, at)
        for c in range(CLASSES):
            held = tf == c + 1 if c < CLASSES - 1 else tf > c
            heads["n"][:, c] = np.minimum.reduceat(np.where(held, n, NONE), at)
        gap = doc - np.repeat(heads["first"].astype("i4"), np.diff(np.append(at, len(term))))
        wide_doc, wide_tf = np.maximum.reduceat(gap, start[:-1]) > 255, np.maximum.reduceat(tf, start[:-1]) > 255
        gaps, tfs = (gap.astype("u1").tobytes(), gap.astype("<u2").tobytes()), (tf.astype("u1").tobytes(), tf.astype("<u4").tobytes())
        raw, size = heads.tobytes(), HEAD.itemsize
        lists = list(zip(start[:-1].tolist(), start[1:].tolist(), first_block[:-1].tolist(), first_block[1:].tolist(), wide_doc.tolist(), wide_tf.tolist(), strict=True))
        none = [None] * len(lists)
        return pa.record_batch([
            pa.array([name] * (1 + len(lists))),
            pa.array([None, *(t.decode() for t in self.names)], pa.string()),
            pa.array([len(self.ids), *df.tolist()], pa.int64()),
            pa.array([sum(self.lens), *none], pa.int64()),
            pa.array([self.ids, *none], pa.list_(pa.int64())),
            pa.array([self.lens, *none], pa.list_(pa.int64())),
            pa.array([None, *(raw[size * a : size * b] for _, _, a, b, _, _ in lists)], pa.binary()),
            pa.array([None, *(gaps[1][2 * s : 2 * e] if w else gaps[0][s:e] for s, e, _, _, w, _ in lists)], pa.binary()),
            pa.array([None, *(tfs[1][4 * s : 4 * e] if w else tfs[0][s:e] for s, e, _, _, _, w in lists)], pa.binary()),
        ], schema=INDEX_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An inverted index of ``docs``, written to the shared folder: every term of every whole text.

    A task closes a segment after some thousand documents, so no posting is shuffled and a term of all documents is
    one list of bounded length in each segment. Statistics of the collection are not baked in: blocks name the
    shortest document of each term frequency, from which block maxima follow once the average length is known.
    Documents without terms are left out; null ids are indexed as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count()
        name = lambda: f"{TaskContext.get().partitionId()}-{next(numbers)}"
        segment = Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                segment.add(doc_id, text)
                if segment.full():
                    yield segment.rows(name())
                    segment = Segment()
        if segment.ids:
            yield segment.rows(name())

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct rows (item, term), ids as text; texts that share an id make one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = [t.decode() for t in set(terms_of(text))]
                yield pa.record_batch([pa.array([item] * len(found), pa.string()), pa.array(found, pa.string())], names=["item", "term"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, term string").distinct()


class Norms(NamedTuple):
    """Documents with terms, and their terms with repeats."""

    docs: int
    terms: int

    def m(self, n):
        return 10 + (90 * n * self.docs) // self.terms


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class PostingList:
    """A term's list in a segment; blocks are decoded only when asked for, and all at once when most are."""

    def __init__(self, df: int, heads: bytes, docs: bytes, tfs: bytes, norms: Norms, m: np.ndarray):
        self.df, self.m = df, m
        self.heads = np.frombuffer(heads, HEAD)
        self.first, self.last = self.heads["first"].astype("i8"), self.heads["last"].astype("i8")
        self.gaps = np.frombuffer(docs, "u1" if len(docs) == df else "<u2")
        self.tfs = np.frombuffer(tfs, "u1" if len(tfs) == df else "<u4")
        n = self.heads["n"].astype("i8")
        tf = np.minimum(np.arange(1, CLASSES + 1), self.heads["tf"][:, None].astype("i8"))
        tf[:, -1] = self.heads["tf"]
        self.maxima = np.where(n == NONE, 0, impact(tf, norms.m(n))).max(1)
        self.top = int(self.maxima.max())
        self.whole = None

    def decoded(self) -> tuple[np.ndarray, np.ndarray]:
        """All documents of the list and their impacts."""
        if self.whole is None:
            doc = np.repeat(self.first, BLOCK)[: self.df] + self.gaps
            self.whole = doc, impact(self.tfs.astype("i8"), self.m[doc])
        return self.whole

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that may hold each document, or the number of blocks where none does."""
        at = np.searchsorted(self.last, docs)
        inside = at < len(self.last)
        inside[inside] = self.first[at[inside]] <= docs[inside]
        return np.where(inside, at, len(self.last))

    def impacts(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of documents by way of their blocks: only these are decoded."""
        out = np.zeros(len(docs), "i8")
        asked = np.flatnonzero(blocks < len(self.last))
        needed = np.unique(blocks[asked])
        if self.whole is not None or 2 * len(needed) >= len(self.last):
            doc, imp = self.decoded()
        else:
            at = (needed[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < self.df]
            doc = self.first[at // BLOCK] + self.gaps[at]
            imp = impact(self.tfs[at].astype("i8"), self.m[doc])
        if len(doc):
            place = np.minimum(np.searchsorted(doc, docs[asked]), len(doc) - 1)
            out[asked] = np.where(doc[place] == docs[asked], imp[place], 0)
        return out


class Heap:
    """The best ``k`` of an item so far: highest score first, then lowest id (null ids last)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must reach; ties may still win by their id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]


def exact(docs: np.ndarray, lists: list[tuple[int, PostingList]]) -> np.ndarray:
    return sum((w * p.impacts(docs, p.block_of(docs)) for w, p in lists), np.zeros(len(docs), "i8"))


def max_score(lists: list[tuple[int, PostingList]], n_docs: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment that score ``least`` or more, and their scores; may leave out documents that ``k`` others beat.

    Lists are put in order of their bound. The longest run of low bounds that together stay below what must be
    reached is non-essential: a document found only there can't get in. Candidates come from the essential lists;
    the block maxima of the non-essential ones, taken from block heads, reject candidates before a block of those
    lists is decoded, and exact impacts then replace maxima list by list, highest first.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].top)
    if least <= 1 and len(lists) > 1:  # nothing to reach yet: documents of the highest lists set it
        seeds = np.zeros(0, "i8")
        for _, p in reversed(lists):
            seeds = np.union1d(seeds, p.decoded()[0])
            if len(seeds) >= k:
                least = max(1, int(np.partition(exact(seeds, lists), -k)[-k]))
                break
    bounds = np.cumsum([w * p.top for w, p in lists])
    split = int(np.searchsorted(bounds, least))
    sums = np.zeros(n_docs, "i8")
    for w, p in lists[split:]:
        doc, imp = p.decoded()
        sums[doc] += w * imp
    found = np.flatnonzero(sums)
    score = sums[found]
    if split:
        stay = score + bounds[split - 1] >= least
        found, score = found[stay], score[stay]
        blocks = [p.block_of(found) for _, p in lists[:split]]
        maxima = [w * np.append(p.maxima, 0)[b] for (w, p), b in zip(lists, blocks, strict=False)]
        rest = sum(maxima)
        for i in reversed(range(split)):
            stay = np.flatnonzero(score + rest >= least)
            if len(stay) < len(found):
                found, score, rest = found[stay], score[stay], rest[stay]
                blocks, maxima = [b[stay] for b in blocks[: i + 1]], [x[stay] for x in maxima[: i + 1]]
            w, p = lists[i]
            score = score + w * p.impacts(found, blocks[i])
            rest = rest - maxima[i]
    stay = score >= least
    return found[stay], score[stay]


def search_segments(rows: Iterator[dict], items: list[tuple], norms: Norms, k: int) -> list[Heap]:
    """Heaps of all items over the segments that ``rows`` bring one after another, each beginning with its own row."""
    heaps = [Heap(k) for _ in items]
    for _, part in groupby(rows, key=lambda r: r["segment"]):
        own = next(part)
        ids = np.array([0 if i is None else i for i in own["ids"]], "i8")
        null = np.array([i is None for i in own["ids"]], bool)
        m = norms.m(np.array(own["lens"], "i8"))
        lists = {r["term"]: PostingList(r["df"], r["heads"], r["docs"], r["tfs"], norms, m) for r in part}
        for heap, (_, terms) in zip(heaps, items, strict=True):
            asked = [(w, lists[t]) for t, w in terms if t in lists]
            if asked:
                docs, scores = max_score(asked, len(ids), heap.least(), k)
                heap.add(scores, ids[docs], null[docs])
    return heaps


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", batch: int = BATCH_TERMS) -> DataFrame:
    """The ``k`` documents of ``index`` that score highest for each item, above 0: item, rank, doc_id, score.

    Items go to the tasks in batches of about ``batch`` terms (a bound on what is broadcast), each batch against all
    segments; a task keeps one heap an item over its segments, so what must be reached rises as it goes, and Spark
    merges the heaps. Only lists of asked terms are shuffled, as blocks, to bring a segment into one task.

    Equal scores go by ascending doc_id, null ids last; rows that repeat an id are ranked each. Items of one id are
    one item with all their terms; items without terms, or whose terms no document holds, give no row, and an empty
    table on either side gives an empty result. Other columns are not read.
    """
    spark = index.sparkSession
    wanted = written(query_terms(items, id_col, text_col))
    total = index.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    norms = Norms(int(total[0] or 0), int(total[1] or 0))
    dfs = index.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(norms.docs) + 2) / (2.0 * F.col("df") + 1)))
    weighted = written(wanted.join(dfs.select("term", weight.alias("w")), "term"))
    batches = -(-weighted.count() // batch)

    def searcher(asked):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps = search_segments((r for b in batches for r in b.to_pylist()), asked.value, norms, k)
            for (item, _), h in zip(asked.value, heaps, strict=True):
                yield pa.record_batch([pa.array([item] * len(h.ids), pa.string()), pa.array(h.ids, mask=h.null), pa.array(h.scores)], names=["item", "doc_id", "score"])

        return run

    merged = spark.createDataFrame([], "item string, doc_id long, score long")
    for b in range(batches):
        mine = weighted.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b)
        asked = mine.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms")).collect()
        sent = spark.sparkContext.broadcast([(r["item"], [(t["term"], t["w"]) for t in r["terms"]]) for r in asked])
        lists = index.join(mine.select("term").distinct(), "term", "left_semi").unionByName(index.where("term is null"))
        near = lists.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
        merged = merged.unionAll(written(near.mapInArrow(searcher(sent), merged.schema)))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(items.schema[id_col].dataType).alias(id_col), "rank", "doc_id", "score")
