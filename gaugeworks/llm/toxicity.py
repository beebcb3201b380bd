"""Toxicity: support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold, written

LENGTH, SPAN, DECAY = 4, 8, 0.6  # of the subsequences: letters, letters from first to last at most, weight per letter spanned
LETTERS = 32
CUTS = (0.3, 0.6, 1.0)
N_FEATURES = len(CUTS) + 3
MAX_WORDS_KEPT = 300_000
BLOCK = 8192  # rows of a matrix product
_CODES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)} | {"é": 27, "è": 28, "ê": 29, "ç": 30} | dict.fromkeys("ñöäüßóíáúàâîôûùëïœæ", 31)
_TABLE = {i: chr(_CODES.get(chr(i).lower(), 0)) for i in range(0x250)}
_OFFSETS = [(a, b, c) for a, b, c in combinations(range(1, SPAN), LENGTH - 1)]
_SENTENCE = re.compile(r"[.!?\n]+\s*")
_SPELLED = re.compile(r"(?<=\b[^\W\d_])[ \t]+(?=[^\W\d_]\b)")  # the gap between two single letters


def tokens(text: str | None) -> list[str]:
    """Lower-cased words between white space; letters spelled one by one are joined."""
    return _SPELLED.sub("", (text or "").lower()).split()


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all words on end (0 for other characters), the word number of each letter, word starts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    joined = "".join(words).translate(_TABLE)
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c[c >= LETTERS] = 0
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.empty(0, np.int64)
    return c, np.repeat(np.arange(len(words)), lengths), starts


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word numbers, feature numbers, weight) of all subsequences of LENGTH letters that span at most SPAN letters.

    The kernel of two words is the sum over features of the products of their weights, DECAY to the letters spanned.
    """
    c, owner, _ = codes(words)
    for off in _OFFSETS:
        last = off[-1]
        if len(c) <= last:
            continue
        n = len(c) - last
        feature = c[:n]
        ok = (c[:n] > 0) & (owner[:n] == owner[last:])
        for o in off:
            part = c[o : o + n]
            feature = feature * LETTERS + part
            ok &= part > 0
        at = np.flatnonzero(ok)
        yield owner[at], feature[at], DECAY ** (last + 1 - LENGTH)


class Scorer:
    """f(word) = sum of landmark weights times kernels, folded into one weight per feature; a document's score from its words."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)
        grid = self.weights.reshape((LETTERS,) * LENGTH)
        grid[0], grid[:, 0], grid[:, :, 0], grid[..., 0] = 0, 0, 0, 0
        self.final = np.zeros(N_FEATURES)
        self.seen: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum over a word's subsequences of DECAY to the letters skipped times the feature's weight.

        Words stand SPAN - 1 blanks apart, and features with a blank weigh nothing, so none reaches over two words.
        """
        if not words:
            return np.zeros(0)
        blank = "\0" * (SPAN - 1)
        c = np.frombuffer((blank.join(words) + blank).translate(_TABLE).encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
        c[c >= LETTERS] = 0
        n = len(c) - SPAN + 1
        shifted = [c[: len(c)] * LETTERS**k for k in range(LENGTH)]
        total = np.zeros(n + SPAN - 1, np.float32)
        for last in range(LENGTH - 1, SPAN):
            part = np.zeros(n, np.float32)
            for a, b, z in _OFFSETS:
                if z == last:
                    part += self.weights[shifted[3][:n] + shifted[2][a : a + n] + shifted[1][b : b + n] + shifted[0][z : z + n]]
            total[:n] += part * np.float32(DECAY ** (last + 1 - LENGTH))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + SPAN - 1
        return np.add.reduceat(total, np.concatenate([[0], np.cumsum(lengths)[:-1]]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > MAX_WORDS_KEPT:
            self.seen.clear()
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.seen.update(zip(part, self.word_scores(part).tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: 1, words per hundred that score over each of CUTS (up to 4), mean of the three largest scores, log words."""
        words = [tokens(t) for t in texts]
        out = np.zeros((len(texts), N_FEATURES))
        out[:, 0] = 1
        for i, ws in enumerate(words):
            if not ws:
                continue
            f = []
            for j in range(0, len(ws), 100_000):
                part = ws[j : j + 100_000]
                self.learn(set(part))
                f += [self.seen[w] for w in part]
            f = np.array(f)
            top = np.partition(f, -3)[-3:] if len(f) > 3 else f
            out[i, 1 : 1 + len(CUTS)] = [min(4.0, 100 * (f > c).mean()) for c in CUTS]
            out[i, -2:] = np.clip(top, 0, 2).sum() / 3, np.log1p(len(ws)) / 5
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.final, -50, 50)))


def frequent_grams(texts: list[set[str]], least: int, low: int = 4, high: int = 8) -> Counter:
    """Letter strings and the number of texts that hold them, at least ``least``; longer ones grow from frequent shorter ones."""
    found: Counter = Counter()
    shorter: set[str] = set()
    for n in range(low, high + 1):
        level: Counter = Counter()
        for ws in texts:
            level.update({g for w in ws for i in range(len(w) - n + 1) if n == low or (w[i : i + n - 1] in shorter and w[i + 1 : i + n] in shorter) for g in (w[i : i + n],)})
        shorter = {g for g, k in level.items() if k >= least}
        found.update({g: level[g] for g in shorter})
    return found


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """Letter strings far commoner in toxic texts, no two with a normalised kernel over 1/2, then common clean words."""
    count = frequent_grams(toxic, max(3, len(toxic) // 100))
    wanted = {g for g in count if g.isalpha()}
    sizes = sorted({len(g) for g in wanted})
    other: Counter = Counter()
    for ws in clean:
        other.update({g for w in ws for n in sizes for i in range(len(w) - n + 1) for g in (w[i : i + n],) if g in wanted})
    a, b = len(toxic) + 1, len(clean) + 1

    def z(g: str) -> float:
        p, q = count[g] / a, other[g] / b
        return (p - q) / np.sqrt((p + 1 / a) / a + (q + 1 / b) / b)

    ranked = sorted(((z(g), len(g), g) for g in wanted), key=lambda x: (-round(x[0], 2), -x[1], x[2]))
    kept: list[str] = []
    taken: list[dict[int, float]] = []
    for value, _, g in ranked[: 40 * most]:
        if len(kept) >= most or value < 3:
            break
        own: dict[int, float] = {}
        for _, feature, weight in subsequences([g]):
            for f in feature.tolist():
                own[f] = own.get(f, 0.0) + weight
        norm = sum(v * v for v in own.values()) ** 0.5
        own = {f: v / norm for f, v in own.items()}
        if own and not any(sum(v * t.get(f, 0.0) for f, v in own.items()) > 0.5 for t in taken):
            kept.append(g)
            taken.append(own)
    common = Counter(w for ws in clean for w in ws if w.isalpha() and len(w) >= LENGTH)
    return kept + [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:most]]


def fit_svm(x: np.ndarray, y: np.ndarray, use: np.ndarray, cost: float = 10.0, steps: int = 30) -> np.ndarray:
    """Primal support vector machine with squared hinge loss, classes weighed alike, by Newton steps; last weight: bias.

    Learns from the rows ``use``, a block at a time, so that ``x`` is never copied.
    """
    weight = np.where(y > 0, 0.5 / max(1, (use & (y > 0)).sum()), 0.5 / max(1, (use & (y <= 0)).sum())) * cost
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        gram, right = np.eye(len(w)) * 1e-2, np.zeros(len(w))
        for i in range(0, len(x), BLOCK):
            yb, wb = y[i : i + BLOCK], weight[i : i + BLOCK]
            xb = np.hstack([x[i : i + BLOCK], np.ones((len(yb), 1))])
            active = use[i : i + BLOCK] & (yb * (xb @ w) < 1)
            xa, wa = xb[active], wb[active]
            gram += (xa * wa[:, None]).T @ xa
            right += (xa * (wa * yb[active])[:, None]).sum(0)
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Landmarks:
    """Landmarks chosen from texts (their sets of words); kernels of sentences with them.

    The kernel of two sentences is the sum of the kernels of their words. Nystroem: with landmark kernel matrix K,
    a sentence is K^-1/2 times its kernels with the landmarks.
    """

    def __init__(self, words: list[set[str]], labels: list[int], most: int = 64):
        self.marks = choose_landmarks([w for w, y in zip(words, labels, strict=True) if y], [w for w, y in zip(words, labels, strict=True) if not y], most)
        column: dict[int, int] = {}
        rows, cols, values = [], [], []
        for owner, feature, weight in subsequences(self.marks):
            for o, f in zip(owner.tolist(), feature.tolist(), strict=True):
                rows.append(o)
                cols.append(column.setdefault(f, len(column)))
                values.append(weight)
        self.features = list(column)
        self.table = np.zeros((len(column), len(self.marks)))
        np.add.at(self.table, (cols, rows), values)
        self.table /= np.sqrt((self.table**2).sum(0)) + 1e-12

    def whiten(self) -> np.ndarray:
        val, vec = np.linalg.eigh(self.table.T @ self.table + 1e-3 * np.eye(len(self.marks)))
        return (vec / np.sqrt(val)) @ vec.T

    def where(self) -> np.ndarray:
        at = np.full(LETTERS**LENGTH, -1, np.int32)
        at[self.features] = np.arange(len(self.features))
        return at

    def kernels(self, sentences: list[list[str]], where: np.ndarray) -> np.ndarray:
        """Kernels of sentences (lists of words) with the landmarks."""
        slim = self.table.astype(np.float32)
        x = np.zeros((len(sentences), len(self.marks)), np.float32)
        distinct = sorted({w for ws in sentences for w in ws})
        number = {w: i for i, w in enumerate(distinct)}
        per_word = np.zeros((len(distinct), len(self.marks)), np.float32)
        for own, feature, weight in subsequences(distinct):
            at = where[feature]
            hit = at >= 0
            own = own[hit]
            starts = np.flatnonzero(np.diff(own, prepend=-1))  # letters of a word stand together
            if len(starts):
                per_word[own[starts]] += np.add.reduceat(slim[at[hit]], starts, axis=0) * np.float32(weight)
        for i, ws in enumerate(sentences):
            x[i] = per_word[[number[w] for w in ws]].sum(0)
        return x


def sentence_kernels(train: DataFrame, marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K^-1/2 times the kernels of every sentence of ``train`` (_k, _h, _y, _text), its text's number, its label as 1 or -1.

    Tasks split whole texts into sentences and write the small vectors, which the driver reads one partition at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, whiten = marks.where(), marks.whiten().astype(np.float32)

        def block(found: list[tuple]) -> pd.DataFrame:
            at = np.array([x[:3] for x in found], np.int64)
            return pd.DataFrame({"n": [len(at)], "at": [at.tobytes()], "x": [(marks.kernels([x[3] for x in found], where) @ whiten).tobytes()]})

        for pdf in batches:
            found: list[tuple] = []
            for k, h, y, text in zip(pdf["_k"], pdf["_h"], pdf["_y"], pdf["_text"], strict=True):
                for s in _SENTENCE.split(text or ""):
                    if ws := tokens(s):
                        found.append((k, h, y, ws))
                    if len(found) >= 2000:
                        yield block(found)
                        found = []
            if found:
                yield block(found)

    blocks = written(train.mapInPandas(run, "n long, at binary, x binary"))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    at, x, end = np.empty((n, 3), np.int64), np.empty((n, len(marks.marks)), np.float32), 0
    for r in blocks.toLocalIterator():
        at[end : end + r["n"]] = np.frombuffer(r["at"], np.int64).reshape(-1, 3)
        x[end : end + r["n"]] = np.frombuffer(r["x"], np.float32).reshape(-1, x.shape[1])
        end += r["n"]
    owner = np.unique(at[:, :2], axis=0, return_inverse=True)[1].ravel()
    return x, owner, np.where(at[:, 2] > 0, 1, -1)


def fit_words(train: DataFrame, marks: Landmarks, rounds: int = 3) -> np.ndarray:
    """Feature weights from all sentences of ``train``, which carry their document's label.

    After the first round a toxic document keeps only its best-scoring sentences as positives, as most of its
    sentences hold no insult.
    """
    weights = np.zeros(LETTERS**LENGTH, np.float32)
    if not marks.marks:
        return weights
    x, owner, y = sentence_kernels(train, marks)
    use = np.ones(len(y), bool)
    for _ in range(rounds):
        w = fit_svm(x, y, use)
        s = x @ w[:-1].astype(np.float32)
        best = np.full(len(y), -np.inf, np.float32)
        np.maximum.at(best, owner, s)
        use = (y < 0) | (s >= best[owner]) | (s + w[-1] > 1)
    weights[marks.features] = marks.table @ (marks.whiten() @ w[:-1])
    return weights


def text_words(train: DataFrame) -> list[tuple[int, int, set[str]]]:
    """(_k, _y, set of words) of every text of ``train``, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["_k", "_h", "_y"]].assign(words=[" ".join(sorted(set(tokens(t)))) for t in pdf["_text"]])

    rows = train.mapInPandas(run, "_k long, _h long, _y int, words string").collect()
    return [(r["_k"], r["_y"], set(map(sys.intern, r["words"].split()))) for r in sorted(rows, key=lambda r: (r["_k"], r["_h"]))]


def text_features(train: DataFrame, scorers: list[Scorer]) -> tuple[np.ndarray, np.ndarray]:
    """Document features of whole texts by the scorer of the other half, and labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, part in pdf.groupby(pdf["_k"] % 2):
                yield part[["_k", "_h", "_y"]].assign(x=list(scorers[1 - k].features(list(part["_text"]))))

    rows = sorted(train.mapInPandas(run, "_k long, _h long, _y int, x array<double>").collect(), key=lambda r: (r["_k"], r["_h"]))
    return np.array([r["x"] for r in rows]), np.array([r["_y"] for r in rows])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, held: int = 0, max_train: int = 3000,
) -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``, from whole texts alone.

    Learns from at most ``max_train`` labelled rows outside fold ``held`` (half of them toxic where there are as
    many; those whose id hashes lowest), each read whole: tasks turn texts into sets of words, kernels of sentences
    and document features, and the driver fits these. Rows that repeat id and text count once there, and the bound holds
    for rows, however many bear one id; ties of the id's hash go by id. Other columns are not read, and an empty table of
    documents gives an empty result. Null and empty texts are scored like texts without words. Repeated rows get equal scores. Without
    labels of both kinds every score is the share of toxic labels.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    )
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(max_train // 2).collect() for y in (0, 1)]
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    sample = sorted((r[0], r[1]) for part in chosen for r in part)
    sample = docs.sparkSession.createDataFrame([(k, i, y) for k, (i, y) in enumerate(sample)], "_k long, _id long, _y int")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    train = written(bounded_rows(written(texts.withColumn("_h", F.xxhash64("_text"))), max_train).select("_k", "_h", "_y", "_text"))
    texts = text_words(train)
    y = [t[1] for t in texts]
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(set(y)) < 2:
        scorer = Scorer(np.zeros(LETTERS**LENGTH))
        scorer.final[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
    else:
        # The step from words to documents learns from halves whose words were weighed without them.
        marks = [Landmarks([t[2] for t in own], [t[1] for t in own]) for own in ([t for t in texts if t[0] % 2 == 0], [t for t in texts if t[0] % 2], texts)]
        del texts
        parts = [Scorer(fit_words(train.where(F.col("_k") % 2 == half), marks[half])) for half in (0, 1)]
        scorer = Scorer(fit_words(train, marks[2]))
        scorer.final = fit_logistic(*text_features(train, parts))
        scorer.final[0] += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(max(1, sum(y)) / max(1, len(y) - sum(y)))
        scorer.seen = {}

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in columns:
            got = [scorer.score(list(part[i : i + 256])) for i in range(0, len(part), 256)]
            yield pd.Series(np.concatenate(got) if got else np.zeros(0))

    return docs.select(
        F.col(id_col), (fold(id_col, folds) == held).alias("held_out"), score(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
