"""SentencePiece encoding and decoding by a streaming Viterbi pass over piece boundaries."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK = SPACE.encode()
UNIGRAM, BPE = 1, 2  # fixed values of the model format
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # fixed values of the model format: kinds of piece
MAX_WORDS, MAX_PAIRS, MAX_HEADS = 1_000_000, 200_000, 150_000  # remembered in a worker, some 300 MB
TAIL = 4  # last characters that name the pieces which can end there
HEAD = 6  # first characters of a stretch whose window state is remembered


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = raw[i]
            i += 1
            value |= (x & 127) << shift
            if x < 128:
                return value
            shift += 7

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, raw[i : i + n]
        i += n


class Remembered(dict):
    """Ids of short stretches as 32-bit numbers, made by ``window`` when first asked for; what was not used lately goes."""

    def __init__(self, window: Callable[[str], list[int]]):
        self.window, self.older = window, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = array("i", self.window(stretch)).tobytes()
        if len(stretch) <= 32:
            if len(self) >= MAX_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def __reduce__(self):
        return Remembered, (self.window,)


class Model:
    """Pieces, scores and flags of a SentencePiece model file, and the segmentation itself."""

    def __init__(self, raw: bytes):
        self.name = hashlib.sha256(raw).hexdigest()
        self.pieces, self.scores, self.kinds = [], [], []
        self.kind, self.dummy_prefix, self.strip_spaces = UNIGRAM, True, True
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got[1].decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                if got.get(2):
                    raise ValueError("models with a character map are not supported")
                self.dummy_prefix, self.strip_spaces = bool(got.get(3, 1)), bool(got.get(4, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.raw_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.unknown = self.kinds.index(UNKNOWN)
        self.width = max(map(len, self.ids), default=1)
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        inner = [p for p in self.ids if SPACE in p[1:] and p.strip(SPACE)]
        # A boundary that no piece goes over is one that every path passes. Where pieces hold spaces at their start only,
        # such are the starts of runs of spaces, and places between a letter and a mark that follows a letter in no piece.
        self.sure = not inner
        after = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        marks = "".join(re.escape(c) for c in ".,;:!?\n\"')(]-" if c not in after)
        letters = f"{SPACE}*[^\\W\\d_]+(?=[{marks}{SPACE}]|\\Z)|" if marks else ""
        self.stretch = re.compile(f"{letters}{SPACE}*[^{SPACE}]+|{SPACE}+" if self.sure else "(?s).+")
        self.past: dict[str, tuple] = {}
        self.usable = {p: i for p, i in self.ids.items() if self.kind == BPE and self.whole(p)}
        self.past.clear()
        # The lengths of usable pieces that are longer than TAIL, by their last characters, longest first.
        reach: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > TAIL:
                reach.setdefault(p[-TAIL:], set()).add(len(p))
        self.reach = {end: tuple(sorted(n, reverse=True)) for end, n in reach.items()}
        self.tails: dict[str, tuple[tuple, ...]] = {}
        self.near: dict[int, dict[int, bool]] = defaultdict(dict)  # by the later piece, then the earlier one
        self.pairs = 0
        self.heads: dict[str, tuple[int, ...]] = {}
        self.known = Remembered(self.window)
        self.commits, self.widest = 0, 0  # of the window, for tests

    def history(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """BPE on ``piece`` alone, best-scoring adjacent merge first, leftmost at ties: scores of the merges, the
        first and last part before each merge and at the end, and whether the result is the piece whole."""
        got = self.past.get(piece)
        if got is not None:
            return got
        parts = list(piece)
        made, left, right = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made.append(best)
            left.append(parts[0])
            right.append(parts[-1])
        got = self.past[piece] = (made, left, right, len(parts) == 1)
        return got

    def apart(self, before: str, piece: str) -> bool:
        """Whether BPE keeps ``before`` and ``piece`` apart, each whole, when they stand side by side.

        Replays both merge sequences in order of score and looks whether a merge over the border comes first.
        """
        made_a, _, ends, _ = self.history(before)
        made_b, starts, _, _ = self.history(piece)
        i = j = 0
        na, nb = len(made_a), len(made_b)
        while True:
            k = self.ids.get(ends[i] + starts[j])
            if k is not None:
                over = self.scores[k]
                if (i == na or over > made_a[i]) and (j == nb or over >= made_b[j]):
                    return False
            if i == na and j == nb:
                return True
            if j == nb or (i < na and made_a[i] >= made_b[j]):
                i += 1
            else:
                j += 1

    def whole(self, piece: str) -> bool:
        return self.history(piece)[3]

    def outside(self, piece: str) -> list[int]:
        """Ids of a character outside the vocabulary: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def by_score(self, text: str, i: int, end: int, base: int, last: list[int], back: list[int], score: list[float]) -> None:
        """Backpointers of the positions from ``i`` up to ``end``, for unigram models: the best-scoring path."""
        for i in range(i, end):
            start, piece, top = i - 1, -1, score[i - 1 - base] + self.least
            for j in range(max(base, i - self.width), i):
                k = self.ids.get(text[j:i])
                if k is not None and score[j - base] + self.scores[k] > top:
                    start, piece, top = j, k, score[j - base] + self.scores[k]
            last.append(piece)
            back.append(start)
            score.append(top)

    def endings(self, tail: str) -> tuple[tuple, ...]:
        """Lengths of usable pieces that can end in ``tail``, longest first; those no longer than the tail with their ids."""
        found = [(n, -1) for n in self.reach.get(tail, ())]
        found += [(n, self.usable[tail[-n:]]) for n in range(len(tail), 0, -1) if tail[-n:] in self.usable]
        if len(self.tails) >= MAX_HEADS:
            self.tails.clear()
        self.tails[tail] = tuple(found)
        return self.tails[tail]

    def by_merges(self, text: str, i: int, end: int, base: int, last: list[int], back: list[int]) -> None:
        """Backpointers of the positions from ``i`` up to ``end``, for BPE models: the longest piece that BPE keeps apart from the one before."""
        usable, tails, near = self.usable.get, self.tails.get, self.near
        for i in range(i, end):
            tail = text[i - TAIL : i] if i > TAIL else text[:i]
            for n, k in tails(tail) or self.endings(tail):
                j = i - n
                if j < base:
                    continue
                if k < 0:
                    k = usable(text[j:i], -1)
                    if k < 0:
                        continue
                before = last[j - base]
                if before < 0:
                    break
                ok = near[k].get(before)
                if ok is None:
                    ok = self.apart(self.pieces[before], self.pieces[k])
                    if self.pairs < MAX_PAIRS:
                        self.pairs += 1
                        near[k][before] = ok
                if ok:
                    break
            else:  # an unknown character
                j, k = i - 1, -1
            last.append(k)
            back.append(j)

    def window(self, text: str) -> list[int]:
        """Ids of a stretch of text, committed from left to right.

        Each position keeps one backpointer, to the start of the piece that ends there. For BPE models the last piece
        of a prefix is unique: it is the one that BPE keeps apart from the last piece of the prefix before it, so
        the same pass gives the ids of BPE. A piece is at most ``width`` long, so only the last ``width`` positions
        can start more pieces. Whenever the window has grown past twice that, the paths back from these positions
        are followed until they meet: what lies before the meeting point is final and leaves the window. At the
        end one path survives. Stretches with the same first characters share the window's state behind them.
        """
        width, n, out = self.width, len(text), []
        base, last, back, score = 0, [-1], [0], [0.0]  # -1: nothing before, or an unknown character, which merges with nothing
        bpe = self.kind == BPE
        if bpe and n > HEAD:
            state = self.heads.get(text[:HEAD])
            if state is None:
                self.by_merges(text, 1, HEAD + 1, 0, last, back)
                if len(self.heads) >= MAX_HEADS:
                    self.heads.clear()
                self.heads[text[:HEAD]] = (*last, *back)
            else:
                last, back = list(state[: HEAD + 1]), list(state[HEAD + 1 :])
        while len(last) + base <= n:
            i = len(last) + base
            end = min(i + width, n + 1)
            if bpe:
                self.by_merges(text, i, end, base, last, back)
            else:
                self.by_score(text, i, end, base, last, back, score)
            if end - base > 2 * width:
                meet = self.meeting(end - 1, base, back)
                if meet > base:
                    out += self.path(text, base, meet, last, back)
                    self.widest = max(self.widest, end - 1 - base)
                    del last[: meet - base], back[: meet - base], score[: meet - base]
                    base = meet
                    self.commits += 1
        return out + self.path(text, base, n, last, back)

    def meeting(self, i: int, base: int, back: list[int]) -> int:
        """Where the paths back from the last ``width`` positions up to ``i`` meet."""
        alive = set(range(i - self.width + 1, i + 1))
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            alive.add(back[far - base])
        return alive.pop()

    def path(self, text: str, base: int, end: int, last: list[int], back: list[int]) -> list[int]:
        out: list[int] = []
        while end > base:
            k = last[end - base]
            if k >= 0:
                out.append(k)
            else:
                out.extend(reversed(self.outside(text[end - 1])))
            end = back[end - base]
        return out[::-1]

    def stream(self, text: str) -> np.ndarray:
        """Ids of ``text`` from left to right. At a boundary that every path passes the window is empty: what follows up
        to the next such boundary depends on nothing before, and is remembered if it is short."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.stretch.findall(text) if self.sure else [text])), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of(text).tolist()

    def ids_of(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.strip_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return np.zeros(0, np.int32)
        if self.dummy_prefix:
            text = " " + text
        out = self.stream(text.replace(" ", SPACE))
        if not self.bytes:  # neighbouring unknown characters are one unknown piece
            out = out[(out != self.unknown) | (np.append(-1, out[:-1]) != self.unknown)]
        return out

    def decode(self, ids) -> str:
        """Text of ``ids``; bytes that are no UTF-8 become replacement characters, control pieces nothing."""
        return self.raw_text(ids).decode("utf-8", "replace")

    def raw_text(self, ids) -> bytes:
        raw = b"".join(map(self.raw_of.__getitem__, ids))
        if MARK in raw:  # spelled in bytes
            raw = raw.replace(MARK, b" ")
        return raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw


def _raw(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_KEPT: dict[str, Model] = {}


def kept(model: Model) -> Model:
    """One model of its kind stays in a worker, with the words it remembers."""
    found = _KEPT.get(model.name)
    if found is None:
        _KEPT.clear()
        found = _KEPT[model.name] = model
    return found


def encode(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, decoded_sha256, round_trip for every row of ``docs``.

    Null and empty texts give no ids; an empty table gives an empty result; other columns are not read. A text's ids
    follow from its model alone: where pieces tie in score the leftmost merge is first. round_trip says whether decoding the ids gives the text back: false only
    for texts that hold the space mark U+2581 itself. Rows are independent: repeated rows give equal results.
    The vocabulary (a fixed file of under 1 MB) goes to the tasks with the job; remembered words are bounded.
    """
    sent = Model(_raw(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kept(sent)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                out = []
                for doc, text in zip(part["id"], part["_text"], strict=True):
                    ids = model.ids_of(text)
                    raw = model.raw_text(ids.tolist())
                    back = raw.decode("utf-8", "replace")
                    same = back == (text or "")
                    digest = hashlib.sha256(raw if same else back.encode("utf-8", "replace")).hexdigest()
                    out.append((doc, ids, len(ids), digest, same))
                yield pd.DataFrame(out, columns=["id", "ids", "n_tokens", "decoded_sha256", "round_trip"]).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text`` read back from its ids; null ids give an empty text."""
    model = Model(_raw(model_path))

    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in columns:
            yield pd.Series([model.decode(x if x is not None else ()) for x in ids], dtype=object)

    return encoded.withColumn("text", run(F.col(ids_col)))
