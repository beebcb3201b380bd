"""Chat formatting: schema fingerprints select mappings to canonical turns; a reversible template marks turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strings that chat templates reserve.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *sorted(CONTROL, key=len, reverse=True)))))
_UNESCAPE = re.compile(r"\\(\\?)")
_UNESCAPE_ROLE = re.compile(r"\\(\\|n|)")
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>\n", re.S)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}

# Declarative mappings: the fields of a layout, and for each turn a role (fixed, or a field) and the fields of its text.
# "[]" stands for the items of a list. Absent optional fields are allowed by listing both layouts.
MAPPINGS: list[tuple[tuple[str, ...], list[tuple[str, tuple[str, ...]]]]] = [
    (("role", "text"), [("@role", ("text",))]),
    (("messages[].role", "messages[].content"), [("@messages[].role", ("messages[].content",))]),
    (("conversations[].from", "conversations[].value"), [("@conversations[].from", ("conversations[].value",))]),
    (("system", "conversations[].from", "conversations[].value"), [("system", ("system",)), ("@conversations[].from", ("conversations[].value",))]),
    (("prompt", "completion"), [("user", ("prompt",)), ("assistant", ("completion",))]),
    (("prompt", "response"), [("user", ("prompt",)), ("assistant", ("response",))]),
    (("question", "answer"), [("user", ("question",)), ("assistant", ("answer",))]),
    (("instruction", "output"), [("user", ("instruction",)), ("assistant", ("output",))]),
    (("instruction", "input", "output"), [("user", ("instruction", "input")), ("assistant", ("output",))]),
    (("system", "prompt", "completion"), [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))]),
]


def fingerprint(paths) -> str:
    """Hash of the sorted nested field paths: equal for records of one layout, whatever their values and order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


TABLE = {fingerprint(paths): turns for paths, turns in MAPPINGS}


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, at + "[]")}
    return {at}


def values_at(value, path: str) -> list:
    """Values of a path, one for each list item on the way; None where a field is missing."""
    found = [value]
    for part in path.split("."):
        name, many = part.removesuffix("[]"), part.endswith("[]")
        found = [x.get(name) if isinstance(x, dict) else None for x in found]
        if many:
            found = [y for x in found if isinstance(x, list) for y in x]
    return found


def canonical(record) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a decoded record, by the mapping of its fingerprint; None for an unknown layout."""
    mapping = TABLE.get(fingerprint(field_paths(record)))
    if mapping is None:
        return None
    turns = []
    for role, fields in mapping:
        texts = [values_at(record, f) for f in fields]
        roles = values_at(record, role[1:]) if role[0] == "@" else [role] * len(texts[0])
        for r, *parts in zip(roles, *texts, strict=False):
            kept = ["" if p is None else str(p) for p in parts]
            named = ROLES.get(r, r) if role.endswith(".from") else r  # only this layout has names of its own for the roles
            turns.append((named or "", "\n".join([kept[0], *(p for p in kept[1:] if p)])))
    return turns


def escape(text: str) -> str:
    """No control string is left in the result: a backslash goes into each, backslashes are doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the start and end of its loss mask in it (empty unless the role is assistant)."""
    head = f"<s>{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    end = len(head) + len(body)
    return f"{head}{body}</s>\n", len(head) if role == "assistant" else end, end


def read_back(formatted: str) -> list[tuple[str, str]]:
    role = lambda m: "\n" if m[1] == "n" else m[1]
    return [(_UNESCAPE_ROLE.sub(role, r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_chats(records: DataFrame, key: str, order: str, record: str) -> DataFrame:
    """Turns of JSON records: key, layout, role, formatted, loss_start, loss_end; rows of a key stand together, in order.

    A record holds a conversation or one turn of it; records of a key are put in order of ``order``, then of
    their text. Rows of one key meet in one task but pass through it one at a time, sorted by Spark. Records of
    unknown layout and broken JSON give one row with a null role, the layout's fingerprint (or "broken") and
    the record itself, unformatted. A null key is a key of its own, null orders come first, repeated records are turns
    of their own; texts of any length are formatted whole. Other columns are not read, and an empty table gives
    an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, raw in zip(pdf["key"], pdf["record"], strict=True):
                try:
                    value = json.loads(raw)
                    layout, turns = fingerprint(field_paths(value)), canonical(value)
                except (TypeError, ValueError):
                    layout, turns = "broken", None
                if turns is None:
                    out.append((k, layout, None, raw, 0, 0))
                else:
                    out += [(k, layout, role, *format_turn(role, text)) for role, text in turns]
            yield pd.DataFrame(out, columns=["key", "layout", "role", "formatted", "loss_start", "loss_end"]).astype({"key": "Int64"})

    rows = records.select(F.col(key).cast("long").alias("key"), F.col(order).alias("_order"), F.col(record).alias("record"))
    near = rows.repartition("key").sortWithinPartitions("key", "_order", "record")
    return near.mapInPandas(run, "key long, layout string, role string, formatted string, loss_start long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted turns as ``format_chats`` orders them, read back from the output."""

    class Sum:
        def __init__(self, key):
            self.key, self.n, self.loss, self.chars = key, 0, 0, 0
            self.turns, self.said = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted: str, start: int, end: int) -> None:
            for role, text in read_back(formatted):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            masked = unescape(formatted[start:end])
            self.loss += len(masked)
            self.said.update(masked.encode("utf-8", "replace"))
            self.chars += len(formatted)

        def row(self) -> tuple:
            return (None if pd.isna(self.key) else int(self.key), self.n, self.turns.hexdigest(), self.loss, self.said.hexdigest(), self.chars)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            out = []
            for key, formatted, start, end in pdf[["key", "formatted", "loss_start", "loss_end"]].itertuples(index=False):
                same = now is not None and (now.key == key or (pd.isna(now.key) and pd.isna(key)))
                if not same:
                    if now is not None:
                        out.append(now.row())
                    now = Sum(key)
                now.add(formatted or "", int(start), int(end))
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names).astype({"conv_id": "Int64"})

    return turns.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as JSON records, null roles and texts as empty: by the conversation's hash in the turn
    layout or as a list of one message, so that records of two layouts meet in one table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.to_json(F.struct(role.alias("role"), text.alias("text")))
    message = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    return conversations.select("conv_id", "turn", F.when(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, turn).otherwise(message).alias("record"))
