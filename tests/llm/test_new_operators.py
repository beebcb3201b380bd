"""Conversation repair, URL filters and lexical search against brute force, with hard rows."""

import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import lexical, queries, repair, urlfilter

# conversation structure repair


def plain_repair(rows):
    """Faults, cost, audit and turns of (turn, role, text) rows in order, by one forward pass over (cost, audit) per state."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    best = {"": (0, "", ())}  # state: role initial of the last turn

    def add(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def inserted(states):
        for _ in range(3):
            for last, (cost, audit, turns) in list(states.items()):
                new = "a" if last == "u" else "u"
                add(states, new, (cost + 3, audit + "I", (*turns, ("user" if new == "u" else "assistant", ""))))
        return states

    for (_, role, text), fault, initial in zip(rows, faults, initials, strict=True):
        new = {}
        more = 3 * (fault == "truncated")
        for last, (cost, audit, turns) in inserted(best).items():
            add(new, last, (cost + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            following = "a" if last == "u" else "u"
            if initial == following or (initial == "s" and last == ""):
                add(new, initial, (cost + more, audit + "K", (*turns, (role, text))))
            add(new, following, (cost + 3 + more, audit + "R", (*turns, ("user" if following == "u" else "assistant", text))))
        best = new
    cost, audit, turns = min(way for state, way in inserted(best).items() if state in ("", "a"))
    turn = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    }


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def conversations():
    rng = np.random.default_rng(5)
    texts = ["Hello there.", "What now?", "no stop", "  ", "", None, "Yes!", "Same again.", "ends in space. \n", "line sep.\u2028", "x" * 20000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "human"]
    rows = []
    for conv in [*range(60), None]:
        size = int(rng.integers(1, 14)) if conv != 7 else 150
        for turn in range(size):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            text = texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"Turn {turn} of {conv}."
            rows.append((conv, None if rng.random() < 0.03 else int(turn + (rng.random() < 0.1)), role, text))
    rows += [rows[3]] * 3 + [(900, 5, "user", f"ordered {i}.") for i in range(1)] + [(901, None, "user", "A."), (901, None, "user", "A.")]
    keep = {}
    for r in rows:  # one role and text a turn, so that the order of rows is given; repeats stay
        keep.setdefault((r[0], r[1]), (r[2], r[3]))
    return [r for r in rows if keep[(r[0], r[1])] == (r[2], r[3])]


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_equals_a_plain_pass(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)).withColumn("conv", F.lit("x")).repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.asDict() for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = plain_damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        mine = sorted((r[1:] for r in hurt if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        assert {k: v for k, v in found.items() if k != "conv_id"} == plain_repair(mine), conv


def test_repair_of_nothing_and_of_one_repeated_row(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op11_conversation_repair(spark, str(tmp_path / "none")).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    fine = next(t for t in range(1000) if zlib.crc32(f"2:{t}".encode()) % 20 > 4)
    spark.createDataFrame([(1, dropped, "user", "Gone."), *[(2, fine, "user", "Often.")] * 500], schema).write.parquet(str(tmp_path / "some" / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, str(tmp_path / "some")).collect()}
    assert (got[1].audit, got[1].cost, got[1].repaired_sha256) == ("", 0, hashlib.sha256().hexdigest())
    assert (got[2].audit, got[2].cost, got[2].duplicate, got[2].illegal) == ("K" + "D" * 499 + "I", 4 * 499 + 3, 499, 499)


def test_a_fix_up_stops_where_vectors_differ_by_a_constant_and_keeps_the_costs():
    rng = np.random.default_rng(1)
    codes, extra = bytes(rng.integers(0, 12, 3000).tolist()), rng.integers(0, 2, 3000).tolist()
    true = repair.costs(codes, extra, repair.END)
    speculative = repair.costs(codes, extra, (0, 0, 0, 0))
    fixed = repair.costs(codes, extra, repair.END, speculative)
    assert (fixed["rel"] == true["rel"]).all() and (fixed["base"] == true["base"]).all()
    assert (speculative["rel"][:2900] == true["rel"][:2900]).all()


# URL filters

URLS = [
    "http://a.example.org/es/1", "http://example.org/en/17?x", "HTTP://WWW.Example.ORG/EN/1", "http://notexample.org/es/1", "http://x.com/fr/a#b", "http://x.com/de/a", "http://x.com",
    "no scheme", None, "", "://", "http://casino.net/a/?utm_source=x&b=2&a=1#t", "https://www.casino.net:443/a?a=1&b=2", "https://m.casino.net/a", "http://com/de/1", "http://.com/de/1",
    "http://É.com/de/", "http://x.net/" + "long/" * 5000, "x://y://casino.net/", "http://x.net/\nde", "http://bets.net", "http://bets.net/", "http://other.net/?ref=1",
]


def plain_verdict(url, listed):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, rule.name if rule else None, rule.verdict if rule else "block" if url in listed else "allow"


def test_url_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, *URLS[:3], *[URLS[11]] * 50])], "page_id long, url string, rule string").withColumn("_block", F.lit(3)).repartition(3)
    listed = spark.createDataFrame([("http://casino.net/a?b=2&a=1",), ("https://bets.net/",), (None,), ("nothing",), ("https://bets.net/",)], "url string")
    got = urlfilter.judge_urls(pages, listed, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "_block", "host", "path", "canonical", "rule", "verdict"]
    same = {URLS[11], URLS[12], "http://bets.net", "http://bets.net/"}
    rows = got.collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, same), r.url


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = urlfilter.PAGE * 16
    pages = urlfilter.bloom_filter(keys.where("id % 2 = 0"), "key", blocks)
    marked = urlfilter.with_possible(keys.withColumn("in", F.substring("key", -1, 1).isin(list("02468"))), pages, "key", blocks)
    n = {r["in"]: (r.possible, r.n) for r in marked.groupBy("in").agg(F.sum(F.col("_possible").cast("int")).alias("possible"), F.count(F.lit(1)).alias("n")).collect()}
    assert n[True][0] == n[True][1] == 10000
    assert n[False][0] < 10


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/b")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge_urls(pages, pages.limit(0), []).collect()] == ["allow"]
    assert urlfilter.judge_urls(pages.limit(0), pages, queries.URL_RULES).count() == 0


# ranked lexical search


def plain_search(docs, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: floor(1000 * log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "日本語", "Ünter"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 120)), p=p / p.sum()))) for i in range(1500)]
    docs += [(5000, "w1 " * 70000), (5001, None), (5002, " .,; "), (5003, ""), (None, "w7 w8 w9"), (None, "w7 w8 w9"), (3, docs[3][1]), (6000, "W5-w6_w7.W8"), *[(7000 + i, "w300 w301 w302") for i in range(300)]]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(25)] + [(90, "w300 w301"), (91, None), (92, "absent"), (93, "w0"), (93, "w5"), (94, docs[10][1]), (None, "w7 w8"), (95, "w1 W1 w1")]
    return docs, items


@pytest.mark.parametrize(("segment", "batch"), [(8192, 200_000), (150, 40)])
def test_search_equals_brute_force(spark, monkeypatch, segment, batch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("segment", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = lexical.search(lexical.build_index(table), asked, batch=batch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_search(docs, items)


def test_blocks_are_rejected_before_they_are_decoded():
    norms = lexical.Norms(4000, 400_000)
    segment = lexical.Segment()
    for i in range(4000):
        rare = b"rare " * 5 if i % 400 == 0 else b""
        segment.add(i, b"common " * (1 + i % 3) + rare + b"x " * 97)
    rows = segment.rows("s").to_pylist()
    m = norms.m(np.array(rows[0]["lens"], "i8"))
    lists = {r["term"]: lexical.PostingList(r["df"], r["heads"], r["docs"], r["tfs"], norms, m) for r in rows[1:]}
    docs, scores = lexical.max_score([(10, lists["common"]), (5000, lists["rare"])], 4000, 1, 10)
    assert sorted(docs.tolist()) == list(range(0, 4000, 400))
    assert lists["common"].whole is None  # ten of 32 blocks at most
    assert (scores == lexical.exact(docs, [(10, lists["common"]), (5000, lists["rare"])])).all()


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).count() == 0
