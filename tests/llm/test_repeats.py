"""Rows that repeat: a table read twice, one id on many rows, roles that are no usual ones."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.llm import chat, common, covertree, exact, quality, setsketch, tagpaths, toxicity

DOCS = "doc_id long, text string, lang string"


def texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rng.choice(words, 90))
    near = base.split()
    near[40] = "other"
    return [base, base, " ".join(near), None, "", *(" ".join(rng.choice(words, 70)) for _ in range(20))]


def plain(df):
    return sorted((str(r.doc_id), str(r.text), str(r.lang)) for r in df.collect())


def test_a_table_read_twice_leaves_what_it_leaves_read_once(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts())] + [(None, "no id", None), (3, "again", "fr")], DOCS).repartition(3)
    twice = docs.unionAll(docs)
    for drop in (exact.drop_copies, setsketch.drop_near_copies):
        once = plain(drop(docs))
        assert len(once) == len(set(once)) and plain(drop(twice)) == once


def test_of_rows_with_one_id_and_text_the_least_stays(spark):
    rows = [(1, "a", "fr"), (1, "a", "de"), (1, None, "x"), (1, "", "w"), (1, "b", "en"), (None, "a", "z"), (None, "a", "y")]
    got = plain(common.one_of_each(spark.createDataFrame(rows, DOCS), "doc_id", "text"))
    assert [g[2] for g in sorted(got, key=lambda g: g[2])] == ["de", "en", "x", "y"]  # null text sorts before an empty one


def test_training_rows_are_bounded_however_many_bear_one_id(spark, monkeypatch):
    good, bad = "A calm and useful sentence about rivers. " * 3, "you idiot fool!!! "
    rows = [(7, f"{good}{i % 300}", "en") for i in range(900)] + [(i, good if i % 2 else bad, "en") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(7, 1, 0)] + [(i, i % 2, 1 - i % 2) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    seen = {}
    fit = quality.fit_ranker
    monkeypatch.setattr(quality, "fit_ranker", lambda x, y, **k: (seen.setdefault("op9", len(x)), fit(x, y, **k))[1])
    words = toxicity.text_words
    monkeypatch.setattr(toxicity, "text_words", lambda train: (lambda got: (seen.setdefault("op1", len(got)), got)[1])(words(train)))
    assert quality.quality_scores(docs, labels, max_train=10).count() == len(rows)
    assert toxicity.toxicity_scores(docs, labels, max_train=10).count() == len(rows)
    assert 0 < seen["op9"] <= 10 and 0 < seen["op1"] <= 10


def test_roles_stay_as_they_are_and_may_hold_line_ends(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "line\nend\\n\\", "c\nd"), (2, 1, "assistant", "</s>[INST]"), (3, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.conversation_records(df), "conv_id", "turn", "record")).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    layouts = {r.layout for r in chat.format_chats(chat.conversation_records(df), "conv_id", "turn", "record").collect()}
    assert len(layouts) == 2


def test_only_the_layout_with_names_of_its_own_is_renamed():
    assert chat.canonical({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}) == [("user", "a"), ("assistant", "b")]
    assert chat.canonical({"messages": [{"role": "human", "content": "a"}]}) == [("human", "a")]


# main text: cases where names and tags must not decide alone

LONG = "<p>I think, that this, is a long comment. And it goes on, and on.</p>"
ARTICLE = "<p>The article, as it stands. It has some text, and stops.</p><p>More of it, here. And <a href=q>a link</a></p>"
TEXT = "The article, as it stands. It has some text, and stops.\n\nMore of it, here. And a link"


def test_comments_that_are_longer_than_their_article_go():
    page = f"<html><body><article><h1>Head</h1>{ARTICLE}<div class='comments'>{LONG * 12}</div></article></body></html>"
    assert "comment" not in tagpaths.main_text(page) and TEXT in tagpaths.main_text(page)


def test_a_form_around_the_page_is_no_form_but_a_small_one_is():
    menu = "<div><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></div>"
    assert tagpaths.main_text(f"<html><body><form id=f>{menu}<div>{ARTICLE}</div></form></body></html>") == TEXT
    assert tagpaths.main_text(f"<html><body><div>{ARTICLE}</div><form><p>Subscribe now, please.</p></form></body></html>") == TEXT


def test_a_menu_of_links_stays_out_of_a_text_without_stops():
    page = "<body><ul><li><a href=a>Home page</a></li><li><a href=b>Contact us</a></li></ul><div><p>words without any marks in them at all just going on and on</p><p>another paragraph of such words that goes on</p></div></body>"
    assert tagpaths.main_text(page) == "words without any marks in them at all just going on and on\n\nanother paragraph of such words that goes on"


def test_wrappers_named_after_what_else_they_hold_keep_their_text():
    for name in ("content has-sidebar", "with-comments", "social-page"):
        assert TEXT in tagpaths.main_text(f"<body><div class='{name}'>{ARTICLE}</div></body>")
        assert TEXT in tagpaths.main_text(f"<body><div class='{name}'><h1>Head</h1>{ARTICLE}</div><div class='comments'>{LONG}</div></body>")


def test_a_dense_cell_is_split_by_distance(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    centres = base + 0.35 * rng.normal(size=(30, 16))
    x = np.concatenate([c + 0.02 * rng.normal(size=(40, 16)) for c in centres] + [rng.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(covertree, "BLOCK", 50)
    monkeypatch.setattr(covertree, "TOP_SAMPLE", 3)  # the first net puts nearly all into one cell
    seen = {}
    real = covertree.block_pairs

    def watched(blocks, top, reach):
        pairs = real(blocks, top, reach)
        seen.update(blocks=blocks.where("place = 0").count(), largest=blocks.groupBy("block").count().agg(F.max("count")).first()[0], pairs=pairs.count())
        return pairs

    monkeypatch.setattr(covertree, "block_pairs", watched)
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_dedup(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    assert {i: n for i, (n, _) in got.items()} == {i: int(links[i].sum()) - 1 for i in range(len(x))}
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[links[i]].min() for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert {i: c for i, (_, c) in got.items()} == dict(enumerate(comp.tolist()))
    assert seen["largest"] <= 50 and seen["pairs"] < 0.5 * seen["blocks"] * (seen["blocks"] - 1) / 2
