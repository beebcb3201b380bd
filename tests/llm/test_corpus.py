"""Corpus operators against brute force, exact round trips and held-out labels, on small tables with hard rows."""

import hashlib
import json
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chat, common, covertree, exact, mixing, quality, setsketch, sharding, spm, tagpaths, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta", "eta", "iota"]


def rows_of(texts):
    return [(i, t, "en" if i % 3 else "fr", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


def hard_texts():
    rng = np.random.default_rng(3)
    base = " ".join(rng.choice(WORDS, 120))
    near = base.split()
    near[60] = "changed"
    long = " ".join(rng.choice(WORDS, 5000))
    other = [" ".join(rng.choice(WORDS, 80)) + f" unique{i}" for i in range(12)]
    return [base, " ".join(near), base, None, "", "  \n\t ", long, long + " tail", "one", "One", "ONE", *other, base.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(hard_texts())
    rows += [rows[0], (None, hard_texts()[0], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).withColumn("count", F.lit(1)).withColumn("component", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


# exact dedup


def test_exact_dedup_equals_brute_force(docs):
    got = exact.exact_dedup(docs, prefix=8).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i is not None]
        assert r.group_size == len(same)
        assert r.keep_id == (max(ids) if ids else None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_drop_copies_keeps_columns(docs, empty):
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert {r.text or "" for r in left.collect()} == {r.text or "" for r in docs.collect()}
    assert exact.exact_dedup(empty).count() == 0 and exact.drop_copies(empty).count() == 0


# near dedup


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(frozenset(setsketch.shingle_set(t, width).tolist()))
    ids = sorted(sets)
    label = {i: i for i in ids}
    linked = lambda a, b: any(len(x & y) * 100 >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y)
    pairs = [(a, b) for a in ids for b in ids if a < b and linked(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_near_dedup_equals_brute_force(docs):
    width = 2
    got = setsketch.near_dedup(docs, width=width)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], width, 80)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_near_dedup_of_chains_and_groups(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    text, rows = list(rng.choice(words, 150)), []
    for i in range(60):  # a drifting chain: neighbours are near, ends are not
        rows.append((i, " ".join(text)))
        for k in rng.integers(0, 150, 4):
            text[k] = f"x{i}_{k}"
    base = list(rng.choice(words, 150))
    for i in range(100, 180):
        t = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 14))):
            t[k] = str(rng.choice(words))
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 80)
    got = {r.doc_id: r.component_id for r in setsketch.near_dedup(df, width=2).collect()}
    assert got == want


def test_blocks_lose_no_pair(spark, monkeypatch):
    """A large group whose members lie around the threshold, in many small blocks; then with an estimate that lets nothing through."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            words[k] = "abc"[int(rng.integers(0, 3))] + str(k)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 80)
    assert len(set(want.values())) > 10
    for side, chunk in ((1 << 19, 1 << 17), (600, 400)):
        monkeypatch.setattr(setsketch, "SIDE", side)
        monkeypatch.setattr(setsketch, "CHUNK", chunk)
        got = {r.doc_id: r.component_id for r in setsketch.near_dedup(df, width=2).collect()}
        assert got == want


def test_overlaps_equal_set_intersections(monkeypatch):
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.zipf(1.3, int(n)) % 5000) for n in rng.integers(1, 300, 80)]
    for step in (4_000_000, 50):
        monkeypatch.setattr(setsketch, "STEP", step)
        block = setsketch.Block(list(range(50)), list(range(50)), sets[:50], 80)
        got = block.overlaps(sets[50:])
        assert (got == [[len(np.intersect1d(a, b)) for b in sets[50:]] for a in sets[:50]]).all()


def test_stages_decide_by_row(spark):
    """Rows that repeat an id lose none of their other texts, null ids are decided like others, columns may bear any name."""
    long = " ".join(WORDS * 6)
    rows = [(5, "a b c d e f"), (9, "a b c d e f"), (5, "other text of the same id"), (None, "a b c d e f"), (None, "only here"), (3, long), (4, long + " end"), (4, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("bitmap", "_page", "_bit", "_maybe", "page", "_copy", "_row", "id", "digest", "text_key"):
        df = df.withColumn(name, F.lit(name))
    got = exact.drop_copies(df)
    assert got.columns == df.columns and all(r[name] == name for r in got.collect() for name in df.columns[2:])
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for i, t in rows if (i, t) not in ((5, "a b c d e f"), (None, "a b c d e f")))
    got = setsketch.drop_near_copies(df)
    assert got.columns == df.columns and all(r[name] == name for r in got.collect() for name in df.columns[2:])
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for i, t in rows if (i, t) not in ((9, "a b c d e f"), (4, long + " end")))
    mixed = mixing.mixed_docs(df.withColumn("lang", F.lit("en")))
    assert mixed.columns[:-1] == df.columns and all(r._copy == "_copy" for r in mixed.collect())


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    a, b = x[:800], x[200:]
    assert (setsketch.registers(x) == np.maximum(setsketch.registers(a), setsketch.registers(b))).all()
    got = setsketch.similarity_estimate(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([800.0]), np.array([800.0]))
    assert abs(got[0] - 0.6) < 0.13


def test_words_end_at_ascii_white_space_only():
    assert len(setsketch.shingle_set("a b c d", 2)) == 1
    assert len(setsketch.shingle_set("a\x0bb\x0cc\rd", 2)) == 3
    assert (setsketch.shingle_set("É A", 2) == setsketch.shingle_set("É a", 2)).all()
    assert (setsketch.shingle_set("É A", 2) != setsketch.shingle_set("é a", 2)).all()


def test_near_dedup_of_nothing(spark, empty):
    assert setsketch.near_dedup(empty).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in setsketch.near_dedup(blank).collect()} == {(1, 1, True, 0), (2, 2, True, 0)}


# sentencepiece


@pytest.fixture(scope="module")
def model():
    return spm.Model(spm._raw(spm.MODEL_PATH))


def test_ids_equal_the_public_encoder(model):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=spm.MODEL_PATH)
    rng = np.random.default_rng(2)
    letters = list(" \n\tabthe xyzin eré漢😀▁<>0 ")
    texts = ["".join(rng.choice(letters, n)) for n in (0, 1, 2, 7, 40, 200, 900)] + [t or "" for t in hard_texts()]
    texts += ["".join(rng.choice(list("abcdefgh"), 700)), " " * 50, "a" * 300, "   lead and trail   "]
    for t in texts:
        assert model.encode(t) == sp.encode(t)
        if "▁" not in t:
            assert model.decode(model.encode(t)) == t


def test_window_commits_and_stays_small(model):
    """One stretch without spaces: the window moves on long before its end, and gives the public encoder's ids."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=spm.MODEL_PATH)
    text = "".join(np.random.default_rng(4).choice(list("etaoinsh"), 30_000))
    model.commits = model.widest = 0
    assert list(model.window("▁" + text)) == sp.encode(text)
    assert model.commits > 500 and model.widest <= 6 * model.width


def test_repeated_and_first_words_are_equal(model):
    text = " ".join(["thorin", "thorin", "ontionly", "a" * 40, "thorin"])
    first = model.encode(text)
    assert model.encode(text) == first
    model.known.clear()
    model.near.clear()
    assert model.encode(text) == first


def test_unigram_models_take_the_best_path():
    m = spm.Model.__new__(spm.Model)
    m.kind, m.ids, m.scores, m.width, m.least, m.usable = spm.UNIGRAM, {"a": 0, "ab": 1, "b": 2, "ba": 3}, [-1.0, -1.5, -1.0, -3.0], 2, -13.0, {}
    m.reach, m.near, m.bytes, m.unknown, m.commits, m.widest = {}, {}, {}, 9, 0, 0
    assert list(m.window("abba")) == [1, 2, 0]
    long = "abba" * 50
    assert list(m.window(long)) == [1, 2, 0] * 50 and m.commits > 20
    assert list(m.window("axa")) == [0, 9, 0]


def test_encode_rows(docs, empty):
    got = spm.encode(docs).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got) and all(r.n_tokens == len(r.ids) for r in got)
    assert spm.encode(empty).count() == 0
    back = spm.decode(spm.encode(docs.where("doc_id < 3"))).select("doc_id", "text")
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.where("doc_id < 3").collect()}


# quality and toxicity


def labelled(spark, n=240):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(n):
        words = [a + b for a, b in zip(rng.choice(WORDS, 60), rng.choice(WORDS, 60), strict=True)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            for k in range(4):
                words[7 + 11 * k] = ["blockhead", "b.l.o.c.k.h.e.a.d", "blockkhead", "numbskull"][(i // 5 + k) % 4]
        text = " ".join(words) if good else "BUY NOW!! " * 40 + " ".join(words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "word " * 30_000, "en", "s", 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("fit, label, folds, held", [(quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, empty, fit, label, folds, held):
    docs, labels = labelled(spark)
    got = fit(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.9
    assert fit(empty, labels).count() == 0
    none = fit(docs, labels.where("false")).collect()
    assert len(none) == docs.count() and all(0 <= r.score <= 1 for r in none)


def test_scores_do_not_see_other_columns(spark):
    docs, labels = labelled(spark, 120)
    a = by_id(quality.quality_scores(docs, labels))
    b = by_id(quality.quality_scores(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), labels))
    assert {i: r.score for i, r in a.items()} == {i: r.score for i, r in b.items()}


def test_toxicity_learns_from_whole_texts(spark):
    """The insults stand in one sentence of 250, behind the first 20,000 characters."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(60):
        sentences = [" ".join(a + b for a, b in zip(rng.choice(WORDS, 9), rng.choice(WORDS, 9), strict=True)) for _ in range(250)]
        if i % 2:
            sentences[243] += " " + " ".join(["blockhead", "numbskull", "dunderpate", "blockkhead"])
        text = ". ".join(sentences)
        assert len(sentences[243]) < 400 and text.find("numbskull") in (-1, *range(20_000, 40_000))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, DOCS)
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sum(r.held_out for r in got) > 5
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out]) > 0.9


def test_word_scores_equal_the_kernel_sum():
    rng = np.random.default_rng(1)
    scorer = toxicity.Scorer(rng.normal(size=toxicity.LETTERS**toxicity.LENGTH))
    words = ["idiot", "i.d.i.o.t", "", "a", "éçlonger-word", "worthless"]
    want = np.zeros(len(words))
    for owner, feature, weight in toxicity.subsequences(words):
        want += np.bincount(owner, scorer.weights[feature] * weight, len(words))
    assert np.allclose(want, scorer.word_scores(words), atol=1e-4)
    assert toxicity.tokens("an i d i o t here") == ["an", "idiot", "here"]


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header><p>Site header, with words, and stops.</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies, all day.</div>
<article><h1>Head &amp; tail</h1><p><b>First  para, graph.<br><p>Second
 paragraph; longer, with more text. And stops.</p><p>Sh.</p><form><p>Sign up, now.</p></form></article>
<aside><p>Side bar, text.</p></aside><section id="comments"><p>I disagree, strongly, with all of it. Really.</p></section>
<!-- note --><footer>&copy; 2024 Foot, er.</footer>"""


def test_main_text_of_a_page():
    assert tagpaths.main_text(PAGE) == "Head & tail\n\nFirst para, graph.\n\nSecond paragraph; longer, with more text. And stops.\n\nSh."
    assert tagpaths.main_text(None) == tagpaths.main_text("") == tagpaths.main_text("<nav><a>x</a></nav>") == ""
    plain = "<body><div class='menu'><a>One</a></div><div><p>Some text, here.</p><p>More text, there.</p></div></body>"
    assert tagpaths.main_text(plain) == "Some text, here.\n\nMore text, there."


BARE = """<html><body><div><ul><li><a href="/a">One, two.</a></li><li><a href="/b">Three.</a></li></ul></div>
<div><div><h2 id="related-work">Related work</h2><p>A first paragraph, with several clauses, and stops. It goes on, and on, for a while.</p>
<p>Another one; it is long as well, with commas, and an <span class="search term">inline word</span> inside. The end.</p><p>Short.</p></div></div>
<div><span>Imprint 2024</span></div></body></html>"""


def test_paths_decide_without_telling_names():
    want = "Related work\n\nA first paragraph, with several clauses, and stops. It goes on, and on, for a while.\n\nAnother one; it is long as well, with commas, and an inline word inside. The end.\n\nShort."
    assert tagpaths.main_text(BARE) == want
    for names in ("content has-sidebar", "no-sidebar", "with-comments", "social-page"):  # on wrappers that hold the article
        assert tagpaths.main_text(BARE.replace("<div><div>", f'<div class="{names}"><div>')) == want
    flat = "<body><div><a href='/x'>Home</a></div><h1>Title</h1><p>Some text, here, and there, of some length.</p><p>More text, there, with stops. Yes.</p><div><a href='/y'>Next</a></div></body>"
    assert tagpaths.main_text(flat) == "Title\n\nSome text, here, and there, of some length.\n\nMore text, there, with stops. Yes."


def plain_scores(page):
    """Tag-path ratios as the method's text has them, with whole paths as tuples, for pages of well-formed elements."""
    stack, sums = [], {}
    for m in re.finditer(r"<(/?)(\w+)[^>]*>|([^<]+)", page):
        if m[3]:
            if m[3].strip():
                got = sums.setdefault(tuple(stack), [0, 0, 0])
                link = "a" in stack
                got[0], got[1], got[2] = got[0] + 1, got[1] + len(m[3]) * (not link), got[2] + len(tagpaths.STOPS.findall(m[3])) * (not link)
        elif m[1]:
            stack.pop()
        else:
            stack.append(m[2])
    order = list(sums)
    out = {}
    for i, p in enumerate(order):
        top = [0.0, 0.0, 0.0]
        for j in (i - 1, i, i + 1):
            if 0 <= j < len(order):
                q = order[j]
                same = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
                w = 1.0 if i == j else np.exp(-1) * same / max(len(p), len(q))
                top[0] += w
                top[1] += w * sums[q][1] / sums[q][0]
                top[2] += w * sums[q][2] / sums[q][0]
        out[p] = (top[1] / top[0] * (top[2] / top[0] + 0.1)) ** 0.5
    return list(out.values())


def test_scores_equal_a_plain_version():
    page = re.sub(r' (class|id)="[^"]*"', "", BARE)
    page = re.sub(r">\s+<", "><", page)
    paths = tagpaths.Paths(page)
    assert np.allclose(list(tagpaths.path_scores(paths, paths.weights()).values()), plain_scores(page))


def test_deep_nesting_is_linear():
    began = time.time()
    for tag in ("div", "b", "p", "li"):
        deep = f"<{tag}>a, b. " * 20_000 + f"</{tag}>" * 20_000
        assert "a, b." in tagpaths.main_text(f"<body>{deep}</body>")
        tagpaths.main_text("<b><div>" + "<i>x, y. " * 20_000 + "</b>" * 20_000)
    assert time.time() - began < 20


def test_broken_markup_is_linear():
    assert tagpaths.main_text("<p>" + "<" * 20_000 + "a, b.</p>") is not None
    assert len(tagpaths.main_text('<p class="' + "x" * 200_000)) > 0


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 7), (2, None, None, 7), (1, "u", PAGE, 7)], "page_id long, url string, html string, text int")
    got = tagpaths.extract(pages).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert tagpaths.extract(pages.where("false")).count() == 0


# chat


LAYOUTS = [
    ({"role": "user", "text": "hi"}, [("user", "hi")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"completion": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
    ({"nothing": 1}, None),
]


@pytest.mark.parametrize("record, turns", LAYOUTS)
def test_layouts(record, turns):
    assert chat.canonical(record) == turns


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "<\\s>", "<<s>\\n</s>\n<s>user\n", "<<SYS>>|><|", "a\r\n\n b "])
def test_template_is_reversible(text):
    formatted, start, end = chat.format_turn("assistant", text)
    assert chat.read_back(formatted) == [("assistant", text)]
    assert chat.unescape(formatted[start:end]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "</s> a"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "</s> a"), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    turns = chat.format_chats(chat.conversation_records(df), "conv_id", "turn", "record")
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert set(got) == {1, 2, 3, None} and got[1].n_turns == 3
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\n</s> a\nassistant\n</s> a\n".encode()).hexdigest()
    assert got[1].loss_chars == 12 and got[1].loss_sha256 == hashlib.sha256("</s> a</s> a".encode()).hexdigest()
    broken = spark.createDataFrame([(1, 0, "{"), (1, 1, json.dumps({"x": 1}))], "conv_id long, turn long, record string")
    assert {r.layout for r in chat.format_chats(broken, "conv_id", "turn", "record").collect() if r.role is None} >= {"broken"}
    assert chat.digests(chat.format_chats(chat.conversation_records(df.where("false")), "conv_id", "turn", "record")).count() == 0


# embeddings


def cosines(rows):
    """n_links and component per id, by brute force over rows of unique ids."""
    x = np.array([v for _, v in rows], float)
    u = x / np.abs(x).max(1, keepdims=True)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    for _ in rows:
        label = np.minimum(label, np.where(hit, label[None, :], ids.max()).min(1, initial=ids.max()))
    return {i: (int(n), int(c)) for i, n, c in zip(ids, hit.sum(1), label, strict=True)}


def test_cover_tree_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(40, 16))
    x = np.vstack([heads, *(heads[i] + rng.normal(size=(n, 16)) * w for i, n, w in ((0, 60, 0.15), (1, 9, 0.15), (2, 3, 0.15), (3, 50, 0.02)))])
    x = np.vstack([x, x[:5], x[:3] * 2, x[:1] * 1e200, x[1:2] * 1e-200])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, []), (905, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "node": F.lit("x"), "block": F.lit(2)})
    want = cosines(rows)
    for block, top in ((4096, 4096), (16, 8)):
        monkeypatch.setattr(covertree, "BLOCK", block)
        monkeypatch.setattr(covertree, "TOP_SAMPLE", top)
        got = covertree.near_dedup(df).collect()
        assert len(got) == df.count()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 900} == want
        assert all(r.component_id == r.vec_id and r.n_links == 0 and r.kept for r in got if r.vec_id is None or r.vec_id >= 900)
    assert covertree.near_dedup(df.where("false")).count() == 0
    # an id that stands for two vectors: two nodes
    two = spark.createDataFrame([(1, rows[0][1]), (1, rows[30][1]), (2, rows[0][1]), (3, rows[30][1])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in covertree.near_dedup(two).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_trees_nest_and_prune():
    """Levels halve and nest, and the traversal looks at few of the pairs of far groups."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(20, 8)), 30, 0) + rng.normal(size=(600, 8)) * 0.05
    x = covertree.unit(x)
    order, levels = covertree.grow(x)
    tree = covertree.Tree(x[order], levels, np.arange(600), np.ones(600, np.int64))
    assert sorted(order) == list(range(600)) and len(tree.starts[0]) == 1
    for k, r in enumerate(covertree.RADII):
        assert set(tree.starts[k]) <= set(tree.starts[k + 1]) and tree.radii[k + 1].max() <= r + 1e-3
    pair = covertree.Pair(tree, tree, 0.95)
    seen = []
    real = covertree.Pair.undecided
    pair.undecided = lambda level, i, j: seen.append(len(i)) or real(pair, level, i, j)
    compared = []
    pair.compare = lambda p, q: compared.extend([*map(sum, [tree.members(4, p)[1] * tree.members(4, q)[1]])]) or covertree.Pair.compare(pair, p, q)
    pair.run()
    hit = x[order] @ x[order].T >= 0.95
    assert (tree.links == hit.sum(1) - 1).all()
    assert sum(compared) < 600 * 600 / 4 and sum(seen) < 600 * 600 / 4


# mixing


def test_rates_meet_targets(spark, docs, empty):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 4 == 0]}{k}" for k in range(50)], 40)), "b" if i % 4 == 0 else "a", "s", 1) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_rates(df, targets={"a": 0.5, "b": 0.5}).toPandas()
    p, r, t = np.array(got.posterior.tolist()), got.rate.to_numpy(), got.tokens.to_numpy()
    assert np.allclose((p * (r * t)[:, None]).sum(0) / t.sum(), [0.5, 0.5], atol=2e-3) and (r >= 0).all()
    assert (got.domain == ["b" if i % 4 == 0 else "a" for i in got.doc_id]).mean() > 0.95
    more = mixing.mixed_docs(df, targets={"a": 0.5, "b": 0.5})
    n = {x.lang: x["count"] for x in more.groupBy("lang").count().collect()}
    assert more.columns == df.columns and n["a"] == 150 and abs(n["b"] - 150) < 25
    assert {x.doc_id for x in more.collect()} == set(range(200))
    assert mixing.mix_rates(docs).count() == docs.count()
    assert mixing.mix_rates(empty).count() == 0 and mixing.mixed_docs(empty).count() == 0


# sharding


def test_shards_are_even_and_links_hold(spark, docs, empty):
    rows = [(i, f"text {i // 3}" if i < 300 else f"single {i}") for i in range(500)] + [(1000 + i, "hot") for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, shards=4).toPandas()
    assert len(got) == 750 and sorted(got.doc_id) == sorted(i for i, _ in rows)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 4
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())
    got["text"] = got.doc_id.map(text)
    shards = got.groupby("text").shard.nunique()
    assert shards["hot"] <= 3 and (shards.drop("hot") > 1).mean() < 0.05
    linked = shards.drop("hot")[got.groupby("text").size().drop("hot") > 1]
    assert len(linked) == 100 and (linked > 1).sum() <= 3  # one for each boundary between four shards
    cut = sharding.cut_links(spark.createDataFrame(got[["text", "shard"]]), "text").first()
    assert cut.links == 101 and cut.cut == (linked > 1).sum() + (shards["hot"] > 1)
    again = sharding.shard_documents(df.repartition(7), shards=4).toPandas()
    assert dict(zip(again.doc_id, again.shard, strict=True)) == dict(zip(got.doc_id, got.shard, strict=True))
    small = sharding.shard_documents(docs, shards=16).toPandas()
    assert len(small) == docs.count() and small.groupby("shard").size().max() <= 2
    assert sorted(small["size"]) == sorted(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert sharding.shard_documents(empty).count() == 0


# helpers and pipeline


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_key_filter_never_misses(spark):
    keys = spark.range(0, 5000, 7)
    pages = common.key_filter(keys, "id", bits=1 << 16)
    marked = common.with_maybe(spark.range(5000), pages, "id", bits=1 << 16)
    assert marked.where("id % 7 = 0 AND NOT _maybe").count() == 0
    assert marked.where("id % 7 <> 0 AND _maybe").count() < 500


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    copies = docs.where("doc_id IN (1, 2)").withColumn("doc_id", F.col("doc_id") + 2000)
    near = docs.where("doc_id IN (5, 6)").withColumns({"doc_id": F.col("doc_id") + 3000, "text": F.concat("text", F.lit(" end"))})
    docs.unionByName(copies).unionByName(near).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, str(tmp_path)))
        seen.append({r.doc_id for r in now.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert seen[1] == seen[0] - {1, 2} and 2001 in seen[1]
    assert seen[1] - seen[2] == {3005, 3006} & seen[1]
    assert seen[2] == seen[3] == seen[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]
