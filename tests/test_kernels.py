"""Kernel tests by tiles, order over whole tables, pair samples: against numpy, in one block and in many."""

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pytest

from gaugeworks.operators import kernels as kn
from gaugeworks.operators import ordering as od
from gaugeworks.operators import sampling as sm


def sample(spark, n=90, shift=1.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(c, i, int(i % 3 == 0), [float(x) for x in rng.normal(size=4) + (shift if i % 3 == 0 and c == 1 else 0)]) for c in (0, 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "cell int, id long, grp int, v array<double>")


def plain_mmd(x, y, h):
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * h * h))
    m, n = len(x), len(y)
    return (k(x, x).sum() - m) / (m * (m - 1)) + (k(y, y).sum() - n) / (n * (n - 1)) - 2 * k(x, y).mean()


@pytest.mark.parametrize("tile", [1024, 17])
def test_tiles_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(kn, "TILE", tile)
    rows, df = sample(spark)
    blocks = kn.kernel_blocks(df, ["cell"], "id", "grp", "v", 30)
    h = {r.cell: r.h for r in kn.bandwidths(blocks, ["cell"]).collect()}
    tests = kn.mmd_permutations(blocks, ["cell"], kn.bandwidths(blocks, ["cell"]))
    labels = {(r.cell, r.id): r.labels for r in kn.permuted_labels(df, ["cell"], "id", "grp", 30, "perm").collect()}
    got = {(r.cell, r.p): r.mmd2 for r in tests.collect()}
    assert len(got) == 2 * 31
    for cell in (0, 1):
        mine = [(i, np.array(v)) for c, i, _, v in rows if c == cell]
        d = [np.linalg.norm(a - b) for (_, a), (_, b) in combinations(mine, 2)]
        assert h[cell] == pytest.approx(np.median(d), abs=1e-9)
        for p in (-1, 0, 29):
            sides = [np.array([v for i, v in mine if labels[cell, i][p + 1] == g]) for g in "01"]
            assert len(sides[1]) == 30
            assert got[cell, p] == pytest.approx(plain_mmd(*sides, h[cell]), abs=1e-9)


@pytest.mark.parametrize("guess", [True, False])
def test_bandwidths_are_exact_in_two_sweeps_of_large_cells(spark, monkeypatch, guess):
    monkeypatch.setattr(kn, "TILE", 16)
    sweeps, plain = [], kn.over_tiles
    monkeypatch.setattr(kn, "over_tiles", lambda *a, **k: (sweeps.append(a[2]), plain(*a, **k))[1])
    if not guess:
        monkeypatch.setattr(kn, "BINS", 10**6, raising=False)  # ranges too narrow for a guess to hold the median
        monkeypatch.setattr(kn, "FEW", 40)
    rng = np.random.default_rng(9)
    cells = {0: rng.normal(size=(301, 5)) + 5000, 1: np.repeat(rng.normal(size=(40, 5)), 8, 0), 2: np.zeros((300, 5)), 3: 1e25 * rng.normal(size=(300, 5)), 4: rng.normal(size=(2, 5)), 5: rng.normal(size=(1, 5))}
    df = spark.createDataFrame([(c, i, i % 2, [float(z) for z in v]) for c, x in cells.items() for i, v in enumerate(x)], "cell int, id long, grp int, v array<double>")
    blocks = kn.kernel_blocks(df, ["cell"], "id", "grp", "v", 0)
    assert blocks.where("cell = 0 and blocks > 16").count() > 4 * 4
    got = {r.cell: r.h for r in kn.bandwidths(blocks, ["cell"]).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[2] == 1.0
    for c in (0, 1, 3, 4):
        x = cells[c]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
        assert got[c] == pytest.approx(np.median(d), rel=1e-14)
    assert len(sweeps) <= 3 if guess else len(sweeps) > 3  # one that guides, one that counts, more where a guess failed


def test_a_shift_is_rejected_and_none_is_not(spark):
    _, df = sample(spark, seed=5)
    p = {r.cell: r for r in kn.p_values(kn.permutation_tests(df, ["cell"], "id", "grp", "v", 100), ["cell"]).collect()}
    assert p[1].p_value < 0.05 < p[0].p_value and p[1].mmd2 > p[0].mmd2


def test_kernel_cells_that_are_small_or_broken(spark):
    rows = [(0, 1, 0, [0.0]), (0, 2, 1, [1.0]), (1, 1, 0, [2.0]), (1, 2, 0, [2.0]), (1, 3, 1, [2.0]), (1, 4, 1, [2.0]), (1, 5, 1, None), (1, 6, 1, [math.nan]), (1, 7, 2, [5.0])]
    df = spark.createDataFrame(rows, "cell int, id long, grp int, v array<double>")
    got = {r.cell: r for r in kn.p_values(kn.permutation_tests(df, ["cell"], "id", "grp", "v", 5), ["cell"]).collect()}
    assert got[0].mmd2 is None and got[0].p_value is None
    assert got[1].mmd2 == pytest.approx(0) and got[1].p_value == 1.0  # bandwidth 1 where all distances are 0
    assert kn.permutation_tests(df.limit(0), ["cell"], "id", "grp", "v", 5).count() == 0


def test_power_control_and_half_splits(spark):
    rng = np.random.default_rng(3)
    rows = [(u, 100 * u + i, [float(u) * 2 + float(x) for x in rng.normal(size=3)]) for u in range(6) for i in range(12)] + [(9, 1, [0.0] * 3), (9, 2, [1.0] * 3), (9, 3, [2.0] * 3)]
    df = spark.createDataFrame(rows, "unit int, id long, v array<double>")
    power = kn.power_control(df.where("unit < 9"), "unit", "id", "v", 60).first()
    assert power.pairs == 15 and power.reject_rate > 0.9 and power.p95 > power["median"] > 0
    half = kn.half_split_p(df, "unit", "id", "v", 60)
    assert sorted(r.unit for r in half.collect()) == list(range(6))
    u = kn.uniformity(half).first()
    assert u.n == 6 and 0 < u.ks < 0.8 and u.ks_p > 0.01
    assert kn.uniformity(half.limit(4)).first().ks is None


def test_power_control_tests_every_two_units(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(u, 100 * u + i, [u + float(x) for x in rng.normal(size=2)]) for u in range(13) for i in range(4)], "unit int, id long, v array<double>")
    assert kn.power_control(df, "unit", "id", "v", 3).first().pairs == 78


def test_uniformity_of_known_values(spark):
    p = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.3, 0.7, 0.9)], "p_value double")
    r = kn.uniformity(p).first()
    assert r.ks == pytest.approx(0.3)  # three of five values at or below 0.3
    x = (math.sqrt(5) + 0.12 + 0.11 / math.sqrt(5)) * 0.3
    assert r.ks_p == pytest.approx(min(1, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))), abs=1e-12)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals_and_numbers_equal_plain_ones(spark, keys):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 7 == 0] if i % 50 else None, int(rng.integers(20)), i, int(rng.integers(5))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, a int, id int, v int").repartition(6)
    got = {r.id: (r.t, r.n) for r in od.numbered(od.running_total(df, keys, ["a", "id"], "v", "t"), keys, ["a", "id"], "n").collect()}
    seen = {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        s = seen.setdefault(k if keys else 0, [0, -1])
        s[0], s[1] = s[0] + v, s[1] + 1
        assert got[i] == (s[0], s[1])


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "id int, x double")
    assert {r.id: r.r for r in od.average_rank(df, "x", "r").collect()} == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.0}


@pytest.mark.parametrize("left", [50_000, 10])
def test_quantiles_equal_numpy(spark, monkeypatch, left):
    monkeypatch.setattr(od, "LEFT", left)
    monkeypatch.setattr(od, "BINS", 8)
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=301), "b": rng.integers(0, 4, 200).astype(float), "c": np.array([7.0]), "d": np.concatenate([rng.normal(size=99), [1e12]])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("e", None)], "k string, x double")
    got = {r.k: r for r in od.quantiles(df, ["k"], "x", {"q1": 0.25, "mid": 0.5, "top": 0.975}).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        assert (got[k].n, got[k].q1, got[k].mid, got[k].top) == (len(v), *(pytest.approx(np.percentile(v, q), rel=1e-12, abs=1e-12) for q in (25, 50, 97.5)))
    assert od.quantiles(df, [], "x", {"mid": 0.5}).first().mid == pytest.approx(np.median(np.concatenate(list(data.values()))))
    assert od.quantiles(df.limit(0), ["k"], "x", {"mid": 0.5}).count() == 0


@pytest.mark.parametrize(("sizes", "n"), [((5, 4, 1), 8), ((60, 30, 2), 40), ((2, 2), 50), ((1, 1), 5)])
def test_pair_samples_are_distinct_pairs_inside_groups(spark, sizes, n):
    units = [(g, 100 * g + i) for g, s in enumerate(sizes) for i in range(s)]
    df = spark.createDataFrame(units, "g int, unit int")
    got = [(r.u, r.w) for r in sm.sampled_pairs(df, "unit", n, "s", ["g"]).collect()]
    assert len(got) == len(set(got)) == min(n, sum(s * (s - 1) // 2 for s in sizes))
    assert all(u < w and u // 100 == w // 100 for u, w in got)
    assert set(got) == {(r.u, r.w) for r in sm.sampled_pairs(df.repartition(5), "unit", n, "s", ["g"]).collect()}


def test_pair_samples_cover_all_pairs_alike(spark):
    df = spark.range(12).withColumnRenamed("id", "unit")
    seen = {}
    for seed in range(12):
        for r in sm.sampled_pairs(df, "unit", 10, str(seed)).collect():
            seen[(r.u, r.w)] = seen.get((r.u, r.w), 0) + 1
    assert len(seen) > 50 and max(seen.values()) <= 8


def test_derangement_moves_everyone(spark):
    got = {r.unit: r.donor for r in sm.derangement(spark.range(30).withColumnRenamed("id", "unit"), "unit").collect()}
    assert set(got) == set(got.values()) == set(range(30)) and all(a != b for a, b in got.items())
    assert sm.derangement(spark.range(1).withColumnRenamed("id", "unit"), "unit").count() == 0


def test_large_cells_place_permutations_without_exploding_them(spark, monkeypatch):
    rows, df = sample(spark, n=400)
    small = {(r.cell, r.id): r.labels for r in kn.permuted_labels(df, ["cell"], "id", "grp", 25, "perm").collect()}
    monkeypatch.setattr(kn, "LOCAL", 50)
    large = kn.permuted_labels(df.withColumn("grp", df.grp), ["cell"], "id", "grp", 25, "perm")
    assert {(r.cell, r.id): r.labels for r in large.collect()} == small
    for cell in (0, 1):
        for p in range(26):
            assert sum(v[p] == "0" for (c, _), v in small.items() if c == cell) == 400 - 134
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Generate explode" not in plan


@pytest.mark.parametrize("grp", [0, 1])
def test_large_cells_of_one_group(spark, monkeypatch, grp):
    monkeypatch.setattr(kn, "LOCAL", 5)
    df = spark.createDataFrame([(0, i, grp) for i in range(40)], "cell int, id long, grp int")
    assert {r.labels for r in kn.permuted_labels(df, ["cell"], "id", "grp", 6, "perm").collect()} == {str(grp) * 7}


def test_tiles_of_many_blocks_send_each_block_to_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(kn, "TILE", 4)
    monkeypatch.setattr(kn, "HELD", 20)
    _, df = sample(spark)
    blocks = kn.kernel_blocks(df, ["cell"], "id", "grp", "v", 10)
    assert blocks.count() > 40
    seen = kn.over_tiles(blocks, ["cell"], "pairs long, tiles long", lambda x, y, same, row: __import__("pandas").DataFrame({"pairs": [len(x[1]) * (len(x[1]) - 1) // 2 if same else len(x[1]) * len(y[1])], "tiles": [0]}))
    got = seen.groupBy("cell").agg({"pairs": "sum", "*": "count"}).collect()
    assert all(r["sum(pairs)"] == 90 * 89 // 2 and r["count(1)"] == kn.SIDES * (kn.SIDES + 1) // 2 for r in got)


def test_similarity_of_nine_places_tells_close_cosines_apart(spark, monkeypatch):
    monkeypatch.setattr(kn, "TILE", 16)
    rng = np.random.default_rng(4)
    x, y = (1 + 1e-3 * rng.normal(size=(40, 3)) for _ in range(2))
    y[5:9], x[30:33] = y[5], x[30]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(40)], "id long, a array<double>, b array<double>")

    def ranks(v):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        c = np.round(unit @ unit.T, 9)[np.triu_indices(40, 1)]
        return (c[:, None] > c[None]).sum(1) + ((c[:, None] == c[None]).sum(1) + 1) / 2

    fine, coarse = (kn.representation_similarity(df, "id", "a", "b", places=p).first() for p in (9, 4))
    assert fine.pairs == 780 and fine.rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)
    assert coarse.rho is None  # all cosines are 1 at four places


@pytest.mark.parametrize("span", [2_000_000, 20])
def test_similarity_writes_no_pair_and_ranks_ties_of_many(spark, monkeypatch, span):
    monkeypatch.setattr(kn, "TILE", 16)
    monkeypatch.setattr(kn, "SPAN", span, raising=False)
    monkeypatch.setattr(kn, "PART", 7, raising=False)
    sizes, plain = [], kn.written
    monkeypatch.setattr(kn, "written", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(12, 3))[np.arange(50) % 12], rng.normal(size=(20, 4))[np.arange(50) % 20]
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(50)], "id long, g int, a array<double>, b array<double>")
    at = np.triu_indices(50, 1)
    at = tuple(i[(at[0] - at[1]) % 2 == 0] for i in at)

    def ranks(v):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        c = np.round(unit @ unit.T, 9)[at]
        return (c[:, None] > c[None]).sum(1) + ((c[:, None] == c[None]).sum(1) + 1) / 2

    got = kn.representation_similarity(df, "id", "a", "b", ["g"], places=9).first()
    assert got.pairs == len(at[0]) == 600 and got.rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-12)
    assert max(sizes) <= 50  # vectors and their blocks, no pairs


def test_halves_of_a_unit_need_no_window_over_it(spark):
    rows = [(u, i, [float(i)]) for u, n in ((1, 41), (2, 4), (3, 3), (None, 6)) for i in range(n)]
    made = kn.halves(spark.createDataFrame(rows, "unit int, id long, v array<double>").repartition(5), "unit", "id", "v")
    want = {}
    for u in (1, 2, None):
        mine = sorted((int(hashlib.md5((f"half:{u}:{i}" if u else f"half:{i}").encode()).hexdigest()[:8], 16), i) for w, i, _ in rows if w == u)
        half = len(mine) // 2
        want |= {(u, i): int(k >= half) for k, (_, i) in enumerate(mine[: 2 * half])}
    assert {(r.unit, r.id): r._g for r in made.collect()} == want and made.count() == len(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*?)(?: ASC|, specified)", plan)
    assert windows and all("__part" in w for w in windows)
