"""Known answers of the verdict tables."""

import pytest

from gaugeworks.operators import decisions as de

WINDOWS = "k string, axis string, s_hat double, ci_low double, ci_high double, underpowered boolean"
READS = "k string, axis string, probe string, target string, s_hat double, underpowered boolean"
DECIDED = [
    # name, commit windows (axis, s, low, high, underpowered), read windows (axis, s, underpowered), alpha valid, tokens
    ("apart", [("a", 0.2, 0.15, 0.25, False), ("b", 0.6, 0.55, 0.65, False)], [("a", 0.25, False), ("b", 0.65, False)], True, ["GO_MAP", "GO_READOUT"]),
    ("together", [("a", 0.4, 0.3, 0.5, False), ("b", 0.43, 0.3, 0.5, False)], [("a", 0.45, False), ("b", 0.45, False)], True, ["STOP_ADSR", "GO_READOUT"]),
    ("late", [("a", 0.86, 0.85, 0.87, False), ("b", 0.95, 0.94, 0.96, False)], [("a", 0.9, False)], True, ["STOP_ADSR"]),
    ("lagging", [("a", 0.2, 0.1, 0.5, False), ("b", 0.4, 0.2, 0.6, False)], [("a", 0.5, False), ("b", 0.7, False)], True, ["GO_DIAGNOSTIC"]),
    ("unread", [("a", 0.2, 0.1, 0.5, False), ("b", 0.4, 0.2, 0.6, False)], [("a", None, False), ("b", 0.45, True)], True, ["GO_DIAGNOSTIC"]),
    ("lead", [("a", 0.4, 0.1, 0.5, False), ("b", 0.5, 0.2, 0.6, False)], [("a", 0.3, False), ("b", 0.4, False)], True, ["STOP_PROJECT"]),
    ("outlier", [("a", 0.2, 0.15, 0.25, False), ("b", 0.6, 0.55, 0.65, True)], [("a", 0.25, False)], True, ["STOP_ADSR", "GO_READOUT"]),
    ("nothing", [("a", None, None, None, False), ("b", 0.5, 0.4, 0.6, True)], [("b", 0.55, False)], True, ["STOP_PROJECT"]),
    ("limited", [("onset_timing", 0.2, 0.15, 0.25, False), ("b", 0.9, 0.88, 0.92, False)], [("onset_timing", 0.25, False), ("b", 0.95, False)], True, ["GO_MAP", "GO_READOUT", "GO_RESTRICTED"]),
    ("no width", [("a", 0.2, 0.2, 0.2, False), ("b", 0.6, 0.6, 0.6, False)], [("a", 0.2, False), ("b", 0.6, False)], True, ["GO_MAP", "GO_READOUT"]),
    ("alpha", [("a", 0.2, 0.1, 0.5, False), ("b", 0.4, 0.2, 0.6, False)], [("a", 0.5, False)], False, ["FORK_ALPHA_NO_VALID_OPERATING_POINT", "GO_DIAGNOSTIC"]),
]


def test_map_decision(spark):
    commit = [(name, *w) for name, ws, *_ in DECIDED for w in ws]
    read = [(name, axis, "p", "t", s, few) for name, _, rs, *_ in DECIDED for axis, s, few in rs]
    commit, read = spark.createDataFrame(commit, WINDOWS), spark.createDataFrame(read, READS)
    for valid in (True, False):
        got = {r.k: r.tokens for r in de.map_decision(commit, read, ["k"], valid).collect()}
        assert len(got) == len(DECIDED)
        for name, _, _, alpha, tokens in DECIDED:
            if alpha == valid:
                assert got[name] == tokens, name


@pytest.mark.parametrize(
    "trajectory, token, manifest, passed, tokens",
    [
        (True, "OK", True, [True] * 3 + [False], ["GO_MAPS_PHASE"]),
        (False, "OK", True, [True] * 4, ["NO_TRAJECTORY_ACCESS"]),
        (True, "FIX_SCORE_CONVERSION", True, [True] * 4, ["FIX_SCORE_CONVERSION"]),
        (True, "OK", False, [True] * 4, ["STOP_PROJECT"]),
        (True, "OK", True, [True, True, False, None], ["STOP_PROJECT"]),
        (False, "FIX_SCORE_CONVERSION", False, [False], ["NO_TRAJECTORY_ACCESS", "FIX_SCORE_CONVERSION", "STOP_PROJECT"]),
        (None, None, None, [], ["NO_TRAJECTORY_ACCESS", "UNVALIDATED", "STOP_PROJECT"]),
    ],
)
def test_feasibility(spark, trajectory, token, manifest, passed, tokens):
    c = spark.createDataFrame([("x", trajectory, token, manifest)], "k string, trajectory_ok boolean, validation_token string, manifest_ok boolean")
    r = spark.createDataFrame([("x", f"a{i}", p) for i, p in enumerate(passed)], "k string, axis string, passed boolean")
    got = de.feasibility(c, r, ["k"]).collect()
    assert [(x.tokens, x.reliable) for x in got] == [(tokens, sum(p is True for p in passed))]


def test_trend_verdict(spark):
    rows = []
    for key, trends in {"up": (1, 1, 1), "one down": (1, 1, -1), "flat": (1, 1, 0), "two": (1, 1)}.items():
        rows += [(key, f"q{i}", x, slope * x) for i, slope in enumerate(trends) for x in (1.0, 2.0, 4.0)]
    rows += [("short", f"q{i}", 1.0, 1.0) for i in range(3)]
    rows += [("gaps", f"q{i}", x, y) for i in range(3) for x, y in ((0.0, float("nan")), (1.0, 1.0), (2.0, 3.0), (3.0, None))]
    rows += [("tilted", f"q{i}", x, y) for i in range(3) for x, y in ((1.0, 1.0), (2.0, 0.0), (3.0, 9.0), (4.0, 0.5))]
    got = {r.k: r.verdict for r in de.trend_verdict(spark.createDataFrame(rows, "k string, q string, x double, y double"), ["k"], "q", "x", "y").collect()}
    none = "F1_INCONCLUSIVE"
    assert got == {"up": "F1_SUPPORTED", "one down": "F1_REFUTED", "flat": none, "two": none, "short": none, "gaps": "F1_SUPPORTED", "tilted": none}


def test_threshold_tokens(spark):
    from pyspark.sql import functions as F

    lit, none = F.lit, F.lit(None).cast("double")
    cols = {
        "b1": de.bridge_token(lit(0.5)), "b2": de.bridge_token(lit(0.2)), "b3": de.bridge_token(lit(0.19)),
        "c1": de.conditioning_token(lit(0.3), lit(0.2), lit(0.6)), "c2": de.conditioning_token(lit(0.5), lit(0.2), lit(0.9)), "c3": de.conditioning_token(lit(0.3), lit(0.2), none),
        "s1": de.seed_floor_token(lit(0.4), lit(0.2), lit(0.1)), "s2": de.seed_floor_token(lit(0.4), lit(0.2), lit(-0.1)), "s3": de.seed_floor_token(lit(0.25), lit(0.2), lit(0.1)), "s4": de.seed_floor_token(none, lit(0.2), none),
        "d1": de.categorical_token(lit(0.9), lit(3.0), 0.9, 1.5), "d2": de.categorical_token(lit(0.5), lit(1.4), 0.9, 1.5), "d3": de.categorical_token(lit(0.5), lit(2.0), 0.9, 1.5),
        "m1": de.material_token(lit(0.1), 0.2), "m2": de.material_token(lit(0.2), 0.2),
    }
    got = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()[0].asDict()
    assert list(got.values()) == [
        "BRIDGE_METHOD", "BRIDGE_PARTIAL", "BRIDGE_WEAK", "COND_BOTTLENECK", "COND_NOT_BOTTLENECK", "COND_NOT_BOTTLENECK",
        "SEED_FLOOR_CONFIRMED+SEED_AMPLIFICATION", "SEED_FLOOR_CONFIRMED", "SEED_AMPLIFICATION", "NO_SEED_FLOOR",
        "DEGENERATE", "DEGENERATE", "INFORMATIVE", "DEGENERATE", "INFORMATIVE",
    ]
