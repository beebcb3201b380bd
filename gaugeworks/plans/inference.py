"""Queries of resampling and two-sample tests (SURVEY H)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import curves as cv
from ..operators import inference as nf
from ..operators import kernels as kn
from ..operators import ordering as od
from ..operators import resampling as rs
from .bindings import CURVES, VECTORS, r6, table, vectors
from .catalog import query
from .draws import B, ci, draws
from .curves import COMMIT, CROSSED, crossed, curves, statuses

UNITS = f"{CURVES}, v AS (SELECT axis, unit, avg(gain) AS v FROM curves GROUP BY ALL)"


@query("h01_bootstrap_mean", f"""WITH {UNITS}, {draws("v", "boot")}, rp AS (SELECT axis, b, sum(w * v) / nullif(sum(w) FILTER (v IS NOT NULL), 0) AS m FROM wt JOIN v USING (unit) GROUP BY ALL), c AS ({ci("m", "rp")})
 SELECT axis, round(point, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n FROM c JOIN (SELECT axis, count(v) AS n FROM v GROUP BY axis) USING (axis)""")
def h01(spark, d):
    got = rs.bootstrap_mean(curves(spark, d), ["axis"], "unit", "gain", B, "boot")
    return got.select("axis", r6("mean"), r6("ci_low"), r6("ci_high"), "n")


MEDIAN_OF = f"""{UNITS}, {draws("v", "stat", 20)}, o AS (SELECT axis, b, v, w, sum(w) OVER (PARTITION BY axis, b ORDER BY v, unit) AS hi, sum(w) OVER (PARTITION BY axis, b) AS n FROM wt JOIN v USING (unit) WHERE b >= 0 AND w > 0),
 rp AS (SELECT axis, b, (min(v) FILTER (hi >= (n + 1) // 2) + min(v) FILTER (hi >= n // 2 + 1)) / 2 AS m FROM o GROUP BY ALL), c AS ({ci("m", "rp")})"""


@query("h02_bootstrap_statistic", f"WITH {MEDIAN_OF} SELECT axis, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, replicates FROM c")
def h02(spark, d):
    v = curves(spark, d).groupBy("axis", "unit").agg(F.avg("gain").alias("v"))
    return rs.bootstrap_statistic(v, ["axis"], "unit", "v", lambda x: float(np.median(x)), 20).select("axis", r6("ci_low"), r6("ci_high"), "replicates")


@query("h03_window_ci", f"""WITH {CROSSED}, {draws("x", "win")}, rp AS (SELECT axis, b, sum(w * c) / nullif(sum(w) FILTER (c IS NOT NULL), 0) AS m FROM wt JOIN x USING (unit) GROUP BY ALL), c AS ({ci("m", "rp")})
 SELECT axis, round(point, 6) AS s_hat, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n, crossed, n < 30 AS underpowered FROM c JOIN (SELECT axis, count(*) AS n, count(c) AS crossed FROM x GROUP BY axis) USING (axis)""")
def h03(spark, d):
    got = rs.crossing_windows(crossed(spark, d), ["axis"], value="c", n_boot=B, seed="win", min_n=30)
    return got.select("axis", r6("s_hat"), r6("ci_low"), r6("ci_high"), "n", "crossed", "underpowered")


@query("h04_gap_ci", f"""WITH {CROSSED}, {draws("x", "gap")}, rp AS (SELECT axis, b, sum(w * r) / nullif(sum(w) FILTER (r IS NOT NULL), 0) - sum(w * c) / nullif(sum(w) FILTER (c IS NOT NULL), 0) AS m FROM wt JOIN x USING (unit) GROUP BY ALL), c AS ({ci("m", "rp")})
 SELECT axis, round(point, 6) AS gap, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, replicates FROM c""")
def h04(spark, d):
    sums = rs.replicate_sums(crossed(spark, d), ["axis"], ["unit"], ["c", "r"], B, "gap")
    got = rs.windows(sums, ["axis"], rs.mean("r") - rs.mean("c"))
    return got.select("axis", r6("point", "gap"), r6("ci_low"), r6("ci_high"), "replicates")


@query("h05_balanced_bootstrap", f"""WITH x AS (SELECT doc_id AS unit, quality AS label, ((n_chars > 700)::INT = quality)::INT AS ok FROM labels JOIN documents USING (doc_id)), {draws("x", "bal", 2 * B)},
 r AS (SELECT b, label, sum(w * ok)::DOUBLE / nullif(sum(w), 0) AS rec FROM wt JOIN x USING (unit) WHERE b >= 0 GROUP BY ALL), v AS (SELECT b, avg(rec) AS m FROM r GROUP BY b HAVING count(rec) = 2), k AS (SELECT *, row_number() OVER (ORDER BY b) AS n FROM v)
 SELECT round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, count(*) AS replicates FROM k WHERE n <= {B}""")
def h05(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    x = x.select(F.col("doc_id").alias("unit"), F.col("quality").alias("label"), ((F.col("n_chars") > 700).cast("int") == F.col("quality")).cast("int").alias("ok"))
    sums = rs.replicate_sums(x, ["label"], ["unit"], ["ok"], 2 * B, "bal").where("b >= 0 and n > 0")
    valid = sums.groupBy("b").agg(F.avg(rs.mean("ok")).alias("m"), F.count(F.lit(1)).alias("k")).where("k = 2")
    kept = valid.withColumn("n", F.row_number().over(Window.orderBy("b"))).where(F.col("n") <= B)  # at most 2 B rows
    return rs.windows(kept, [], F.col("m")).select(r6("ci_low"), r6("ci_high"), "replicates")


@query("h06_survival_bootstrap", f"""WITH {COMMIT}, v AS (SELECT axis, unit, coalesce(c, 1.0) AS t, (c IS NOT NULL)::INT AS e FROM t JOIN ind USING (unit, axis) WHERE a_ind < 1 - 1e-9), {draws("v", "km")},
 k AS (SELECT axis, b, t, sum(w * e) AS ev, sum(w) AS n FROM wt JOIN v USING (unit) GROUP BY ALL HAVING sum(w) > 0), r AS (SELECT *, sum(n) OVER (PARTITION BY axis, b ORDER BY t DESC) AS risk FROM k), s AS (SELECT *, product(1 - ev / risk::DOUBLE) OVER (PARTITION BY axis, b ORDER BY t) AS surv FROM r),
 md AS (SELECT axis, b, min(CASE WHEN surv <= 0.5 + 1e-12 AND ev > 0 THEN t END) AS m FROM s GROUP BY ALL), q AS ({ci("m", "md")}) SELECT axis, round(point, 6) AS median, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, replicates FROM q""")
def h06(spark, d):
    v = statuses(spark, d).where("st <> 'determined'").select("axis", "unit", F.coalesce("c", F.lit(1.0)).alias("t"), (F.col("st") == "crossing").cast("int").alias("e"))
    sums = rs.replicate_sums(v, ["axis", "t"], ["unit"], ["e"], B, "km").where("n > 0")
    curve = cv.survival_of_counts(sums.select("axis", "b", "t", "n", F.col("sum_e").alias("events")), ["axis", "b"])
    got = rs.windows(cv.median_of_curve(curve, ["axis", "b"]), ["axis"], F.col("median"))
    return got.select("axis", r6("point", "median"), r6("ci_low"), r6("ci_high"), "replicates")


@query("h07_pair_weighted", f"""WITH {UNITS}, pr AS (SELECT a.axis, a.unit AS u, b.unit AS w2, abs(a.v - b.v) AS x FROM v a JOIN v b ON a.axis = b.axis AND b.unit = a.unit + 1), {draws("v", "pair")},
 rp AS (SELECT p.axis, x.b, sum(x.w * y.w * p.x) / nullif(sum(x.w * y.w) FILTER (p.x IS NOT NULL), 0) AS m FROM pr p JOIN wt x ON x.unit = p.u JOIN wt y ON y.unit = p.w2 AND y.b = x.b GROUP BY ALL), q AS ({ci("m", "rp")}) SELECT axis, round(point, 6) AS heterogeneity, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, ci_low > 0 AS significant FROM q""")
def h07(spark, d):
    v = curves(spark, d).groupBy("axis", "unit").agg(F.avg("gain").alias("v"))
    nxt = v.select("axis", F.col("unit").alias("w2"), (F.col("unit") - 1).alias("unit"), F.col("v").alias("y"))
    pairs = v.join(nxt, ["axis", "unit"]).select("axis", F.col("unit").alias("u"), "w2", F.abs(F.col("v") - F.col("y")).alias("x"))
    got = rs.windows(rs.replicate_sums(pairs, ["axis"], ["u", "w2"], ["x"], B, "pair"), ["axis"], rs.mean("x"))
    return got.select("axis", r6("point", "heterogeneity"), r6("ci_low"), r6("ci_high"), (F.col("ci_low") > 0).alias("significant"))


@query("h08_slope_bootstrap", f"""WITH {CURVES}, {draws("curves", "slope")}, m1 AS (SELECT axis, b, s, sum(w * gain) / nullif(sum(w) FILTER (gain IS NOT NULL), 0) AS g FROM curves JOIN wt USING (unit) GROUP BY ALL), rp AS (SELECT axis, b, regr_slope(g, s) AS m FROM m1 GROUP BY ALL), q AS ({ci("m", "rp")}) SELECT axis, round(point, 6) AS slope, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM q""")
def h08(spark, d):
    sums = rs.replicate_sums(curves(spark, d), ["axis", "s"], ["unit"], ["gain"], B, "slope")
    slopes = sums.groupBy("axis", "b").agg(F.regr_slope(rs.mean("gain"), F.col("s")).alias("m"))
    return rs.windows(slopes, ["axis"], F.col("m")).select("axis", r6("point", "slope"), r6("ci_low"), r6("ci_high"))


SHARES = """e AS (SELECT axis, unit, max(a_ind) AS i, arg_min(a_fork, s) AS f0, arg_max(a_fork, s) AS f1, min(CASE WHEN gain >= 0.7 THEN s END) AS c FROM curves GROUP BY ALL),
 v AS (SELECT axis, unit, i, greatest(0.0, least(1.0, f0 - i)) AS seed, greatest(0.0, least(1.0, f1 - f0)) AS traj, greatest(0.0, least(1.0, 1 - f1)) AS res, c FROM e)"""


@query("h09_determination_budget", f"""WITH {CURVES}, {SHARES}, {draws("v", "det")},
 rp AS (SELECT axis, b, {", ".join(f"sum(w * {c}) / nullif(sum(w) FILTER ({c} IS NOT NULL), 0) AS {c}" for c in ("i", "seed", "traj", "res", "c"))} FROM wt JOIN v USING (unit) GROUP BY ALL),
 {", ".join(f"q_{c} AS ({ci(c, 'rp')})" for c in ("i", "seed", "traj", "c"))}
 SELECT axis, n, round(q_i.point, 6) AS conditioning, round(q_i.ci_low, 6) AS cond_lo, round(q_i.ci_high, 6) AS cond_hi, round(q_seed.point, 6) AS seed, round(q_seed.ci_low, 6) AS seed_lo, round(q_seed.ci_high, 6) AS seed_hi, round(q_traj.point, 6) AS trajectory, round(q_traj.ci_low, 6) AS traj_lo, round(q_traj.ci_high, 6) AS traj_hi,
 round(residual, 6) AS residual, round(q_c.point, 6) AS s_commit, round(q_c.ci_low, 6) AS scommit_lo, round(q_c.ci_high, 6) AS scommit_hi FROM (SELECT axis, count(*) AS n, avg(res) AS residual FROM v GROUP BY axis) JOIN q_i USING (axis) JOIN q_seed USING (axis) JOIN q_traj USING (axis) JOIN q_c USING (axis)""")
def h09(spark, d):
    return rs.determination_budget(curves(spark, d), ["axis"], 0.7, B, "det").select(
        "axis", "n", *(r6(c) for c in ("conditioning", "cond_lo", "cond_hi", "seed", "seed_lo", "seed_hi", "trajectory", "traj_lo", "traj_hi", "residual", "s_commit", "scommit_lo", "scommit_hi")))


@query("h10_wilson", """WITH k AS (SELECT l_suppkey AS supp, count(*) FILTER (l_returnflag = 'R') AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM k)
 SELECT supp, round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z""")
def h10(spark, d):
    k = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = exprs.wilson(F.col("k"), F.col("n"))
    return k.select("supp", r6(low, "low"), r6(high, "high"))


@query("h11_clopper_pearson")
def h11(spark, d):
    k = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(F.col("l_discount") > 0.08).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = nf.clopper_pearson(F.col("k"), F.col("n"))
    return k.select("flag", "k", "n", low.alias("low"), high.alias("high"))


#: A vector's squares as probabilities; kernels are taken over the roots of probabilities.
ROOTS = f"{VECTORS}, q AS (SELECT vec_id, label, list_transform(v, lambda z: sqrt(z * z / n)) AS v FROM (SELECT *, list_sum(list_transform(v, lambda z: z * z)) AS n FROM vecs) WHERE n > 0)"
MMD = "avg(exp(-d2 / (2 * h))) FILTER (gi = 0 AND gj = 0) + avg(exp(-d2 / (2 * h))) FILTER (gi = 1 AND gj = 1) - 2 * avg(exp(-d2 / (2 * h))) FILTER (gi <> gj)"


def tests_sql(seed: str, n_perm: int) -> str:
    """CTEs from x (cell, grp, i, v): pr (pairs), h (bandwidth), o (cell, obs) and s (cell, p, m) of the permutations."""
    return f"""pr AS (SELECT a.cell, a.i, b.i AS j, a.grp AS gi, b.grp AS gj, list_distance(a.v, b.v) ** 2 AS d2 FROM x a JOIN x b ON a.cell = b.cell AND a.i < b.i), h AS (SELECT cell, median(sqrt(d2)) ** 2 AS h FROM pr GROUP BY cell),
 o AS (SELECT cell, {MMD} AS obs FROM pr JOIN h USING (cell) GROUP BY cell), n0 AS (SELECT cell, count(*) FILTER (grp = 0) AS n0 FROM x GROUP BY cell),
 pm AS (SELECT cell, i, p, (row_number() OVER (PARTITION BY cell, p ORDER BY ('0x' || substr(md5('{seed}:' || cell || ':' || p || ':' || i), 1, 8))::BIGINT, i) > n0)::INT AS g FROM x JOIN n0 USING (cell), (SELECT unnest(range({n_perm})) AS p)),
 z AS (SELECT pr.cell, p1.p, p1.g AS gi, p2.g AS gj, d2, h FROM pr JOIN h USING (cell) JOIN pm p1 ON p1.cell = pr.cell AND p1.i = pr.i JOIN pm p2 ON p2.cell = pr.cell AND p2.i = pr.j AND p2.p = p1.p), s AS (SELECT cell, p, {MMD} AS m FROM z GROUP BY ALL),
 pv AS (SELECT cell, max(obs) AS mmd2, (1 + count(*) FILTER (round(m, 9) >= round(obs, 9))) / (1.0::DOUBLE + count(*)) AS p_value FROM s JOIN o USING (cell) GROUP BY cell)"""


PERMS, GUARD_PERMS = 200, 60
CELLS = f"{ROOTS}, x AS (SELECT label // 2 AS cell, label % 2 AS grp, vec_id AS i, v FROM q), {tests_sql('perm', PERMS)}"


def roots(spark, d):
    return vectors(spark, d).withColumn("v", exprs.root_probabilities(F.col("v"))).where("v is not null")


def cells(spark, d):
    x = roots(spark, d).select(F.floor(F.col("label") / 2).cast("int").alias("cell"), (F.col("label") % 2).alias("grp"), "vec_id", "v")
    return kn.permutation_tests(x, ["cell"], "vec_id", "grp", "v", PERMS, "perm")


@query("h12_mmd", f"WITH {CELLS} SELECT cell, round(obs, 6) AS mmd2 FROM o")
def h12(spark, d):
    x = roots(spark, d).select(F.floor(F.col("label") / 2).cast("int").alias("cell"), (F.col("label") % 2).alias("grp"), "vec_id", "v")
    blocks = kn.kernel_blocks(x, ["cell"], "vec_id", "grp", "v", 0)
    return kn.mmd_permutations(blocks, ["cell"], kn.bandwidths(blocks, ["cell"])).select("cell", r6("mmd2"))


@query("h13_permutation_p", f"WITH {CELLS} SELECT cell, round(mmd2, 6) AS mmd2, round(p_value, 6) AS p_value FROM pv")
def h13(spark, d):
    return kn.p_values(cells(spark, d), ["cell"]).select("cell", r6("mmd2"), r6("p_value"))


@query("h14_null_calibration", f"WITH {CELLS} SELECT cell, round(quantile_cont(m, 0.95), 6) AS threshold FROM s GROUP BY cell")
def h14(spark, d):
    return cells(spark, d).where("p >= 0").groupBy("cell").agg(r6(F.percentile("mmd2", F.lit(0.95)), "threshold"))


@query("h15_power_control", f"""WITH {ROOTS}, un AS (SELECT DISTINCT label FROM q), prs AS (SELECT a.label AS u, b.label AS w FROM un a JOIN un b ON a.label < b.label),
 x AS (SELECT u || ':' || w AS cell, (label = w)::INT AS grp, vec_id AS i, v FROM prs JOIN q ON label IN (u, w)), {tests_sql('power', GUARD_PERMS)}
 SELECT count(*) AS pairs, round(avg((p_value < 0.05)::INT), 6) AS reject_rate, round(median(mmd2), 6) AS median, round(quantile_cont(mmd2, 0.95), 6) AS p95 FROM pv""")
def h15(spark, d):
    got = kn.power_control(roots(spark, d), "label", "vec_id", "v", GUARD_PERMS)
    return got.select("pairs", r6("reject_rate"), r6("median"), r6("p95"))


@query("h15_half_split_null", f"""WITH {ROOTS}, k AS (SELECT label AS cell, vec_id AS i, v, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('half:' || label || ':' || vec_id), 1, 8))::BIGINT, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM q),
 x AS (SELECT cell, (k >= n // 2)::INT AS grp, i, v FROM k WHERE n >= 4 AND k < 2 * (n // 2)), {tests_sql('half', GUARD_PERMS)},
 e AS (SELECT p_value AS p, sum(count(*)) OVER (ORDER BY p_value) AS upto, count(*) AS c, sum(count(*)) OVER () AS n FROM pv GROUP BY p_value), d AS (SELECT max(n)::BIGINT AS n, max(greatest(upto / n - p, p - (upto - c) / n)) AS ks FROM e), l AS (SELECT n, ks, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks AS x FROM d)
 SELECT n, round(ks, 6) AS ks, round(greatest(0, least(1, (SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * x * x)) FROM (SELECT unnest(range(1, 101)) AS k)))), 6) AS ks_p FROM l""")
def h15_null(spark, d):
    p = kn.half_split_p(roots(spark, d), "label", "vec_id", "v", GUARD_PERMS)
    return kn.uniformity(p).select(F.col("n").cast("long").alias("n"), r6("ks"), r6("ks_p"))


@query("h16_shift_test", """WITH x AS (SELECT o_orderpriority AS s, o_totalprice AS v, (o_orderstatus = 'F')::INT AS g FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS r FROM x)
 SELECT s, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, round(sum(r) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2.0, 1) AS u, count(*) FILTER (v > 400000) AS over, count(*) FILTER (v > 450000) AS far_over, max(v) AS worst FROM r GROUP BY s""".replace(" AS over,", ' AS "over",'))
def h16(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("s"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").cast("int").alias("g"))
    r = od.average_rank(o, "v", "r", ["s"])
    n1 = F.count_if(F.col("g") == 1)
    return r.groupBy("s").agg(n1.alias("n1"), F.count_if(F.col("g") == 0).alias("n0"), F.round(F.sum(F.when(F.col("g") == 1, F.col("r"))) - n1 * (n1 + 1) / 2, 1).alias("u"), F.count_if(F.col("v") > 400000).alias("over"), F.count_if(F.col("v") > 450000).alias("far_over"), F.max("v").alias("worst"))


@query("h16_shift_p")
def h16_p(spark, d):
    t = h16(spark, d)
    mean, var = F.col("n1") * F.col("n0") / 2, F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12
    return t.select("s", nf.normal_tail((F.col("u") - mean - 0.5) / F.sqrt(var)).alias("p_value"))

