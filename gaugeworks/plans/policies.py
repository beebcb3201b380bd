"""Queries of samples, selection policies, probes and verdicts (SURVEY G, I, J, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import agreement as ag
from ..operators import curves as cv
from ..operators import decisions as de
from ..operators import ordering as od
from ..operators import policy as po
from ..operators import probes as pr
from ..operators import sampling as sm
from ..operators import verdicts as ve
from ..operators.resampling import CUTS
from .bindings import CURVES, RATED, documents_rated, measurements, r6, table, vectors
from ..sources.tables import dealt, written
from .catalog import query
from .curves import COMMIT, MIN_N, THETAS, WIN, commit_read, curves, sweep
from .draws import ci, draws


def u32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


RR = f"""p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {u32("'rr:' || doc_id")}, doc_id) AS k FROM documents), pick AS (SELECT doc_id, source FROM p ORDER BY k, {u32("'rr:' || source")}, source LIMIT 60)"""


def picked(spark, d):
    return sm.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 60, "rr")


@query("g01_round_robin", f"WITH {RR} SELECT doc_id, source FROM pick")
def g01(spark, d):
    return picked(spark, d)


SPLIT = f"CASE WHEN row_number() OVER (PARTITION BY {{0}} ORDER BY {u32(chr(39) + 'split:' + chr(39) + ' || doc_id')}, doc_id) <= round_even(count(*) OVER (PARTITION BY {{0}}) * 0.6, 0) THEN 'train' ELSE 'eval' END AS split"


@query("g02_split", f"SELECT doc_id, source, {SPLIT.format('source')} FROM documents")
def g02(spark, d):
    return sm.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.6, "split")


@query("g03_hash_modulo", "SELECT doc_id, (list_reduce(list_prepend(0, list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda x: ('0x' || x)::INT)), lambda a, x: (a * 16 + x) % 10))::INT AS bucket FROM documents")
def g03(spark, d):
    return table(spark, d, "documents").select("doc_id", sm.hash_modulo(F.col("doc_id").cast("string"), 10).alias("bucket"))


@query("g04_ceil_sample", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('audit|' || user_id || '|' || event_id), event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= ceil(n * 0.2)")
def g04(spark, d):
    return sm.ceil_sample(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 0.2, "audit")


@query("g05_frozen_manifest", f"WITH {RR}, k AS (SELECT pick.* FROM pick WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT doc_id, source, {SPLIT.format('source')}, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS pinned FROM k")
def g05(spark, d):
    labels = table(spark, d, "labels")
    pool = picked(spark, d).join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    split = sm.stratified_split(pool, "source", "doc_id", 0.6, "split")
    return split.join(labels.where("quality = 1").select("doc_id", F.lit(True).alias("pinned")), "doc_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


# Selection: an order's lines are the candidates of a unit.
#: c: candidates of an order are its suppliers, with two labels and two vectors; pool: which axes are right, and the reward.
POOL = """c AS (SELECT l_orderkey AS unit, l_suppkey AS cand, max(l_returnflag) AS flag, CASE WHEN max(l_quantity) < 25 THEN 'small' ELSE 'large' END AS size,
  [max(l_quantity) / 50, max(l_discount) * 10, max(l_tax) * 12] AS shape, [max(l_extendedprice) / 100000, max(l_quantity) / 50, max(l_discount) * 10, max(l_tax) * 12] AS f FROM lineitem GROUP BY ALL),
 n_ AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM c QUALIFY n > 1),
 mf AS (SELECT unit, flag AS maj FROM (SELECT unit, flag, row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, flag) AS k FROM n_ GROUP BY unit, flag) WHERE k = 1),
 ms AS (SELECT unit, size AS maj FROM (SELECT unit, size, row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, size) AS k FROM n_ GROUP BY unit, size) WHERE k = 1),
 tot AS (SELECT unit, [sum(shape[1]), sum(shape[2]), sum(shape[3])] AS shape, [sum(f[1]), sum(f[2]), sum(f[3]), sum(f[4])] AS f FROM n_ GROUP BY unit),
 cs AS (SELECT n_.unit, cand, flag, size, round(greatest(-1.0, least(1.0, list_cosine_similarity(n_.shape, tot.shape))), 9) AS sh, round(greatest(-1.0, least(1.0, list_cosine_similarity(n_.f, tot.f))), 9) AS score FROM n_ JOIN tot USING (unit)),
 th AS (SELECT unit, round(median(sh), 9) AS t, min(sh) AS lo, max(sh) AS hi FROM cs GROUP BY unit),
 p0 AS (SELECT cs.unit, cand, flag = mf.maj AS flag, size = ms.maj AS size, sh >= t AS shape, (sh - lo) / (hi - lo + 1e-12) AS shape_score, score FROM cs JOIN mf USING (unit) JOIN ms USING (unit) JOIN th USING (unit)),
 pool AS (SELECT *, flag AND size AND shape AS ok FROM p0)"""
AXES = ["flag", "size", "shape"]
GATES = [(0.25, ["flag"]), (0.5, ["size", "shape"])]
STEPS, TAU, TEMPERATURE, NOISE = 25, 0.98, 0.05, 0.2


def pool(spark, d):
    used = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    c = dealt(used, ["l_orderkey"]).groupBy(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("cand")).agg(
        F.max("l_returnflag").alias("flag"), F.when(F.max("l_quantity") < 25, "small").otherwise("large").alias("size"),
        F.array(F.max("l_quantity") / 50, F.max("l_discount") * 10, F.max("l_tax") * 12).alias("shape"),
        F.array(F.max("l_extendedprice") / 100000, F.max("l_quantity") / 50, F.max("l_discount") * 10, F.max("l_tax") * 12).alias("f"))
    return po.build_pool(c, ["flag", "size"], ["shape"], "f")


def top(source: str, policy: str) -> str:
    return f"""SELECT unit, cand, ok, score, '{policy}' AS policy FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, {u32("'tie:' || unit || ':' || cand")}, cand) AS p_ FROM {source}) WHERE p_ = 1"""


PLACE = "row_number() OVER (PARTITION BY unit ORDER BY " + u32("'{0}:' || unit || ':' || cand") + ", cand)"
BUDGET = f"bud AS (SELECT * EXCLUDE (k) FROM (SELECT *, {PLACE.format('bok')} AS k FROM pool) WHERE k <= 2)"
PRUNE = f"prn AS (SELECT * EXCLUDE (k, n) FROM (SELECT *, {PLACE.format('half')} AS k, count(*) OVER (PARTITION BY unit) AS n FROM pool) WHERE k > least(round_even(n * 0.5, 0), n - 1))"
THRESH = f"thr AS (SELECT * EXCLUDE (a, r) FROM (SELECT *, bool_or(score >= {TAU}) OVER (PARTITION BY unit) AS a, row_number() OVER (PARTITION BY unit ORDER BY score DESC, cand) AS r FROM pool) WHERE CASE WHEN a THEN score >= {TAU} ELSE r = 1 END)"


def soft(draws: str) -> str:
    return f"""sf AS (SELECT *, exp((score - max(score) OVER (PARTITION BY unit)) / {TEMPERATURE}) AS e FROM pool), sc AS (SELECT *, sum(e) OVER (PARTITION BY unit ORDER BY cand) / sum(e) OVER (PARTITION BY unit) AS hi FROM sf), sl AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY unit ORDER BY cand), 0) AS lo FROM sc),
 dr AS (SELECT unit, {u32("'smc:' || unit || ':' || i")} / 4294967296.0::DOUBLE AS u FROM (SELECT unit, unnest({draws}) AS i FROM (SELECT unit, count(*) AS n FROM pool GROUP BY unit))), sof AS (SELECT * EXCLUDE (e, hi, lo) FROM sl WHERE EXISTS (SELECT 1 FROM dr WHERE dr.unit = sl.unit AND u >= lo AND u < hi))"""


def gates_sql(flag: str, size: str, shape: str, out: str, source: str = "pool") -> str:
    """CTE ``out``: the pool with k (kept), nfe and sc (scored) of the two gates, by the three named columns."""
    return f"""{out}1 AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n0, bool_or({flag}) OVER (PARTITION BY unit) AS a1, row_number() OVER (PARTITION BY unit ORDER BY score DESC, cand) AS r1 FROM {source}), {out}2 AS (SELECT *, CASE WHEN n0 <= 1 THEN true WHEN a1 THEN {flag} ELSE r1 = 1 END AS k1 FROM {out}1),
 {out}3 AS (SELECT *, sum(k1::INT) OVER (PARTITION BY unit) AS n1, bool_or(k1 AND {size} AND {shape}) OVER (PARTITION BY unit) AS a2, row_number() OVER (PARTITION BY unit ORDER BY k1 DESC, score DESC, cand) AS r2 FROM {out}2),
 {out} AS (SELECT * EXCLUDE (n0, a1, r1, k1, n1, a2, r2), CASE WHEN n1 <= 1 THEN k1 WHEN a2 THEN k1 AND {size} AND {shape} ELSE r2 = 1 END AS k, CASE WHEN NOT k1 THEN 6 WHEN n1 > 1 AND NOT CASE WHEN a2 THEN {size} AND {shape} ELSE r2 = 1 END THEN 12 ELSE 25 END AS nfe,
  (n0 > 1)::INT + (k1 AND n1 > 1)::INT + (CASE WHEN n1 <= 1 THEN k1 WHEN a2 THEN k1 AND {size} AND {shape} ELSE r2 = 1 END)::INT AS sc FROM {out}3)"""


@query("i01_pool", f"WITH {POOL} SELECT unit, cand, flag, size, shape, round(shape_score, 6) AS shape_score, ok, score FROM pool")
def i01(spark, d):
    return pool(spark, d).select("unit", "cand", "flag", "size", "shape", r6("shape_score"), "ok", "score")


@query("i02_gates", f"WITH {COMMIT}, m1 AS (SELECT axis, avg(c) AS c FROM t GROUP BY axis), g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]) AS s), x AS (SELECT axis, min(s)::DOUBLE AS gate FROM m1, g WHERE s >= c GROUP BY axis) SELECT gate, string_agg(axis, ',' ORDER BY axis) AS axes FROM x GROUP BY gate")
def i02(spark, d):
    m = commit_read(spark, d).groupBy("axis").agg(F.avg("c").alias("s_commit"))
    return po.gates_from_commit(m, (0.2, 0.4, 0.6, 0.8, 1.0)).select("gate", F.array_join("axes", ",").alias("axes"))


@query("i03_best_of_n", f"WITH {POOL} SELECT unit, cand, ok FROM ({top('pool', 'bon')})")
def i03(spark, d):
    return po.best(pool(spark, d), "bon").select("unit", "cand", "ok")


@query("i04_budgeted", f"WITH {POOL}, {BUDGET} SELECT unit, cand, ok FROM ({top('bud', 'bok')})")
def i04(spark, d):
    return po.best(po.budgeted(pool(spark, d), 2, "bok"), "bok").select("unit", "cand", "ok")


@query("i05_random_prune", f"WITH {POOL}, {PRUNE} SELECT unit, cand FROM prn")
def i05(spark, d):
    return po.random_prune(pool(spark, d), 0.5, "half").select("unit", "cand")


@query("i05_threshold", f"WITH {POOL}, {THRESH} SELECT unit, cand FROM thr")
def i05_threshold(spark, d):
    return po.never_empty(pool(spark, d), F.col("score") >= TAU).select("unit", "cand")


@query("i05_softmax_resample", f"WITH {POOL}, {soft('range(3)')} SELECT unit, cand FROM sof")
def i05_softmax(spark, d):
    return po.softmax_resample(pool(spark, d), 3, TEMPERATURE, "smc").select("unit", "cand")


@query("i06_funnel", f"WITH {POOL}, {gates_sql('flag', 'size', 'shape', 'g')}, gk AS (SELECT * FROM g WHERE k) SELECT unit, cand, ok, cost FROM ({top('gk', 'funnel')}) JOIN (SELECT unit, sum(nfe)::BIGINT AS cost FROM g GROUP BY unit) USING (unit)")
def i06(spark, d):
    rows = po.gated(pool(spark, d), GATES, STEPS).withColumn("cost", F.sum("nfe").over(Window.partitionBy("unit"))).where("kept")  # one pass: no second one for the costs
    return po.best(rows, "funnel").select("unit", "cand", "ok", F.col("cost").cast("long").alias("cost"))


def read_as(axis: str) -> str:
    return f"({axis} <> ({u32(chr(39) + 'noise:' + axis + ':' + chr(39) + ' || unit || ' + chr(39) + ':' + chr(39) + ' || cand')} / 4294967296.0::DOUBLE < {NOISE}))"


#: out: outcomes (unit, policy, ...) of every policy, as the replay operator gives them.
OUTCOMES = f"""{POOL}, {gates_sql('flag', 'size', 'shape', 'g')}, {soft('range(1, n + 1)')}, rd AS (SELECT *, {read_as('flag')} AS rf, {read_as('size')} AS rz, {read_as('shape')} AS rs FROM pool), {gates_sql('rf', 'rz', 'rs', 'ng', 'rd')},
 b AS (SELECT g.*, count(*) OVER w AS n, {PLACE.format('bok')} AS bk, {PLACE.format('half')} AS hf, sum(nfe) OVER w AS paid, bool_or(score >= {TAU}) OVER w AS a, row_number() OVER (PARTITION BY unit ORDER BY score DESC, cand) AS r, row_number() OVER (PARTITION BY unit ORDER BY ok DESC, score DESC, cand) AS rc FROM g WINDOW w AS (PARTITION BY unit)),
 fl AS (SELECT unit, cand, policy, kept, nfe, sc FROM (
   SELECT unit, cand, unnest(['full_bon', 'final_rerank']) AS policy, true AS kept, 25 AS nfe, 1 AS sc FROM b
   UNION ALL SELECT unit, cand, 'same_compute_bon', bk <= greatest(1, least(n, ceil(paid / 25.0))), CASE WHEN bk <= greatest(1, least(n, ceil(paid / 25.0))) THEN 25 ELSE 0 END, (bk <= greatest(1, least(n, ceil(paid / 25.0))))::INT FROM b
   UNION ALL SELECT unit, cand, policy, kept, CASE WHEN kept THEN 25 ELSE 6 END, 1 + kept::INT FROM (SELECT unit, cand, 'random_prune' AS policy, hf > least(round_even(n * 0.5, 0), n - 1) AS kept FROM b UNION ALL SELECT unit, cand, 'diffrs_scalar', CASE WHEN a THEN score >= {TAU} ELSE r = 1 END FROM b UNION ALL SELECT b.unit, b.cand, 'smc_scalar', s.cand IS NOT NULL FROM b LEFT JOIN sof s ON s.unit = b.unit AND s.cand = b.cand)
   UNION ALL SELECT unit, cand, 'oracle_axis_gated', k, nfe, sc FROM g UNION ALL SELECT unit, cand, 'non_oracle_axis_gated', k, nfe, sc FROM ng)),
 j AS (SELECT fl.*, b.ok, b.flag, b.size, b.shape, b.score, b.r, b.rc, row_number() OVER (PARTITION BY fl.unit, policy ORDER BY kept DESC, score DESC, {u32("'tie:' || fl.unit || ':' || fl.cand")}, fl.cand) AS w FROM fl JOIN b ON b.unit = fl.unit AND b.cand = fl.cand),
 out AS (SELECT unit, policy, max(cand) FILTER (w = 1) AS winner, bool_or(w = 1 AND ok) AS correct, bool_or(w = 1 AND flag) AS c_flag, bool_or(w = 1 AND size) AS c_size, bool_or(w = 1 AND shape) AS c_shape, sum(kept::INT) AS completed, sum(nfe) AS nfe, sum(sc) AS sc, bool_or(kept AND r = 1) AS retained, bool_or(NOT kept AND ok AND rc = 1) AS fp, bool_or(ok)::INT - bool_or(w = 1 AND ok)::INT AS regret FROM j GROUP BY unit, policy)"""


def outcomes(spark, d):
    return po.replay(dealt(written(pool(spark, d)), ["unit"], 200_000), GATES, AXES, STEPS, TAU, TEMPERATURE, 0.5, NOISE)


@query("i07_policy_metrics", f"""WITH {OUTCOMES} SELECT policy, count(*) AS n_units, round(avg(correct::INT), 6) AS correctness, round(avg(c_flag::INT), 6) AS correct_flag, round(avg(c_size::INT), 6) AS correct_size, round(avg(c_shape::INT), 6) AS correct_shape, round(avg(completed), 6) AS completed, sum(nfe)::BIGINT AS total_nfe,
 sum(sc)::BIGINT AS scoring_calls, round(avg(retained::INT), 6) AS winner_retention, round(avg(fp::INT), 6) AS false_prune_rate, round(avg(regret), 6) AS regret FROM out GROUP BY policy""")
def i07(spark, d):
    m = po.policy_metrics(outcomes(spark, d), AXES)
    exact = ("policy", "n_units", "total_nfe", "scoring_calls")
    return m.select(*exact, *(r6(c) for c in m.columns if c not in exact))


@query("i08_noisy_gates", f"""WITH {POOL}, nz AS (SELECT unit * 100 + rep AS unit, cand, score, ok, rep, flag <> ({u32("'noise:' || (unit * 100 + rep) || ':' || cand")} / 4294967296.0::DOUBLE >= 0.8) AS ax FROM pool, (SELECT unnest(range(5)) AS rep)), g AS (SELECT * FROM (SELECT *, bool_or(ax) OVER (PARTITION BY unit) AS a, row_number() OVER (PARTITION BY unit ORDER BY score DESC, cand) AS r FROM nz) WHERE CASE WHEN a THEN ax ELSE r = 1 END), b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, {u32("'tie:' || unit || ':' || cand")}, cand) AS p FROM g)
 SELECT rep, count(*) AS n, round(avg(ok::INT), 6) AS correctness FROM b WHERE p = 1 GROUP BY rep""")
def i08(spark, d):
    p = pool(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("unit", F.col("unit") * 100 + F.col("rep"))
    flip = exprs.draw("noise", "unit", "cand") / float(1 << 32) >= 0.8
    kept = po.never_empty(p.withColumn("ax", F.col("flag") != flip), F.col("ax"))
    return po.best(kept, "noisy").groupBy("rep").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("ok").cast("int")), "correctness"))


@query("i09_headroom_recovery", f"""WITH {OUTCOMES}, lg AS (SELECT unit, policy, unnest([{{'m': 'correct', 'x': correct::INT}}, {{'m': 'flag', 'x': c_flag::INT}}, {{'m': 'size', 'x': c_size::INT}}, {{'m': 'shape', 'x': c_shape::INT}}]) AS e FROM out WHERE policy NOT IN ('final_rerank', 'random_prune')), {draws("out", "recovery", 200)},
 mb AS (SELECT policy, e.m AS measure, b, sum(w * e.x)::DOUBLE / nullif(sum(w), 0) AS x FROM lg JOIN wt USING (unit) GROUP BY ALL), pb AS (SELECT measure, b, max(x) FILTER (policy = 'non_oracle_axis_gated') AS x, max(x) FILTER (policy = 'oracle_axis_gated') AS top, max(x) FILTER (policy NOT LIKE '%gated') AS floor FROM mb GROUP BY ALL),
 rp AS (SELECT measure, b, floor, CASE WHEN top - floor > 1e-9 THEN greatest(0.0, least(1.0, (x - floor) / (top - floor))) END AS m FROM pb), cw AS ({ci("m", "rp", "measure")})
 SELECT measure, round(point, 6) AS recovery, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(floor, 6) AS floor, replicates FROM cw JOIN (SELECT measure, floor FROM rp WHERE b = -1) USING (measure)""")
def i09(spark, d):
    got = po.headroom_recovery(outcomes(spark, d), AXES, n_boot=200)
    return got.select("measure", r6("recovery"), r6("ci_low"), r6("ci_high"), r6("floor"), "replicates")


# Probes


@query("j01_ridge_probe")
def j01(spark, d):
    return pr.ridge_probe(vectors(spark, d), "v", "label", "vec_id % 5 < 3", list(range(10)))


def layered(spark, d):
    """Quarters of a vector as layers; the second half of the steps sees them twice as clearly (noise by hash halved)."""
    v = vectors(spark, d)
    noise = lambda i, s: F.transform(F.slice("v", 1 + 16 * i, 16), lambda x: x + (0.6 - 0.5 * s) * (exprs.draw("noise", F.lit(i), F.lit(s), "vec_id") / float(1 << 32) - 0.5))
    cells = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(s).alias("s"), noise(i, s).alias("x")) for i in range(4) for s in (0.2, 0.9)])
    return v.select("vec_id", "label", F.explode(cells).alias("l")).select("vec_id", "label", "l.layer", "l.s", "l.x")


@query("j02_probe_sweep")
def j02(spark, d):
    return pr.probe_sweep(layered(spark, d), "x", "label", "vec_id % 5 < 3", list(range(10)), hidden=64, epochs=25)


@query("j03_mlp_probe")
def j03(spark, d):
    got = pr.mlp_predictions(vectors(spark, d), "v", "label", "vec_id % 5 < 3", list(range(10)), epochs=40)
    return got.agg(F.avg(pr.right("label")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("j04_random_projection")
def j04(spark, d):
    return pr.gaussian_projection(vectors(spark, d).select("vec_id", "v"), "v", 64, 8, 11).select("vec_id", "projected")


@query("j05_probe_settings")
def j05(spark, d):
    p = pr.gaussian_projection(vectors(spark, d), "v", 64, 16, 5).withColumn("unit", F.floor(F.col("vec_id") / 5))
    sets = F.array(F.struct(F.lit("raw").alias("setting"), F.slice("v", 1, 16).alias("x")), F.struct(F.lit("projected").alias("setting"), F.col("projected").alias("x")))
    each = written(p.select("vec_id", "unit", "label", F.explode(sets).alias("s")).select("vec_id", "unit", "label", "s.setting", "s.x"))
    got = pr.ridge_predictions(each, "x", "label", "unit % 5 < 3", list(range(10)), keys=["setting"], keep=["unit"])
    return pr.probe_report(got, each.where("unit % 5 < 3"), "label", ["setting"], "unit")


# Verdicts


@query("k01_feasibility", f"""WITH {RATED}, g AS (SELECT source, lang, avg((a = b)::INT) >= 0.6 AS ok FROM rated GROUP BY ALL), n AS (SELECT source, count(*) FILTER (ok) AS reliable FROM g GROUP BY source),
 c AS (SELECT source, count(*) >= 20 AS trajectory, avg(toxic) <= 0.1 AS valid, min(n_chars) > 50 AS manifest FROM rated GROUP BY source),
 t AS (SELECT source, reliable, concat_ws(';', CASE WHEN NOT trajectory THEN 'NO_TRAJECTORY_ACCESS' END, CASE WHEN NOT valid THEN 'FIX_SCORE_CONVERSION' END, CASE WHEN NOT manifest OR reliable < 2 THEN 'STOP_PROJECT' END) AS tokens FROM c JOIN n USING (source))
 SELECT source, CASE WHEN tokens = '' THEN 'GO_MAPS_PHASE' ELSE tokens END AS tokens, reliable FROM t""")
def k01(spark, d):
    rows = documents_rated(spark, d)
    g = rows.groupBy("source", F.col("lang").alias("axis")).agg((F.avg((F.col("a") == F.col("b")).cast("int")) >= 0.6).alias("passed"))
    valid = F.when(F.avg("toxic") <= 0.1, "OK").otherwise("FIX_SCORE_CONVERSION")
    c = rows.groupBy("source").agg((F.count(F.lit(1)) >= 20).alias("trajectory_ok"), valid.alias("validation_token"), (F.min("n_chars") > 50).alias("manifest_ok"))
    return de.feasibility(c, g, ["source"], 2).withColumn("tokens", F.array_join("tokens", ";"))


#: rd: per theta and axis the mean interpolated point at which the fork agreement reaches theta, and whether it has few units.
READS = f"""lr_ AS (SELECT unit, axis, s, a_fork, lag(s) OVER w AS ps, lag(a_fork) OVER w AS pf FROM curves WINDOW w AS (PARTITION BY unit, axis ORDER BY s)),
 xr AS (SELECT theta, unit, axis, arg_min(CASE WHEN ps IS NULL THEN s ELSE ps + (theta - pf) / (a_fork - pf) * (s - ps) END, s) FILTER (a_fork >= theta AND (pf IS NULL OR pf < theta)) AS r FROM lr_, th GROUP BY ALL), rd AS (SELECT theta, axis, avg(r) AS rs, count(*) < {MIN_N} AS few_r FROM xr GROUP BY ALL)"""


def read_windows(spark, d):
    names = {f"t{i}": t for i, t in enumerate(THETAS)}
    found = cv.interpolated_crossings(curves(spark, d), ["axis", "unit"], {n: ("a_fork", t) for n, t in names.items()})
    each = found.select("axis", "unit", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("theta"), F.col(n).alias("r")) for n, t in names.items()))).alias("x")).select("axis", "unit", "x.*")
    return each.groupBy("theta", "axis").agg(F.avg("r").alias("s_hat"), (F.count(F.lit(1)) < MIN_N).alias("underpowered"))


@query("k02_map_decision", f"""WITH {WIN}, {READS},
 v AS (SELECT theta, axis, s_hat AS s, ci_low AS lo, ci_high AS hi, rs, rs IS NOT NULL AND NOT few_r AS has, rs - s_hat AS lag FROM ws JOIN rd USING (theta, axis)),
 o AS (SELECT theta, bool_and(coalesce(hi <= nxt, true)) AS ordered FROM (SELECT theta, hi, lead(lo) OVER (PARTITION BY theta ORDER BY s, axis) AS nxt FROM v) GROUP BY theta),
 f AS (SELECT theta, count(*) AS n, max(s) - min(s) AS spread, min(s) >= 0.85 AS near_end, avg(hi - lo) AS width, bool_or(has AND s < 0.85 AND rs < 0.8 AND lag BETWEEN -0.05 AND 0.15) AS readout,
  bool_or(axis LIKE '%disc%' AND has AND s < 0.85 AND rs < 0.8 AND lag BETWEEN -0.05 AND 0.15) AS limited_read, bool_or(s < 0.85 AND axis NOT LIKE '%disc%') AS other_early, bool_or(CASE WHEN has THEN lag > 0.15 ELSE s < 0.85 END) AS lags FROM v GROUP BY theta),
 t AS (SELECT theta, concat_ws(';', CASE WHEN n IS NULL THEN 'STOP_PROJECT' END, CASE WHEN spread <= 0.05 OR near_end THEN 'STOP_ADSR' END,
  CASE WHEN n >= 2 AND spread > 0.05 AND NOT near_end AND ordered AND (width <= 1e-9 OR spread / width > 1) THEN 'GO_MAP' END, CASE WHEN readout THEN 'GO_READOUT' END, CASE WHEN limited_read AND NOT other_early THEN 'GO_RESTRICTED' END, CASE WHEN lags THEN 'GO_DIAGNOSTIC' END) AS tokens
  FROM (SELECT DISTINCT theta FROM w) LEFT JOIN f USING (theta) LEFT JOIN o USING (theta))
 SELECT theta, CASE WHEN tokens = '' THEN 'STOP_PROJECT' ELSE tokens END AS tokens FROM t""")
def k02(spark, d):
    reads = read_windows(spark, d).select("theta", "axis", F.lit("labels").alias("probe"), F.lit("fork").alias("target"), "s_hat", "underpowered")
    got = de.map_decision(written(sweep(spark, d)[0]), reads, ["theta"], restricted=("disc",))
    return got.select("theta", F.array_join("tokens", ";").alias("tokens"))


@query("k02_phase_tokens", f"""WITH {WIN}, {READS}, a AS (SELECT theta, axis, s_hat, ci_low, ci_high FROM w WHERE s_hat IS NOT NULL), nx AS (SELECT *, round(theta + 0.1, 1)::DOUBLE AS nxt FROM a),
 oa AS (SELECT theta, string_agg(axis, '<' ORDER BY s_hat, axis) AS ord FROM a GROUP BY theta), ob AS (SELECT n.theta, string_agg(n.axis, '<' ORDER BY b.s_hat, b.axis) AS ord FROM nx n JOIN a b ON b.theta = n.nxt AND b.axis = n.axis GROUP BY n.theta),
 ap AS (SELECT theta, bool_and(coalesce(ci_high < nlo, true)) AND count(*) >= 2 AS ordered FROM (SELECT *, lead(ci_low) OVER (PARTITION BY theta ORDER BY s_hat, axis) AS nlo FROM a) GROUP BY theta),
 rr AS (SELECT theta, bool_or(rs <= 0.85) AS readable FROM rd JOIN a USING (theta, axis) WHERE rs IS NOT NULL GROUP BY theta),
 j AS (SELECT theta, coalesce(ordered, false) AS ordered, CASE WHEN ob.ord IS NOT NULL THEN oa.ord = ob.ord END AS stable, coalesce(readable, false) AS readable FROM oa LEFT JOIN ob USING (theta) LEFT JOIN ap USING (theta) LEFT JOIN rr USING (theta))
 SELECT theta, ordered, stable, concat_ws(';', CASE WHEN ordered AND coalesce(stable, false) THEN 'GO_MAP' END, CASE WHEN readable THEN 'GO_READOUT' END, CASE WHEN NOT (ordered AND coalesce(stable, false)) THEN CASE WHEN ordered THEN 'GO_RESTRICTED' ELSE 'GO_DIAGNOSTIC' END END) AS tokens FROM j""")
def k02_phase(spark, d):
    """The windows of the next theta stand for the second setting."""
    w = written(sweep(spark, d)[0])
    second = w.withColumn("theta", F.round(F.col("theta") - 0.1, 1))
    got = ve.phase_tokens(w, second.join(w.select("theta").distinct(), "theta"), read_windows(spark, d), ["theta"])
    return got.select("theta", "ordered", "stable", F.array_join("tokens", ";").alias("tokens"))


@query("k01_self_target", f"""WITH {RATED}, g AS (SELECT lang AS axis, avg((a = b)::INT) AS determinism, avg(toxic) AS robustness FROM rated GROUP BY lang), p AS (SELECT *, determinism >= 0.6 AS d, robustness >= 0.12 AS r FROM g)
 SELECT axis, d AND r AS passed, CASE WHEN d AND r THEN 'self-target OK' ELSE 'self-target FAIL: ' || concat_ws(',', CASE WHEN NOT d THEN 'determinism' END, CASE WHEN NOT r THEN 'robustness' END) END AS reason, axis = 'de' AND d AND NOT r AS kept_diagnostic FROM p""")
def k01_self(spark, d):
    g = documents_rated(spark, d).groupBy(F.col("lang").alias("axis")).agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("determinism"), F.avg("toxic").alias("robustness"))
    return ve.self_target(g, 0.6, 0.12, diagnostic="de").select("axis", "passed", "reason", "kept_diagnostic")


GRID7 = "round(0.05 + (s * 7 - 1) * 0.85 / 6, 2)"
CONF = "sum(c) FILTER (label <> 'abstain')"
#: f and b: confident agreement of forks and independents as the micro-map sees them; em, eb: the axis disc as an embedding.
MICRO = f"""{CURVES}, cf AS (SELECT unit AS clip, axis, {GRID7} AS s, label, count(*) AS c FROM m WHERE role = 'fork' AND axis <> 'disc' GROUP BY ALL), ci_ AS (SELECT unit AS clip, axis, label, count(*) AS c FROM m WHERE role = 'independent' AND axis <> 'disc' GROUP BY ALL),
 f AS (SELECT clip, axis, s, coalesce({CONF}, 0) AS n_conf, CASE WHEN {CONF} >= 2 THEN (sum(c * (c - 1)) FILTER (label <> 'abstain'))::DOUBLE / ({CONF} * ({CONF} - 1)) END AS a_fork, 1 - coalesce({CONF}, 0)::DOUBLE / sum(c) AS abstain FROM cf GROUP BY clip, axis, s),
 b AS (SELECT clip, axis, coalesce({CONF}, 0) AS n_conf, CASE WHEN {CONF} >= 2 THEN (sum(c * (c - 1)) FILTER (label <> 'abstain'))::DOUBLE / ({CONF} * ({CONF} - 1)) END AS a_ind FROM ci_ GROUP BY clip, axis),
 em AS (SELECT unit AS clip, {GRID7} AS s, a_fork AS e FROM frk WHERE axis = 'disc'), eb AS (SELECT unit AS clip, a_ind AS e FROM ind WHERE axis = 'disc')"""


@query("k03_micromap_criteria", f"""WITH {MICRO}, sd AS (SELECT axis, avg(a_fork) FILTER (s = 0.9) AS late, avg(a_fork) FILTER (s = 0.05) AS early, count(*) FILTER (s = 0.9 AND n_conf >= 2) AS nl, count(*) FILTER (s = 0.05 AND n_conf >= 2) AS ne FROM f GROUP BY axis), ib AS (SELECT axis, avg(a_ind) AS i, count(*) FILTER (n_conf >= 2) AS ni FROM b GROUP BY axis),
 e1 AS (SELECT unnest(list_filter([CASE WHEN nl < 12 OR ne < 12 OR ni < 12 THEN axis || ': too few scorable clips' END, CASE WHEN NOT coalesce(late >= 0.9, false) THEN axis || ': late agreement too low' END, CASE WHEN early - i IS NULL THEN axis || ': early gap undefined' END, CASE WHEN early - i < -0.02 THEN axis || ': anti-correlation' END, CASE WHEN early - i > 0.25 THEN axis || ': near-deterministic from noise' END], lambda x: x IS NOT NULL)) AS r FROM sd JOIN ib USING (axis)),
 k AS (SELECT clip AS unit, max(em.e) FILTER (s = 0.05) - max(eb.e) AS fl, max(em.e) FILTER (s = 0.9) - max(em.e) FILTER (s = 0.05) AS gr, max(em.e) FILTER (s = 0.05) AS ea FROM em LEFT JOIN eb USING (clip) GROUP BY clip), {draws("k", "endpoints", 200)},
 rp AS (SELECT b, sum(w * fl) / nullif(sum(w) FILTER (fl IS NOT NULL), 0) AS fl, sum(w * gr) / nullif(sum(w) FILTER (gr IS NOT NULL), 0) AS gr, sum(w * ea) / nullif(sum(w) FILTER (ea IS NOT NULL), 0) AS ea FROM wt JOIN k USING (unit) WHERE b >= 0 GROUP BY b),
 q AS (SELECT quantile_cont(fl, 0.025) AS f_lo, quantile_cont(gr, 0.025) AS g_lo, (quantile_cont(ea, 0.975) - quantile_cont(ea, 0.025)) / 2 AS half FROM rp),
 e2 AS (SELECT unnest(list_filter([CASE WHEN NOT coalesce(f_lo > 0, false) THEN 'E1: floor interval holds 0' END, CASE WHEN NOT coalesce(half <= 0.05, false) THEN 'E1: floor unstable' END, CASE WHEN NOT coalesce(g_lo > 0, false) THEN 'E2: growth interval holds 0' END], lambda x: x IS NOT NULL)) AS r FROM q),
 cu AS (SELECT f.clip, axis, s, CASE WHEN a_ind >= 1 - 1e-9 THEN CASE WHEN a_fork IS NOT NULL THEN 0.0 END ELSE greatest(0.0, least(1.0, CASE WHEN a_fork IS NOT NULL THEN (a_fork - a_ind) / (1 - a_ind) END)) END AS g0, a_fork FROM f JOIN b USING (clip, axis) WHERE a_ind IS NOT NULL),
 st AS (SELECT clip AS unit, axis, s, CASE WHEN a_fork IS NOT NULL THEN g0 END - lag(CASE WHEN a_fork IS NOT NULL THEN g0 END) OVER (PARTITION BY clip, axis ORDER BY s) AS d FROM cu),
 wt2 AS (SELECT unit, b, ({" + ".join(f"(u >= {c})::INT" for c in CUTS)}) AS w FROM (SELECT unit, k * 16 + j AS b, ('0x' || substr(h, 4 * j + 1, 4))::INT AS u FROM (SELECT unit, k, sha256('monotone:' || unit || ':' || k) AS h FROM (SELECT DISTINCT unit FROM st), (SELECT unnest(range(13)) AS k)), (SELECT unnest(range(16)) AS j) WHERE k * 16 + j < 200) UNION ALL SELECT DISTINCT unit, -1, 1 FROM st),
 mr AS (SELECT axis, s, b, sum(w * d) / nullif(sum(w), 0) AS m FROM st JOIN wt2 USING (unit) WHERE d IS NOT NULL GROUP BY ALL), mw AS (SELECT axis, s, max(m) FILTER (b = -1) AS p, quantile_cont(m, 0.975) FILTER (b >= 0) AS hi FROM mr GROUP BY ALL),
 e3 AS (SELECT axis || ': falls before s=' || s AS r FROM mw WHERE p < -0.02 AND hi < -0.02), dt AS (SELECT axis, CASE WHEN axis = 'size' THEN 1.0 - avg(abstain) ELSE 1.0 END AS score FROM f GROUP BY axis), pn AS (SELECT avg((coalesce(a_ind, 0) > 0.9)::INT) >= 0.75 AS pinned FROM b WHERE axis = 'size'), sl AS (SELECT avg(abstain) > 0.3 AS silent FROM f WHERE axis = 'size' AND s = 0.9),
 al AS (SELECT 'endpoints' AS criterion, r FROM e1 UNION ALL SELECT 'endpoints', r FROM e2 UNION ALL SELECT 'monotonicity', r FROM e3 UNION ALL SELECT 'measurer_determinism', axis || ': not deterministic' FROM dt WHERE NOT score >= 1 - 1e-9 UNION ALL SELECT 'informativeness', 'pool pinned' FROM pn WHERE pinned UNION ALL SELECT 'informativeness', 'abstain cap exceeded' FROM sl WHERE silent)
 SELECT c.criterion, count(r) = 0 AS passed, coalesce(string_agg(r, ';' ORDER BY r), '') AS reasons FROM (SELECT unnest(['endpoints', 'monotonicity', 'kernel_headline', 'measurer_determinism', 'informativeness']) AS criterion) c LEFT JOIN al ON al.criterion = c.criterion GROUP BY c.criterion""")
def k03(spark, d):
    rows = measurements(spark, d).where("axis <> 'disc'").withColumn("s", F.round(0.05 + (F.col("s") * 7 - 1) * 0.85 / 6, 2)).withColumnRenamed("unit", "clip")
    forks = ag.confident_agreement(rows.where("role = 'fork'"), ["clip", "axis", "s"]).select("clip", F.lit(1.0).alias("cfg"), "axis", "s", F.col("agreement").alias("a_fork"), "n_conf", F.col("abstain_rate").alias("abstain"))
    base = ag.confident_agreement(rows.where("role = 'independent'"), ["clip", "axis"]).select("clip", F.lit(1.0).alias("cfg"), "axis", F.col("agreement").alias("a_ind"), "n_conf")
    disc = measurements(spark, d).where("axis = 'disc'")
    emb = ag.pairwise_agreement(disc.where("role = 'fork'"), ["unit", "s"]).select(F.col("unit").alias("clip"), F.lit(1.0).alias("cfg"), F.round(0.05 + (F.col("s") * 7 - 1) * 0.85 / 6, 2).alias("s"), F.col("agreement").alias("a_fork_emb"))
    emb_base = cv.baseline(disc).select(F.col("unit").alias("clip"), F.lit(1.0).alias("cfg"), F.col("a_ind").alias("a_ind_emb"))
    forks = written(forks)
    scores = forks.groupBy("axis").agg(F.when(F.col("axis") == "size", 1 - F.avg("abstain")).otherwise(1.0).alias("score"))
    gate = spark.createDataFrame([(True, True)], "passed boolean, early_ok boolean")
    got = ve.micromap_criteria(forks, written(base), emb, emb_base, scores, gate, class_axis="size", n_boot=200)
    return got.select("criterion", "passed", F.array_join("reasons", ";").alias("reasons"))


#: x: cells (cfg, s, clip) of statistics of orders, g: guards, t: thresholds per s.
ORDER_CELLS = """x AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 4.5 END::DOUBLE AS cfg, CASE WHEN o_orderstatus = 'F' THEN 0.05 ELSE 0.9 END::DOUBLE AS s, o_custkey % 16 AS clip, round(avg(o_totalprice) / 1e6, 9) AS mmd2, round(avg(month(o_orderdate)) / 12, 9) AS tv, avg((o_totalprice > 250000)::INT) AS p_value
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O') GROUP BY ALL), g AS (SELECT avg((o_totalprice > 1000)::INT) AS power_reject, median(o_totalprice) / 1e5 AS cross_median, NULL::DOUBLE AS cross_p95, 0.5 AS null_p FROM orders), t AS (SELECT s, quantile_cont(mmd2, 0.95) AS theta_mmd FROM x WHERE cfg = 1.0 GROUP BY s)"""


def order_cells(spark, d):
    o = table(spark, d, "orders")
    used = o.where("o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O')")
    cells = written(used.groupBy(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(4.5).alias("cfg"), F.when(F.col("o_orderstatus") == "F", 0.05).otherwise(0.9).alias("s"), (F.col("o_custkey") % 16).alias("clip")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 9).alias("mmd2"), F.round(F.avg(F.month("o_orderdate")) / 12, 9).alias("tv"), F.avg((F.col("o_totalprice") > 250000).cast("int")).alias("p_value")).withColumn("schedule", F.lit("constant")))
    guards = o.agg(F.avg((F.col("o_totalprice") > 1000).cast("int")).alias("power_reject")).join(od.quantiles(o, [], "o_totalprice", {"m": 0.5}).select((F.col("m") / 1e5).alias("cross_median"))).withColumns({"cross_p95": F.lit(None).cast("double"), "null_p": F.lit(0.5)})
    return cells, guards


@query("k04_exchangeability", f"""WITH {ORDER_CELLS}, c AS (SELECT cfg, s, count(*) AS n, count(*) FILTER (p_value < 0.05) AS low FROM x WHERE cfg = 1.0 GROUP BY ALL), ds AS (SELECT count(*) = 2 AND bool_and(n = 16) AS ok, coalesce(string_agg('low p at s=' || s, ';' ORDER BY s) FILTER (low > 2), '') AS failed FROM c),
 gd AS (SELECT power_reject >= 0.8 AND null_p >= 0.01 AND bool_and(theta_mmd > 0 AND theta_mmd <= 0.9 * cross_median) AS ok FROM g, t GROUP BY power_reject, null_p, cross_median)
 SELECT CASE WHEN ds.ok AND gd.ok AND failed = '' THEN 'CFG_KERNEL_OK(cfg=1)' ELSE 'CFG_KERNEL_FAIL(cfg=1)' END AS token, ds.ok AND gd.ok AND failed = '' AS passed, NOT (ds.ok AND gd.ok) AS underpowered FROM ds, gd""")
def k04(spark, d):
    cells, guards = order_cells(spark, d)
    null = cells.where("cfg = 1.0")
    thresholds = null.groupBy("s").agg(F.percentile("mmd2", F.lit(0.95)).alias("theta_mmd"))
    return ve.internal_null(null, guards, thresholds).select("token", "passed", "underpowered")


@query("k04_calibrated", f"""WITH {ORDER_CELLS}, v AS (SELECT cfg, s, e.k AS stat, e.x AS x FROM (SELECT cfg, s, unnest([{{'k': 'mmd', 'x': mmd2}}, {{'k': 'tv', 'x': tv}}]) AS e FROM x)), lm AS (SELECT s, stat, quantile_cont(x, 0.95) AS theta, count(*) AS n0 FROM v WHERE cfg = 1.0 GROUP BY ALL),
 ex AS (SELECT s, stat, count(*) AS n1, max(n0) AS n0, count(*) FILTER (x > theta) AS above, count(*) FILTER (x > least(3 * theta, CASE WHEN stat = 'tv' THEN 0.9 ELSE 1e300 END)) AS gross FROM v JOIN lm USING (s, stat) WHERE cfg = 4.5 GROUP BY ALL),
 r AS (SELECT s, stat, cfg, rank() OVER (PARTITION BY s, stat ORDER BY x) + (count(*) OVER (PARTITION BY s, stat, x) - 1) / 2.0::DOUBLE AS r FROM v), rs AS (SELECT s, stat, sum(r) FILTER (cfg = 4.5) AS r1 FROM r GROUP BY ALL), ti AS (SELECT s, stat, sum(t * t * t - t) AS ties FROM (SELECT s, stat, x, count(*)::DOUBLE AS t FROM v GROUP BY ALL) GROUP BY s, stat),
 z AS (SELECT s, stat, above, gross, (r1 - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n0 / 2.0::DOUBLE - 0.5) / sqrt(n1 * n0 / 12.0::DOUBLE * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM ex JOIN rs USING (s, stat) JOIN ti USING (s, stat)),
 wr AS (SELECT unnest(list_filter([CASE WHEN z > 2.3263478740408408 THEN stat || ':shift s=' || s END, CASE WHEN above > 3 THEN stat || ':exceedance s=' || s END, CASE WHEN gross > 0 THEN stat || ':gross s=' || s END], lambda x: x IS NOT NULL)) AS w FROM z), n AS (SELECT count(*) = 2 AND bool_and(n = 16) AS ok FROM (SELECT s, count(*) AS n FROM x WHERE cfg = 4.5 GROUP BY s)), j AS (SELECT n.ok, (SELECT coalesce(string_agg(w, ';' ORDER BY w), '') FROM wr) AS failed FROM n)
 SELECT CASE WHEN ok AND failed = '' THEN 'CFG_KERNEL_OK(cfg=4.5)' ELSE 'CFG_KERNEL_FAIL(cfg=4.5)' END AS token, ok AND failed = '' AS passed, NOT ok AS underpowered, CASE WHEN ok THEN failed ELSE 'cells per s are not 16' END AS reasons FROM j""")
def k04_calibrated(spark, d):
    cells, _ = order_cells(spark, d)
    got = ve.calibrated(cells.where("cfg = 4.5"), cells.where("cfg = 1.0"))
    return got.select("token", "passed", "underpowered", F.array_join("reasons", ";").alias("reasons"))


@query("k05_trend_verdict", f"""WITH {CURVES}, p AS (SELECT axis, s, unnest([{{'q': 'seed_predictability', 'y': avg(a_fork)}}, {{'q': 'alpha_star', 'y': avg(gain)}}, {{'q': 'seed_share', 'y': avg(a_fork - a_ind)}}]) AS e FROM curves GROUP BY axis, s),
 t AS (SELECT axis, e.q AS q, regr_slope(e.y, s) AS slope, arg_max(e.y, s) - arg_min(e.y, s) AS delta FROM p GROUP BY axis, e.q), c AS (SELECT axis, count(*) FILTER (slope > 1e-3 AND delta > 0) AS rising, count(*) FILTER (slope < -1e-3 AND delta < 0) AS falling FROM t GROUP BY axis)
 SELECT axis, CASE WHEN rising >= 3 THEN 'F1_SUPPORTED' WHEN falling > 0 THEN 'F1_REFUTED' ELSE 'F1_INCONCLUSIVE' END AS verdict, rising, falling FROM c""")
def k05(spark, d):
    means = curves(spark, d).groupBy("axis", "s").agg(F.avg("a_fork").alias("seed_predictability"), F.avg("gain").alias("alpha_star"), F.avg(F.col("a_fork") - F.col("a_ind")).alias("seed_share"))
    points = means.unpivot(["axis", "s"], ["seed_predictability", "alpha_star", "seed_share"], "q", "y")
    return de.trend_verdict(points, ["axis"], "q", "s", "y")


@query("k06_threshold_tokens", f"""WITH {CURVES}, b AS (SELECT axis, s, avg(gain) AS g, avg(a_fork) AS f, avg(a_ind) AS i FROM curves GROUP BY ALL), a AS (SELECT axis, avg(g) AS g, max(g) AS best, max(f) AS internal, arg_min(f, s) AS first, avg(i) AS chance FROM b GROUP BY axis),
 sl AS (SELECT axis, quantile_cont(k, 0.025) AS low FROM (SELECT axis, unit, regr_slope(gain, s) AS k FROM curves GROUP BY ALL) WHERE k IS NOT NULL AND NOT isnan(k) GROUP BY axis),
 l AS (SELECT axis, max(n)::DOUBLE / sum(n) AS share, pow(sum(n), 2) / sum(n::DOUBLE * n) AS k FROM (SELECT axis, label, count(*) AS n FROM m GROUP BY ALL) GROUP BY axis)
 SELECT axis, CASE WHEN g >= 0.5 THEN 'BRIDGE_METHOD' WHEN g >= 0.2 THEN 'BRIDGE_PARTIAL' ELSE 'BRIDGE_WEAK' END AS bridge, CASE WHEN best <= chance + 0.15 AND best <= internal - 0.15 THEN 'COND_BOTTLENECK' ELSE 'COND_NOT_BOTTLENECK' END AS conditioning,
  CASE WHEN first - chance > 0.1 AND low > 0 THEN 'SEED_FLOOR_CONFIRMED+SEED_AMPLIFICATION' WHEN first - chance > 0.1 THEN 'SEED_FLOOR_CONFIRMED' WHEN low > 0 THEN 'SEED_AMPLIFICATION' ELSE 'NO_SEED_FLOOR' END AS seed_floor,
  CASE WHEN share >= 0.5 OR k < 2 THEN 'DEGENERATE' ELSE 'INFORMATIVE' END AS labels, CASE WHEN chance < 0.5 THEN 'DEGENERATE' ELSE 'INFORMATIVE' END AS material FROM a JOIN sl USING (axis) JOIN l USING (axis)""")
def k06(spark, d):
    rows = curves(spark, d)
    by_s = rows.groupBy("axis", "s").agg(F.avg("gain").alias("g"), F.avg("a_fork").alias("f"), F.avg("a_ind").alias("i"))
    a = by_s.groupBy("axis").agg(F.avg("g").alias("g"), F.max("g").alias("best"), F.max("f").alias("internal"), F.min_by("f", "s").alias("first"), F.avg("i").alias("chance"))
    slopes = rows.groupBy("axis", "unit").agg(F.regr_slope("gain", "s").alias("k")).where("k is not null and not isnan(k)")
    low = slopes.groupBy("axis").agg(F.percentile("k", F.lit(0.025)).alias("low"))
    n = measurements(spark, d).groupBy("axis", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("axis")
    n = n.agg((F.max("n") / F.sum("n")).alias("share"), (F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n").cast("double") * F.col("n"))).alias("k"))
    c = F.col
    return a.join(low, "axis").join(n, "axis").select(
        "axis", de.bridge_token(c("g")).alias("bridge"), de.conditioning_token(c("best"), c("chance"), c("internal")).alias("conditioning"),
        de.seed_floor_token(c("first"), c("chance"), c("low")).alias("seed_floor"), de.categorical_token(c("share"), c("k"), 0.5, 2).alias("labels"), de.material_token(c("chance"), 0.5).alias("material"),
    )
