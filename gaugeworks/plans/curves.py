"""Queries of expressions, joins and curves (SURVEY C, E, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import curves as cv
from ..operators import measures as ms
from ..operators import ordering as od
from ..operators import resampling as rs
from ..operators import sampling as sm
from ..operators import tables as tb
from .bindings import CURVES, VECTORS, measurements, r6, table, vectors
from .catalog import query
from .draws import ci, draws


def curves(spark, d):
    return cv.gain_curves(measurements(spark, d, by_unit=True))


def baselines(spark, d):
    return cv.baseline(measurements(spark, d, by_unit=True))


GAIN = "CASE WHEN a_ind >= 1 - 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (a_fork - a_ind) / (1 - a_ind))) END"


@query("c01_gain", f"WITH {CURVES} SELECT unit, axis, round(s, 6) AS s, round(gain, 6) AS gain FROM curves")
def c01(spark, d):
    return curves(spark, d).select("unit", "axis", r6("s"), r6("gain"))


@query("c02_shares", f"""WITH {CURVES}, e AS (SELECT unit, axis, max(a_ind) AS i, arg_min(a_fork, s) AS f0, arg_max(a_fork, s) AS f1 FROM curves GROUP BY ALL), c AS (SELECT *, greatest(0, least(1, x)) FROM (SELECT *, 1 AS x FROM e))
 SELECT unit, axis, round(greatest(0.0, least(1.0, i)), 6) AS conditioning, round(greatest(0.0, least(1.0, f0 - i)), 6) AS seed, round(greatest(0.0, least(1.0, f1 - f0)), 6) AS trajectory, round(greatest(0.0, least(1.0, 1 - f1)), 6) AS residual, round(CASE WHEN 1 - i > 1e-9 THEN greatest(0.0, least(1.0, (f1 - i) / (1 - i))) END, 6) AS end_gain FROM e""")
def c02(spark, d):
    got = ms.shares(curves(spark, d), ["unit", "axis"])
    return got.select("unit", "axis", *(r6(c) for c in ("conditioning", "seed", "trajectory", "residual", "end_gain")))


SPAN = "x AS (SELECT o_orderkey AS item, l_linenumber AS k, date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS a0, date_diff('day', o_orderdate, l_shipdate) + l_quantity AS a1, lead(date_diff('day', o_orderdate, l_shipdate)::DOUBLE) OVER w AS b0, lead(date_diff('day', o_orderdate, l_shipdate) + l_quantity) OVER w AS b1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate))"


def spans(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.date_diff("l_shipdate", "o_orderdate").cast("double")
    w = Window.partitionBy("item").orderBy("k", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    x = rows.select(F.col("o_orderkey").alias("item"), F.col("l_linenumber").alias("k"), "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", days.alias("a0"), (days + F.col("l_quantity")).alias("a1"))
    return x.select("item", "k", "a0", "a1", F.lead("a0").over(w).alias("b0"), F.lead("a1").over(w).alias("b1"))


@query("c03_interval_iou", f"WITH {SPAN} SELECT item, k, a0, b0, round(CASE WHEN (a1 - a0) + (b1 - b0) - greatest(0.0, least(a1, b1) - greatest(a0, b0)) <= 0 THEN (a0 = b0)::INT ELSE greatest(0.0, least(a1, b1) - greatest(a0, b0)) / ((a1 - a0) + (b1 - b0) - greatest(0.0, least(a1, b1) - greatest(a0, b0))) END, 6) AS iou FROM x WHERE b0 IS NOT NULL")
def c03(spark, d):
    return spans(spark, d).where("b0 IS NOT NULL").select("item", "k", "a0", "b0", r6(exprs.interval_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), "iou"))


PRESENCE = "CASE WHEN k % 3 = 0 THEN 'absent' WHEN k % 5 = 0 THEN 'uncertain' ELSE 'present' END"


@query("c04_timing_offset", f"WITH {SPAN}, y AS (SELECT *, {PRESENCE} AS p FROM x), z AS (SELECT *, CASE WHEN p <> 'present' THEN 'presence_' || p WHEN b0 IS NULL OR b1 IS NULL THEN 'onset_unknown' ELSE 'ok' END AS reason FROM y) SELECT item, k, a0, CASE WHEN reason = 'ok' THEN (b0 + b1) / 2 - (a0 + a1) / 2 END AS value, CASE WHEN reason = 'ok' THEN b0 - a1 END AS low, CASE WHEN reason = 'ok' THEN b1 - a0 END AS high, reason FROM z")
def c04(spark, d):
    k = F.col("k")
    presence = F.when(k % 3 == 0, "absent").when(k % 5 == 0, "uncertain").otherwise("present")
    return spans(spark, d).select("item", "k", "a0", exprs.timing_offset(presence, F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("t")).select("item", "k", "a0", "t.*")


@query("c05_evidence_rules", """SELECT user_id, event_id, CASE WHEN NOT coalesce(value > 2, false) OR CASE WHEN event_type <> 'error' THEN event_type = 'view' END IS NULL THEN 'uncertain' WHEN event_type = 'view' THEN 'present' ELSE 'absent' END AS presence,
 CASE WHEN abs(value - 10) <= 0.5 THEN 'indifferent' WHEN value > 10 THEN 'positive' WHEN value < 10 THEN 'negative' END AS choice FROM events""")
def c05(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select("user_id", "event_id", exprs.presence_state(F.when(t != "error", t == "view"), F.col("value") > 2, F.lit(None)).alias("presence"), exprs.two_choice(F.col("value"), F.lit(10.0), 0.5).alias("choice"))


@query("c06_time_bin", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'none' ELSE least(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 1800.0), 39)::BIGINT::VARCHAR END AS bin FROM events")
def c06(spark, d):
    secs = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, d, "events").select("event_id", exprs.time_bin(F.when(F.col("event_type") != "error", secs), 1800.0, 40).alias("bin"))


RULES = [("metal", ["bolt", "gear", "ring"]), ("tool", ["widget", "gadget"]), ("warm", ["red"])]


@query("c07_keyword_class", "SELECT p_partkey, " + "coalesce(" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(p_name), '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in RULES) + ", 'other') AS class FROM part")
def c07(spark, d):
    return table(spark, d, "part").select("p_partkey", exprs.keyword_class(F.col("p_name"), RULES).alias("class"))


@query("c08_top_class", f"""WITH {VECTORS}, p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, list_inner_product(v, v) AS n FROM vecs), q AS (SELECT vec_id, i // 8 AS grp, i, x * x / n AS p FROM p WHERE n > 0 AND i // 8 <> 7),
 g AS (SELECT vec_id, grp, max(p) AS p FROM q GROUP BY ALL), r AS (SELECT vec_id, max(p) AS top, arg_max(grp, p) AS grp FROM g GROUP BY vec_id), u AS (SELECT vec_id, max(g.p) AS second FROM g JOIN r USING (vec_id) WHERE g.grp <> r.grp GROUP BY vec_id), h AS (SELECT vec_id, sum(-p * ln(p)) FILTER (p > 0) AS entropy FROM q GROUP BY vec_id)
 SELECT vec_id, CASE WHEN top - second < 0.02 THEN 'abstain' ELSE 'g' || grp END AS label, round(top - second, 6) AS margin, round(entropy, 6) AS entropy FROM r JOIN u USING (vec_id) JOIN h USING (vec_id)""")
def c08(spark, d):
    total = exprs.dot(F.col("v"), F.col("v"))
    p = vectors(spark, d).withColumn("n", total).where("n > 0").select("vec_id", F.transform("v", lambda x: x * x / F.col("n")).alias("p"))
    got = ms.top_class(p, ["vec_id"], "p", F.floor(F.col("pos") / 8), [7], 0.02, F.concat(F.lit("g"), F.col("_g").cast("string")))
    return got.select("vec_id", "label", r6("margin"), r6("entropy"))


@query("c09_judge_json", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN (props->>'k')::BIGINT END AS k, event_id % 4 <> 3 AS parsed FROM events")
def c09(spark, d):
    case = F.col("event_id") % 4
    reply = F.when(case == 0, F.col("props")).when(case == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).when(case == 2, F.concat(F.lit("I think "), "props", F.lit(" fits."))).otherwise("no answer")
    j = exprs.judge_json(reply, "k long")
    return table(spark, d, "events").select("event_id", j["k"].alias("k"), j.isNotNull().alias("parsed"))


@query("c10_cosine", f"WITH {VECTORS} SELECT a.vec_id, round(CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 6) AS cosine FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1")
def c10(spark, d):
    a = vectors(spark, d).select("vec_id", "v")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", r6(exprs.cosine(F.col("v"), F.col("w")), "cosine"))


@query("c11_pooling", f"""WITH {VECTORS}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs), p AS (SELECT label, i, avg(x) AS mean, max(x) AS top FROM u GROUP BY ALL),
 c AS (SELECT label, i, mean AS x FROM p UNION ALL SELECT label, 64 + i, top FROM p), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label) SELECT label, i - 1 AS pos, round(x / n, 6) AS x FROM c JOIN n USING (label)""")
def c11(spark, d):
    got = ms.pooled(vectors(spark, d), ["label"], "v").select("label", F.posexplode("v").alias("pos", "x"))
    return got.select("label", F.col("pos").cast("long").alias("pos"), r6("x"))


@query("c12_ids", "SELECT page_id, replace(replace(url, '/', '_'), ':', '_') AS safe, sha256(lower(trim(url))) AS rater FROM pages")
def c12(spark, d):
    return table(spark, d, "pages").select("page_id", exprs.safe_id(F.col("url")).alias("safe"), exprs.rater_hash(F.col("url")).alias("rater"))


@query("c12_blind_ids")
def c12_blind(spark, d):
    return table(spark, d, "pages").select("page_id", exprs.blind_id(b"study")(F.col("url")).alias("blind_id"))


@query("c13_natural_order", "WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS key FROM customer) SELECT c_custkey, key, row_number() OVER (ORDER BY TRY_CAST(key AS BIGINT) IS NULL, TRY_CAST(key AS BIGINT), key, c_custkey) AS place FROM k")
def c13(spark, d):
    key = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    k = table(spark, d, "customer").select("c_custkey", key.alias("key"))
    return od.numbered(k, [], [*(c.asc_nulls_first() for c in exprs.natural_order(F.col("key"))), "c_custkey"], "place").withColumn("place", F.col("place") + 1)


@query("c14_commit_read", f"""WITH {CURVES}, g AS (SELECT axis, s, avg(gain) AS c, avg(a_fork) AS r FROM curves GROUP BY ALL) SELECT axis, round(s, 6) AS s, CASE WHEN c < 0.3 THEN CASE WHEN r >= 0.55 THEN 'R1' ELSE 'uncommitted' END WHEN r < 0.55 THEN 'R2' ELSE 'early_action' END AS cell FROM g""")
def c14(spark, d):
    g = curves(spark, d).groupBy("axis", "s").agg(F.avg("gain").alias("c"), F.avg("a_fork").alias("r"))
    return g.select("axis", r6("s"), ms.commit_read_cell(F.col("c"), F.col("r"), 0.3, 0.55).alias("cell"))


# Joins


@query("e01_baseline_join", f"WITH {CURVES} SELECT unit, axis, round(s, 6) AS s, round(a_fork, 6) AS a_fork, round(a_ind, 6) AS a_ind FROM curves")
def e01(spark, d):
    return curves(spark, d).select("unit", "axis", r6("s"), r6("a_fork"), r6("a_ind"))


@query("e02_mandatory_label", "SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'label_missing' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def e02(spark, d):
    return tb.with_labels(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("e03_grid_lookup", "WITH g AS (SELECT unnest([5.0, 10, 20, 50, 100]) AS s) SELECT event_id, arg_min(s, abs(s - value)) AS nearest, min(s) FILTER (s >= value) AS next, max(s) FILTER (s < value) AS previous FROM events, g GROUP BY event_id")
def e03(spark, d):
    found = tb.grid_lookups(F.col("value"), [5, 10, 20, 50, 100])
    return table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in found.items()))


@query("e04_nearest_event", """WITH v AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'), p AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
 SELECT v.event_id, min(abs(v.t - p.t)) AS gap FROM v LEFT JOIN p USING (user_id) GROUP BY v.event_id""")
def e04(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return tb.nearest_event(e, "user_id", "event_id", "t", F.col("event_type") == "view", F.col("event_type") == "purchase")


U32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("e05_derangement", f"WITH r AS (SELECT s_suppkey AS unit, row_number() OVER (ORDER BY {U32.format(chr(39) + 'donor:' + chr(39) + ' || s_suppkey')}, s_suppkey) AS k, count(*) OVER () AS n FROM supplier) SELECT a.unit, b.unit AS donor FROM r a JOIN r b ON b.k = a.k % a.n + 1")
def e05(spark, d):
    units = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    return sm.derangement(units, "unit", "donor")


E06 = f"""WITH r AS (SELECT s_suppkey AS unit, s_nationkey AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY {U32.format("'pair:' || s_suppkey")}, s_suppkey) - 1 AS i FROM supplier),
 z AS (SELECT g, n * (n - 1) // 2 AS pairs FROM (SELECT g, count(*) AS n FROM r GROUP BY g) WHERE n > 1), sp AS (SELECT g, sum(pairs) OVER (ORDER BY g)::BIGINT AS stop, pairs FROM z), tot AS (SELECT max(stop) AS t FROM sp),
 few AS (SELECT x FROM (SELECT unnest(range((SELECT t FROM tot))) AS x) WHERE (SELECT t FROM tot) <= 200 ORDER BY ('0x' || substr(md5('pair:' || x), 1, 15))::BIGINT, x LIMIT 50),
 many AS (SELECT x FROM (SELECT ('0x' || substr(md5('pair:' || k), 1, 15))::BIGINT % (SELECT t FROM tot) AS x, min(k) AS k FROM (SELECT unnest(range(164)) AS k) GROUP BY 1) WHERE (SELECT t FROM tot) > 200 ORDER BY k LIMIT 50),
  at_ AS (SELECT g, x - (stop - pairs) AS y FROM (FROM few UNION ALL FROM many) JOIN sp ON x >= stop - pairs AND x < stop), ij AS (SELECT g, y, floor((1 + sqrt(1 + 8.0::DOUBLE * y)) / 2)::BIGINT AS j FROM at_)
 SELECT least(a.unit, b.unit) AS u, greatest(a.unit, b.unit) AS w FROM ij JOIN r a ON a.g = ij.g AND a.i = y - j * (j - 1) // 2 JOIN r b ON b.g = ij.g AND b.i = j"""


@query("e06_unit_pairs", E06)
def e06(spark, d):
    return sm.sampled_pairs(table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), "s_nationkey"), "unit", 50, "pair", ["s_nationkey"])


@query("e07_set_algebra", "(SELECT l_partkey AS unit FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) INTERSECT (SELECT p_partkey FROM part WHERE p_size > 5 UNION SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def e07(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    screened, dropped = (li.where(w).select(F.col("l_partkey").alias("unit")) for w in ("l_linestatus = 'O'", "l_discount > 0.09"))
    return tb.manifest(screened, dropped, *(p.where(w).select("p_partkey") for w in ("p_size > 5", "p_type = 'PROMO'")))


COMMIT = f"""{CURVES}, t AS (SELECT unit, axis, min(CASE WHEN gain >= 0.7 THEN s END) AS c, min(CASE WHEN a_fork >= 0.6 THEN s END) AS r FROM curves GROUP BY ALL)"""


def commit_read(spark, d):
    return curves(spark, d).groupBy("unit", "axis").agg(F.min(F.when(F.col("gain") >= 0.7, F.col("s"))).alias("c"), F.min(F.when(F.col("a_fork") >= 0.6, F.col("s"))).alias("r"))


#: x (unit, axis, c, r): interpolated first points at which the gain reaches 0.7 and the fork agreement 0.6.
CROSSED = f"""{CURVES}, l_ AS (SELECT unit, axis, s, gain, a_fork, lag(s) OVER w AS ps, lag(gain) OVER w AS pg, lag(a_fork) OVER w AS pf FROM curves WINDOW w AS (PARTITION BY unit, axis ORDER BY s)),
 x AS (SELECT unit, axis, arg_min(CASE WHEN ps IS NULL THEN s ELSE ps + (0.7 - pg) / (gain - pg) * (s - ps) END, s) FILTER (gain >= 0.7 AND (pg IS NULL OR pg < 0.7)) AS c,
  arg_min(CASE WHEN ps IS NULL THEN s ELSE ps + (0.6 - pf) / (a_fork - pf) * (s - ps) END, s) FILTER (a_fork >= 0.6 AND (pf IS NULL OR pf < 0.6)) AS r FROM l_ GROUP BY ALL)"""


def crossed(spark, d):
    return cv.interpolated_crossings(curves(spark, d), ["unit", "axis"], {"c": ("gain", 0.7), "r": ("a_fork", 0.6)})


@query("e08_gap_table", f"WITH {COMMIT} SELECT axis, round(avg(c), 6) AS s_commit, round(avg(r), 6) AS s_read, round(avg(r) - avg(c), 6) AS gap FROM t GROUP BY axis HAVING count(c) >= 20 AND count(r) >= 20")
def e08(spark, d):
    got = tb.gap_table(commit_read(spark, d), ["axis"], "c", "r", 20)
    return got.select("axis", r6("s_commit"), r6("s_read"), r6("gap"))


@query("e09_diagnostics", f"""WITH {COMMIT}, st AS (SELECT axis, count(*) AS n, count(*) FILTER (a_ind >= 1 - 1e-9) AS determined, count(*) FILTER (a_ind < 1 - 1e-9 AND c IS NOT NULL) AS crossing, count(*) FILTER (a_ind < 1 - 1e-9 AND c IS NULL) AS censored FROM t JOIN ind USING (unit, axis) GROUP BY axis), gr AS (SELECT axis, count(DISTINCT s) AS grid FROM curves GROUP BY axis)
 SELECT axis, grid, n, determined, crossing, censored, determined + crossing + censored = n AS consistent FROM st JOIN gr USING (axis)""")
def e09(spark, d):
    return tb.diagnostics(commit_read(spark, d), baselines(spark, d), curves(spark, d), "c")


# Crossings and survival


@query("f01_interpolated_crossing", f"""WITH {CURVES}, l AS (SELECT unit, axis, s, gain, lag(s) OVER w AS ps, lag(gain) OVER w AS pg FROM curves WINDOW w AS (PARTITION BY unit, axis ORDER BY s)),
 h AS (SELECT unit, axis, s, CASE WHEN ps IS NULL THEN s ELSE ps + (0.7 - pg) / (gain - pg) * (s - ps) END AS x FROM l WHERE gain >= 0.7 AND (pg IS NULL OR pg < 0.7)), f AS (SELECT unit, axis, arg_min(x, s) AS x FROM h GROUP BY ALL)
 SELECT unit, axis, round(x, 6) AS crossing FROM (SELECT DISTINCT unit, axis FROM curves) LEFT JOIN f USING (unit, axis)""")
def f01(spark, d):
    return cv.interpolated_crossing(curves(spark, d), ["unit", "axis"], "gain", 0.7).withColumn("crossing", r6("crossing"))


@query("f02_grid_crossing", f"WITH {COMMIT} SELECT unit, axis, round(c, 6) AS crossing FROM t")
def f02(spark, d):
    return cv.grid_crossing(curves(spark, d), ["unit", "axis"], "gain", 0.7).withColumn("crossing", r6("crossing"))


@query("f03_endpoint_controls", f"WITH {CURVES}, a AS (SELECT axis, s, avg(gain) AS g FROM curves GROUP BY ALL) SELECT axis, round(arg_min(g, abs(s - 0.1)), 6) AS low, round(arg_min(g, abs(s - 0.95)), 6) AS high, arg_min(g, abs(s - 0.1)) <= 0.5 AND arg_min(g, abs(s - 0.95)) >= 0.2 AS sane FROM a GROUP BY axis")
def f03(spark, d):
    got = ms.endpoint_controls(curves(spark, d), ["axis"], "gain", 0.1, 0.95, 0.5, 0.2)
    return got.select("axis", r6("low"), r6("high"), "sane")


STATUS = f"""{COMMIT}, st AS (SELECT unit, axis, c, CASE WHEN a_ind >= 1 - 1e-9 THEN 'determined' WHEN c IS NOT NULL THEN 'crossing' ELSE 'censored' END AS st FROM t JOIN ind USING (unit, axis))"""


def statuses(spark, d):
    t = commit_read(spark, d).join(baselines(spark, d), ["unit", "axis"])
    return t.select("unit", "axis", "c", cv.status(F.col("a_ind"), F.col("c")).alias("st"))


@query("f04_status_partition", f"WITH {STATUS} SELECT axis, st AS status, count(*) AS n FROM st GROUP BY axis, st")
def f04(spark, d):
    return statuses(spark, d).groupBy("axis", F.col("st").alias("status")).agg(F.count(F.lit(1)).alias("n"))


KM = """k AS (SELECT axis, t, sum(e) AS ev, count(*) AS n FROM el GROUP BY ALL), r AS (SELECT axis, t, ev, sum(n) OVER (PARTITION BY axis ORDER BY t DESC) AS risk FROM k),
 sv AS (SELECT axis, t, ev, risk, product(1 - ev / risk::DOUBLE) OVER (PARTITION BY axis ORDER BY t) AS surv FROM r)"""


@query("f05_survival", f"WITH {STATUS}, el AS (SELECT axis, coalesce(c, 1.0) AS t, (st = 'crossing')::INT AS e FROM st WHERE st <> 'determined'), {KM} SELECT axis, round(t, 6) AS t, risk::BIGINT AS at_risk, ev::BIGINT AS events, round(surv, 6) AS survival FROM sv")
def f05(spark, d):
    el = statuses(spark, d).where("st <> 'determined'").withColumn("time", F.coalesce("c", F.lit(1.0)))
    got = cv.survival(el, ["axis"], "time", F.col("st") == "crossing")
    return got.select("axis", r6("t"), "at_risk", "events", r6("survival"))


@query("f05_survival_median", f"WITH {STATUS}, el AS (SELECT axis, coalesce(c, 1.0) AS t, (st = 'crossing')::INT AS e FROM st WHERE st <> 'determined'), {KM} SELECT axis, round(min(CASE WHEN surv <= 0.5 + 1e-12 AND ev > 0 THEN t END), 6) AS median FROM sv GROUP BY axis")
def f05_median(spark, d):
    el = statuses(spark, d).where("st <> 'determined'").withColumn("time", F.coalesce("c", F.lit(1.0)))
    return cv.survival_median(el, ["axis"], "time", F.col("st") == "crossing").withColumn("median", r6("median"))


THETAS = (0.5, 0.6, 0.7, 0.8, 0.9)
SWEEP_B = 200
BY_THETA = f"""{CURVES}, th AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS theta), x AS (SELECT theta::DOUBLE AS theta, unit, axis, min(CASE WHEN gain >= theta THEN s END) AS c FROM curves, th GROUP BY ALL)"""


def by_theta(spark, d):
    each = curves(spark, d).withColumn("theta", F.explode(F.array(*map(F.lit, THETAS))))
    return cv.grid_crossing(each, ["theta", "unit", "axis"], "gain", F.col("theta")).withColumnRenamed("crossing", "c")


@query("f06_window_robustness", f"WITH {BY_THETA} SELECT theta, axis, count(*) AS n_clips, count(c) AS n_cross, round(count(c)::DOUBLE / count(*), 6) AS crossing_fraction, round(avg(c), 6) AS mean_of_crossers, round(median(coalesce(c, 1)), 6) AS censored_median FROM x GROUP BY theta, axis")
def f06(spark, d):
    return by_theta(spark, d).groupBy("theta", "axis").agg(F.count(F.lit(1)).alias("n_clips"), F.count("c").alias("n_cross"), r6(F.count("c") / F.count(F.lit(1)), "crossing_fraction"), r6(F.avg("c"), "mean_of_crossers"), r6(F.median(F.coalesce("c", F.lit(1.0))), "censored_median"))


@query("f07_ordering", f"""WITH {BY_THETA}, mv AS (SELECT theta, axis, round(avg(c), 6) AS v FROM x GROUP BY ALL), r AS (SELECT theta, axis, v, rank() OVER (PARTITION BY theta ORDER BY v) AS rank FROM mv), t AS (SELECT theta, rank, string_agg(axis, ' = ' ORDER BY axis) AS t FROM r GROUP BY ALL)
 SELECT theta, axis, v, rank, ordering FROM r JOIN (SELECT theta, string_agg(t, ' < ' ORDER BY rank) AS ordering FROM t GROUP BY theta) USING (theta)""")
def f07(spark, d):
    m = by_theta(spark, d).groupBy("theta", "axis").agg(r6(F.avg("c"), "v"))
    return cv.ranking(m, ["theta"], "axis", "v").select("theta", "axis", "v", "rank", "ordering")


MIN_N = 20
#: w: windows per theta and axis over interpolated crossings, intervals over units; ws: result windows only.
WIN = f"""{CURVES}, th AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS theta), l_ AS (SELECT unit, axis, s, gain, lag(s) OVER w AS ps, lag(gain) OVER w AS pg FROM curves WINDOW w AS (PARTITION BY unit, axis ORDER BY s)),
 x AS (SELECT theta, unit, axis, arg_min(CASE WHEN ps IS NULL THEN s ELSE ps + (theta - pg) / (gain - pg) * (s - ps) END, s) FILTER (gain >= theta AND (pg IS NULL OR pg < theta)) AS c FROM l_, th GROUP BY ALL), {draws("x", "sweep", SWEEP_B)},
 rp AS (SELECT theta, axis, b, sum(w * c) / nullif(sum(w) FILTER (c IS NOT NULL), 0) AS m FROM wt JOIN x USING (unit) GROUP BY ALL),
 w AS (SELECT theta, axis, point AS s_hat, ci_low, ci_high, n, n < {MIN_N} AS underpowered FROM ({ci("m", "rp", "theta, axis")}) JOIN (SELECT theta, axis, count(*) AS n FROM x GROUP BY ALL) USING (theta, axis)), ws AS (SELECT * FROM w WHERE NOT underpowered AND s_hat IS NOT NULL)"""


def sweep(spark, d):
    """Windows of every theta and axis, and those that are results."""
    shown = rs.threshold_sweep(curves(spark, d), ["axis"], THETAS, n_boot=SWEEP_B, min_n=MIN_N)
    return shown, shown.where("not underpowered and s_hat is not null")


@query("f08_separation", f"WITH {WIN} SELECT theta, round(CASE WHEN count(s_hat) < 2 THEN NULL WHEN max(s_hat) - min(s_hat) <= 1e-9 THEN 0 WHEN avg(ci_high - ci_low) <= 1e-9 THEN 'inf'::DOUBLE ELSE (max(s_hat) - min(s_hat)) / avg(ci_high - ci_low) END, 4) AS separation FROM ws GROUP BY theta")
def f08(spark, d):
    return cv.separation(sweep(spark, d)[1], ["theta"]).withColumn("separation", F.round("separation", 4))


@query("f09_non_overlap", f"WITH {WIN}, n AS (SELECT theta, ci_high <= lead(ci_low) OVER (PARTITION BY theta ORDER BY s_hat, axis) AS ok FROM ws) SELECT theta, bool_and(coalesce(ok, true)) AS ordered FROM n GROUP BY theta")
def f09(spark, d):
    return cv.non_overlap(sweep(spark, d)[1], ["theta"])


@query("f10_threshold_sweep", f"WITH {WIN} SELECT theta, axis, round(s_hat, 6) AS s_hat, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n, underpowered FROM w")
def f10(spark, d):
    return sweep(spark, d)[0].select("theta", "axis", r6("s_hat"), r6("ci_low"), r6("ci_high"), "n", "underpowered")


@query("f11_monotonicity", f"""WITH {CURVES}, l AS (SELECT axis, unit, s, a_fork - lag(a_fork) OVER (PARTITION BY unit, axis ORDER BY s) AS dv FROM curves), {draws("l", "monotone", SWEEP_B)},
 rp AS (SELECT axis, s, b, sum(w * dv) / nullif(sum(w), 0) AS m FROM l JOIN wt USING (unit) WHERE dv IS NOT NULL GROUP BY ALL), c AS ({ci("m", "rp", "axis, s")})
 SELECT axis, round(s, 6) AS s, round(point, 6) AS mean_step, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n, ci_high < -0.02 AS violation FROM c JOIN (SELECT axis, s, count(dv) AS n FROM l GROUP BY ALL) USING (axis, s)""")
def f11(spark, d):
    got = ms.monotonicity(curves(spark, d), ["axis"], "a_fork", n_boot=SWEEP_B)
    return got.select("axis", r6("s"), r6("mean_step"), r6("ci_low"), r6("ci_high"), "n", "violation")


@query("f12_best_per_step", f"WITH {CURVES}, g AS (SELECT axis, s, round(avg(gain), 6) AS score FROM curves GROUP BY ALL) SELECT round(s, 6) AS s, axis AS best, score FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, axis) = 1")
def f12(spark, d):
    g = curves(spark, d).groupBy("axis", "s").agg(r6(F.avg("gain"), "score"))
    return ms.best_per_step(g, ["s"], "axis", "score").select(r6("s"), F.col("axis").alias("best"), "score")


@query("f13_smallest_setting", "WITH a AS (SELECT l_discount AS alpha, count(DISTINCT l_suppkey)::DOUBLE / count(*) AS diversity, avg((l_returnflag <> 'R')::INT) AS validity FROM lineitem GROUP BY 1) SELECT min(alpha) FILTER (diversity >= 0.001 AND validity >= 0.5) AS alpha, CASE WHEN count(*) FILTER (diversity >= 0.001 AND validity >= 0.5) = 0 THEN 'NONE' ELSE 'OK' END AS token FROM a")
def f13(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_discount").alias("alpha")).agg((F.count_distinct("l_suppkey") / F.count(F.lit(1))).alias("diversity"), F.avg((F.col("l_returnflag") != "R").cast("int")).alias("validity"))
    return ms.smallest_setting(a, "alpha", diversity=0.001, validity=0.5)
