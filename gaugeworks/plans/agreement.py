"""Queries of agreement, rater and accuracy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import kernels as kn
from ..operators import measures as ms
from ..operators import ordering as od
from ..sources.tables import written
from .bindings import CURVES, M, RATED, VECTORS, documents_rated, measurements, r6, table, vectors
from .catalog import query

PAIR = "CASE WHEN sum(c) < 2 THEN 1.0 ELSE sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) END"


@query("d01_pairwise_agreement", f"WITH {M} SELECT unit, axis, role, round({PAIR}, 6) AS agreement, sum(c)::BIGINT AS n FROM (SELECT unit, axis, role, label, count(*) AS c FROM m GROUP BY ALL) GROUP BY ALL")
def d01(spark, d):
    return ag.pairwise_agreement(measurements(spark, d), ["unit", "axis", "role"]).withColumn("agreement", r6("agreement"))


@query("d02_confident_agreement", f"""WITH {M}, cc AS (SELECT unit, axis, role, label, count(*) AS c, count(*) FILTER (label <> 'abstain') AS k FROM m GROUP BY ALL)
  SELECT unit, axis, role, round(CASE WHEN sum(k) >= 2 THEN sum(k * (k - 1))::DOUBLE / (sum(k) * (sum(k) - 1)) END, 6) AS agreement, sum(k)::BIGINT AS n_conf, round(1 - sum(k)::DOUBLE / sum(c), 6) AS abstain_rate FROM cc GROUP BY ALL""")
def d02(spark, d):
    got = ag.confident_agreement(measurements(spark, d), ["unit", "axis", "role"])
    return got.select("unit", "axis", "role", r6("agreement"), F.col("n_conf").cast("long").alias("n_conf"), r6("abstain_rate"))


@query("d03_krippendorff", f"WITH {M} SELECT unit, axis, s, CASE WHEN count(DISTINCT label) <= 1 THEN 1.0 ELSE 0.0 END AS alpha, count(*) AS n FROM m GROUP BY ALL".replace("SELECT unit, axis, s,", "SELECT unit, axis, round(s, 6) AS s,"))
def d03(spark, d):
    return ag.krippendorff_nominal(measurements(spark, d).withColumn("s", F.round("s", 6)), ["unit", "axis", "s"])


COS = f"""WITH {VECTORS}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i, sqrt(list_inner_product(v, v)) AS n FROM vecs),
 t AS (SELECT label, i, sum(x / CASE WHEN n = 0 THEN 1 ELSE n END) AS t, count(*) AS k, count(*) FILTER (n > 0) AS nz FROM u GROUP BY ALL)
 SELECT label, round(CASE WHEN max(k) < 2 THEN 1.0 ELSE (sum(t * t) - max(nz)) / (max(k) * (max(k) - 1)) END, 6) AS agreement, max(k) AS n FROM t GROUP BY label"""


@query("d04_mean_cosine", COS)
def d04(spark, d):
    return ag.vector_agreement(vectors(spark, d), ["label"]).withColumn("agreement", r6("agreement"))


@query("d05_dispatch", f"""WITH {M}, {VECTORS}, c AS (SELECT unit, axis, label, count(*) AS c FROM m WHERE role = 'independent' GROUP BY ALL),
 u AS (SELECT label AS unit, unnest(v) AS x, generate_subscripts(v, 1) AS i, sqrt(list_inner_product(v, v)) AS n FROM vecs),
 t AS (SELECT unit, i, sum(x / CASE WHEN n = 0 THEN 1 ELSE n END) AS t, count(*) AS k, count(*) FILTER (n > 0) AS nz FROM u GROUP BY ALL)
 SELECT unit, axis, round({PAIR}, 6) AS agreement, sum(c)::BIGINT AS n FROM c WHERE axis = 'flag' GROUP BY ALL
 UNION ALL SELECT unit, axis, CASE WHEN count(*) <= 1 THEN 1.0 ELSE 0.0 END, sum(c)::BIGINT FROM c WHERE axis = 'disc' GROUP BY ALL
 UNION ALL SELECT unit, 'shape', round(CASE WHEN max(k) < 2 THEN 1.0 ELSE (sum(t * t) - max(nz)) / (max(k) * (max(k) - 1)) END, 6), max(k) FROM t GROUP BY unit""")
def d05(spark, d):
    registry = spark.createDataFrame([("flag", "exact_match"), ("disc", "krippendorff"), ("shape", "cosine")], "axis string, metric string")
    labels = measurements(spark, d).where("role = 'independent'")
    shapes = vectors(spark, d).select(F.col("label").cast("long").alias("unit"), F.lit("shape").alias("axis"), "v")
    return ag.dispatched_agreement(labels, shapes, registry, ["unit", "axis"]).withColumn("agreement", r6("agreement"))


def rater_sql(keys: str, source: str) -> str:
    """kappa, ac1 and pabak of columns a, b of the relation x."""
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON TRUE"
    return f"""{source}, p AS (SELECT {k}count(*) AS n, avg((a = b)::INT) AS p_o FROM x GROUP BY ALL),
 l AS (SELECT {k}label, sum(one) AS na, sum(two) AS nb FROM (SELECT {k}a AS label, 1 AS one, 0 AS two FROM x UNION ALL SELECT {k}b, 0, 1 FROM x) GROUP BY ALL),
 g AS (SELECT {k}count(*) AS q, sum(na * nb)::DOUBLE / (sum(na) * sum(na)) AS pe, (1 - sum((na + nb) * (na + nb))::DOUBLE / (4 * sum(na) * sum(na))) / (count(*) - 1) AS pe1 FROM l GROUP BY ALL)
 SELECT {k}n, round(p_o, 6) AS p_o, round(CASE WHEN p_o >= 1 THEN 1 WHEN 1 - pe <= 1e-12 THEN 0 ELSE (p_o - pe) / (1 - pe) END, 6) AS kappa,
  round(CASE WHEN p_o >= 1 OR q < 2 THEN 1 ELSE (p_o - pe1) / (1 - pe1) END, 6) AS ac1, round(CASE WHEN q < 2 THEN 1 ELSE (q * p_o - 1) / (q - 1) END, 6) AS pabak FROM p JOIN g {on}"""


BY_LANG = rater_sql("lang", f"WITH {RATED}, x AS (SELECT * FROM rated)")


def rated_by(spark, d, keys):
    got = ag.rater_agreement(documents_rated(spark, d), keys)
    return got.select(*keys, "n", r6("p_o"), r6("kappa"), r6("ac1"), r6("pabak"))


@query("d06_cohen_kappa", f"SELECT lang, n, p_o, kappa FROM ({BY_LANG})")
def d06(spark, d):
    return rated_by(spark, d, ["lang"]).select("lang", "n", "p_o", "kappa")


@query("d07_gwet_ac1", f"SELECT lang, n, ac1 FROM ({BY_LANG})")
def d07(spark, d):
    return rated_by(spark, d, ["lang"]).select("lang", "n", "ac1")


@query("d08_pabak", f"SELECT lang, n, pabak FROM ({BY_LANG})")
def d08(spark, d):
    return rated_by(spark, d, ["lang"]).select("lang", "n", "pabak")


@query("d09_confusion", f"""WITH {RATED}, l AS (SELECT unnest(['0', '1', '2']) AS x)
 SELECT p.x AS a, q.x AS b, (SELECT count(*) FROM rated r WHERE r.a = p.x AND r.b = q.x) AS n FROM l p, l q""")
def d09(spark, d):
    return ag.confusion(documents_rated(spark, d), ["0", "1", "2"])


EVENT_ITEMS = "x AS (SELECT user_id::VARCHAR || ':' || CAST(ts AS DATE)::VARCHAR AS item, event_type AS label FROM events)"


@query("d10_many_rater_ac1", f"""WITH {EVENT_ITEMS}, c AS (SELECT item, label, count(*) AS c FROM x GROUP BY ALL), n AS (SELECT item, sum(c) AS n FROM c GROUP BY item HAVING sum(c) >= 2),
 k AS (SELECT c.*, n FROM c JOIN n USING (item)), i AS (SELECT item, sum(c * (c - 1))::DOUBLE / (max(n) * (max(n) - 1)) AS p FROM k GROUP BY item), w AS (SELECT label, sum(c::DOUBLE / n) AS w FROM k GROUP BY label),
 e AS (SELECT (1 - sum(w * w) / (sum(w) * sum(w))) / 4 AS pe FROM w)
 SELECT count(*) AS n_items, round(avg(p), 6) AS p_o, round((avg(p) - max(pe)) / (1 - max(pe)), 6) AS ac1 FROM i, e""")
def d10(spark, d):
    rows = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("item"), F.col("event_type").alias("label"))
    return ag.many_rater_ac1(rows, ["view", "click", "error", "purchase", "signup"]).select("n_items", r6("p_o"), r6("ac1"))


@query("d11_validity_suite", f"""WITH {RATED}, y AS (SELECT lang, source, CASE WHEN n_chars % 17 = 0 THEN 'abstain' ELSE a END AS a, b FROM rated), x AS (SELECT * FROM y WHERE a <> 'abstain'),
 s AS ({rater_sql("lang", "WITH x AS (SELECT * FROM x)").replace("WITH x AS (SELECT * FROM x), p AS", "WITH p AS")})
 SELECT lang, overlap, n AS n_conf, overlap - n AS abstains, p_o, within_one, kappa, ac1, pabak FROM s JOIN (SELECT lang, count(*) AS overlap FROM y GROUP BY lang) USING (lang)
  JOIN (SELECT lang, round(avg((abs(a::INT - b::INT) <= 1)::INT), 6) AS within_one FROM x GROUP BY lang) USING (lang)""")
def d11(spark, d):
    rows = documents_rated(spark, d).withColumn("a", F.when(F.col("n_chars") % 17 == 0, "abstain").otherwise(F.col("a")))
    sure = rows.where("a <> 'abstain'")
    suite = ag.rater_agreement(sure, ["lang"])
    near = sure.groupBy("lang").agg(F.avg((F.abs(F.col("a").cast("int") - F.col("b").cast("int")) <= 1).cast("int")).alias("within_one"))
    joined = suite.join(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("overlap")), "lang").join(near, "lang")
    return joined.select("lang", "overlap", F.col("n").alias("n_conf"), (F.col("overlap") - F.col("n")).alias("abstains"), r6("p_o"), r6("within_one"), r6("kappa"), r6("ac1"), r6("pabak"))


@query("d12_nested_subsets", f"""WITH {RATED}, x AS (SELECT 'full' AS subset, a, b FROM rated UNION ALL SELECT 'gate', a, b FROM rated WHERE n_chars > 300 UNION ALL SELECT 'clean', a, b FROM rated WHERE toxic = 0 UNION ALL SELECT 'both', a, b FROM rated WHERE n_chars > 300 AND toxic = 0),
 z AS ({rater_sql("subset", "WITH x AS (SELECT * FROM x)").replace("WITH x AS (SELECT * FROM x), p AS", "WITH p AS")}) SELECT subset, n, p_o, kappa, ac1 FROM z""")
def d12(spark, d):
    gate, clean = F.col("n_chars") > 300, F.col("toxic") == 0
    subsets = F.array_compact(F.array(F.lit("full"), F.when(gate, "gate"), F.when(clean, "clean"), F.when(gate & clean, "both")))
    got = ag.rater_agreement(documents_rated(spark, d).withColumn("subset", F.explode(subsets)), ["subset"])
    return got.select("subset", "n", r6("p_o"), r6("kappa"), r6("ac1"))


SPANS = "x AS (SELECT l_orderkey AS item, l_linenumber AS rater, date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS a0, date_diff('day', o_orderdate, l_shipdate) + l_quantity AS a1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("d13_interval_agreement", f"""WITH {SPANS}, p AS (SELECT p.a0, p.a1, q.a0 AS b0, q.a1 AS b1 FROM x p JOIN x q ON p.item = q.item AND p.rater < q.rater),
 j AS (SELECT *, greatest(0.0, least(a1, b1) - greatest(a0, b0)) AS sh FROM p), k AS (SELECT *, sh / ((a1 - a0) + (b1 - b0) - sh) AS iou FROM j)
 SELECT count(*) AS pairs, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, round(avg((sh > 0)::INT), 6) AS overlap, round(avg(abs(a0 - b0)), 6) AS start_error, round(avg(abs(a1 - b1)), 6) AS end_error FROM k""")
def d13(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.date_diff("l_shipdate", "o_orderdate").cast("double")
    x = rows.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater"), days.alias("a0"), (days + F.col("l_quantity")).alias("a1"))
    return ms.interval_agreement(x, "item", "rater", "a0", "a1").select("pairs", *(r6(c) for c in ("mean_iou", "median_iou", "overlap", "start_error", "end_error")))


@query("d14_marginals", f"""WITH {M}, c AS (SELECT axis, s, label, count(*) AS c FROM m GROUP BY ALL), p AS (SELECT axis, s, c, c::DOUBLE / sum(c) OVER (PARTITION BY axis, s) AS p FROM c)
 SELECT axis, round(s, 6) AS s, round(max(p), 6) AS majority_share, round(sum(-p * ln(p)), 6) AS entropy, round(1 / sum(p * p), 6) AS k_eff, sum(c)::BIGINT AS n FROM p GROUP BY axis, s""")
def d14(spark, d):
    got = ag.marginals(measurements(spark, d), ["axis", "s"])
    return got.select("axis", r6("s"), r6("majority_share"), r6("entropy"), r6("k_eff"), "n")


@query("d15_within_between", f"""WITH {M}, c AS (SELECT axis, unit, label, count(*) AS c FROM m GROUP BY ALL), w AS (SELECT axis, unit, {PAIR} AS a FROM c GROUP BY axis, unit),
 p AS (SELECT axis, unit, label, c::DOUBLE / sum(c) OVER (PARTITION BY axis, unit) AS p FROM c), un AS (SELECT DISTINCT axis, unit FROM m), pr AS (SELECT a.axis, a.unit AS u, b.unit AS w FROM un a JOIN un b ON a.axis = b.axis AND b.unit = a.unit + 1),
 dd AS (SELECT pr.axis, u, w, coalesce(sum(x.p * y.p), 0) AS d FROM pr LEFT JOIN p x ON x.axis = pr.axis AND x.unit = u LEFT JOIN p y ON y.axis = pr.axis AND y.unit = w AND y.label = x.label GROUP BY pr.axis, u, w)
 SELECT axis, round(a, 6) AS within, round(b, 6) AS between, round((a - b) / (1 - b), 6) AS relative FROM (SELECT axis, avg(a) AS a FROM w GROUP BY axis) JOIN (SELECT axis, avg(d) AS b FROM dd GROUP BY axis) USING (axis)""".replace("AS between", 'AS "between"'))
def d15(spark, d):
    rows = measurements(spark, d, by_unit=True).select("axis", "unit", "label")
    units = rows.select("axis", "unit").distinct()
    pairs = units.select("axis", F.col("unit").alias("u"), (F.col("unit") + 1).alias("w")).join(units.withColumnRenamed("unit", "w"), ["axis", "w"])
    return ag.profile_agreement(rows, pairs.select("axis", "u", "w"), ["axis"]).select("axis", r6("within"), r6("between"), r6("relative"))


@query("d16_diversity", f"""WITH {M}, u AS (SELECT axis, s, unit, count(DISTINCT label) AS k, count(DISTINCT CASE WHEN label <> 'abstain' THEN label END) AS kc, avg((label = 'abstain')::INT) AS r FROM m GROUP BY ALL)
 SELECT axis, round(s, 6) AS s, round(avg(k), 6) AS mean_all, round(avg(kc), 6) AS mean_confident, min(kc) AS least, max(kc) AS most, round(avg(r), 6) AS abstain_rate FROM u GROUP BY axis, s""")
def d16(spark, d):
    got = ms.diversity(measurements(spark, d), ["axis", "s"])
    return got.select("axis", r6("s"), r6("mean_all"), r6("mean_confident"), "least", "most", r6("abstain_rate"))


@query("d17_majority", f"""WITH {M}, c AS (SELECT unit, axis, label, count(*) AS c FROM m WHERE role = 'fork' GROUP BY ALL)
 SELECT unit, axis, label, c FROM c QUALIFY row_number() OVER (PARTITION BY unit, axis ORDER BY c DESC, (label = 'abstain')::INT, label) = 1""")
def d17(spark, d):
    counts = measurements(spark, d).where("role = 'fork'")
    order = F.concat((F.col("label") == "abstain").cast("int").cast("string"), F.col("label"))
    return ag.majority(counts, ["unit", "axis"], tie=order)


@query("d18_accuracy_chance", f"""WITH {RATED}, c AS (SELECT lang, b, count(*) AS c FROM rated GROUP BY ALL), k AS (SELECT lang, max(c)::DOUBLE / sum(c) AS chance FROM c GROUP BY lang)
 SELECT lang, round(avg((a = b)::INT), 6) AS accuracy, round(max(chance), 6) AS chance, round(avg((a = b)::INT) - max(chance), 6) AS margin FROM rated JOIN k USING (lang) GROUP BY lang""")
def d18(spark, d):
    rows = documents_rated(spark, d)
    chance = ag.label_counts(rows, ["lang"], "b").groupBy("lang").agg((F.max("c") / F.sum("c")).alias("chance"))
    acc = rows.groupBy("lang").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("accuracy")).join(chance, "lang")
    return acc.select("lang", r6("accuracy"), r6("chance"), r6(F.col("accuracy") - F.col("chance"), "margin"))


@query("d19_balanced_accuracy", f"WITH {RATED}, r AS (SELECT b, avg((a = b)::INT) AS r FROM rated WHERE b IN ('0', '1') GROUP BY b) SELECT round(CASE WHEN count(*) = 2 THEN avg(r) END, 6) AS balanced_accuracy, count(*) AS classes FROM r")
def d19(spark, d):
    rows = documents_rated(spark, d).withColumn("correct", F.col("a") == F.col("b"))
    return ag.balanced_accuracy(rows, ["0", "1"], label="b").withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query("d20_auroc", f"""WITH {RATED}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM rated),
 s AS (SELECT lang, sum(CASE WHEN toxic = 1 THEN r END) AS rp, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS q FROM k GROUP BY lang)
 SELECT lang, round(CASE WHEN p > 0 AND q > 0 THEN (rp - p * (p + 1) / 2.0) / (p * q) END, 6) AS auroc, p AS positives, q AS negatives FROM s""")
def d20(spark, d):
    return ag.auroc(documents_rated(spark, d), "n_chars", "toxic", ["lang"]).withColumn("auroc", r6("auroc"))


@query("d21_mean_of_means", f"WITH {CURVES}, u AS (SELECT axis, unit, avg(a_fork) AS m FROM curves WHERE a_fork IS NOT NULL GROUP BY ALL) SELECT axis, round(avg(m), 6) AS mean, count(*) AS n_units FROM u GROUP BY axis")
def d21(spark, d):
    from .curves import curves

    return ag.nested_means(curves(spark, d), ["axis"], "unit", "a_fork").withColumn("mean", r6("mean"))


@query("d22_gain_surface", f"WITH {CURVES} SELECT axis, round(s, 6) AS s, round(avg(a_fork), 6) AS a_fork, round(avg(a_ind), 6) AS a_ind, round(avg(gain), 6) AS gain, count(*) AS n FROM curves GROUP BY axis, s")
def d22(spark, d):
    from .curves import curves

    return ms.gain_surface(curves(spark, d), ["axis", "s"]).select("axis", r6("s"), r6("a_fork"), r6("a_ind"), r6("gain"), "n")


READOUT = f"""{M}, fin AS (SELECT unit, axis, label AS final FROM (SELECT unit, axis, label, count(*) AS c FROM m WHERE role = 'independent' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY unit, axis ORDER BY c DESC, label) = 1),
 rd AS (SELECT m.unit, m.axis, m.s, final, (label = final)::INT AS ok FROM m JOIN fin USING (unit, axis) WHERE role = 'fork')"""


@query("d23_readout_map", f"""WITH {READOUT}, u AS (SELECT axis, s, unit, final, avg(ok) AS acc FROM rd GROUP BY ALL), k AS (SELECT axis, s, final, count(*) AS n, avg(acc) AS r FROM u GROUP BY ALL)
 SELECT axis, round(s, 6) AS s, round(sum(n * r) / sum(n), 6) AS accuracy, sum(n)::BIGINT AS n_units, round(max(n)::DOUBLE / sum(n), 6) AS majority_baseline, round(sum(n * r) / sum(n) - max(n)::DOUBLE / sum(n), 6) AS margin, round(avg(r), 6) AS balanced_accuracy FROM k GROUP BY axis, s""")
def d23(spark, d):
    m = measurements(spark, d, by_unit=True)
    final = ag.majority(m.where("role = 'independent'"), ["unit", "axis"]).select("unit", "axis", F.col("label").alias("final"))
    u = m.where("role = 'fork'").join(final, ["unit", "axis"]).groupBy("axis", "s", "unit", "final").agg(F.avg((F.col("label") == F.col("final")).cast("int")).alias("acc"))
    k = u.groupBy("axis", "s", "final").agg(F.count(F.lit(1)).alias("n"), F.avg("acc").alias("r"))
    acc, base = F.sum(F.col("n") * F.col("r")) / F.sum("n"), F.max("n") / F.sum("n")
    return k.groupBy("axis", "s").agg(r6(acc, "accuracy"), F.sum("n").alias("n_units"), r6(base, "majority_baseline"), r6(acc - base, "margin"), r6(F.avg("r"), "balanced_accuracy")).withColumn("s", r6("s"))


@query("d24_label_distance", f"""WITH {M}, p AS (SELECT axis, label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY axis) AS p FROM m WHERE role = 'independent' GROUP BY axis, label), q AS (SELECT axis, label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY axis) AS q FROM m WHERE role = 'fork' GROUP BY axis, label)
 SELECT axis, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tv FROM p FULL JOIN q USING (axis, label) GROUP BY axis""")
def d24(spark, d):
    m = measurements(spark, d)
    return ag.distribution_distance(m.where("role = 'independent'"), m.where("role = 'fork'"), ["axis"]).select("axis", r6("tv"))


@query("d25_mark_errors", """WITH e AS (SELECT o_orderpriority AS source, CASE WHEN l_linenumber = 1 THEN date_diff('day', o_orderdate, l_shipdate) / 30.0 - l_quantity / 25 END AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT source, round(count(e)::DOUBLE / count(*), 6) AS coverage, round(avg(abs(e)), 6) AS mae, round(median(abs(e)), 6) AS median_abs, round(sqrt(avg(e * e)), 6) AS rmse, round(stddev_pop(e), 6) AS std, round(avg(e), 6) AS bias, median(abs(e)) <= 0.35 AS adopt, round(greatest(0.5, 2 * stddev_pop(e)), 6) AS bin FROM e GROUP BY source""")
def d25(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = F.when(F.col("l_linenumber") == 1, F.date_diff("l_shipdate", "o_orderdate") / 30.0 - F.col("l_quantity") / 25)
    got = ms.mark_errors(rows.select(F.col("o_orderpriority").alias("source"), e.alias("e")), ["source"], "e")
    return got.select("source", "adopt", *(r6(c) for c in ("coverage", "mae", "median_abs", "rmse", "std", "bias", "bin")))


@query("d26_anchor_coverage", """WITH e AS (SELECT user_id, event_type AS source, count(*) AS n, max(value) AS top, avg(value) AS mean FROM events GROUP BY ALL)
 SELECT source, count(*) AS units, sum(n)::BIGINT AS events, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi, round(avg(mean), 6) AS mean_uncertainty, round(max(top), 6) AS max_uncertainty FROM e GROUP BY source""")
def d26(spark, d):
    got = ms.anchor_coverage(table(spark, d, "events").withColumnRenamed("event_type", "source"), "user_id", "source", "value")
    return got.select("source", "units", "events", "single", "multi", r6("mean_uncertainty"), r6("max_uncertainty"))


PINNED_PART = 1000  # units named in one row


@query("d27_headroom", f"""WITH {CURVES}, h AS (SELECT axis, count(*) FILTER (a_ind > 0.9) AS pinned, count(*) FILTER (a_ind <= 0.9) AS open, round(avg(a_ind), 6) AS mean FROM ind GROUP BY axis),
 p AS (SELECT axis, unit, (row_number() OVER (PARTITION BY axis ORDER BY unit) - 1) // {PINNED_PART} AS part FROM ind WHERE a_ind > 0.9), l AS (SELECT axis, part, array_to_string(list_sort(list(unit)), ',') AS pinned_units FROM p GROUP BY axis, part)
 SELECT axis, coalesce(part, 0) AS part, pinned, open, mean, coalesce(pinned_units, '') AS pinned_units FROM h LEFT JOIN l USING (axis)""")
def d27(spark, d):
    """All pinned units are named, so many in a row: a list of all of an axis would be one value that grows with the table."""
    from .curves import baselines

    b = written(baselines(spark, d).select("axis", "unit", "a_ind"))
    numbers = od.numbered(b.where("a_ind > 0.9"), ["axis"], ["unit"], "n").withColumn("part", F.floor(F.col("n") / PINNED_PART))
    parts = numbers.groupBy("axis", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("unit")), lambda u: u.cast("string")), ",").alias("pinned_units"))
    got = ms.headroom(b, ["axis"]).join(parts, "axis", "left")
    return got.select("axis", F.coalesce("part", F.lit(0).cast("long")).alias("part"), "pinned", "open", r6("mean"), F.coalesce("pinned_units", F.lit("")).alias("pinned_units"))


@query("d27_pinned_registry", f"WITH {CURVES} SELECT axis, unit, round(a_ind, 6) AS a_ind FROM ind WHERE a_ind > 0.9")
def d27_registry(spark, d):
    from .curves import baselines

    return baselines(spark, d).where("a_ind > 0.9").select("axis", "unit", r6("a_ind"))


@query("d28_reliability_gate", f"""WITH {CURVES}, t AS (SELECT axis, avg(a_ind) AS retest FROM ind GROUP BY axis), r AS (SELECT axis, avg(a) AS robust FROM (SELECT axis, unit, {PAIR} AS a FROM (SELECT axis, unit, label, count(*) AS c FROM m GROUP BY ALL) GROUP BY ALL) GROUP BY axis),
 v AS (SELECT axis, avg((label IN ('A', 'large', 'high'))::INT) AS valid FROM m GROUP BY axis)
 SELECT axis, round(retest, 6) AS retest, round(robust, 6) AS robust, round(valid, 6) AS valid, retest >= 0.4 AND robust >= 0.4 AND valid >= 0.5 AS reliable,
  concat_ws('; ', CASE WHEN retest < 0.4 THEN 'retest' END, CASE WHEN robust < 0.4 THEN 'robust' END, CASE WHEN valid < 0.5 THEN 'valid' END) AS reason FROM t JOIN r USING (axis) JOIN v USING (axis)""")
def d28(spark, d):
    from .curves import baselines

    m = measurements(spark, d)
    t = baselines(spark, d).groupBy("axis").agg(F.avg("a_ind").alias("retest"))
    r = ag.pairwise_agreement(measurements(spark, d, by_unit=True), ["axis", "unit"]).groupBy("axis").agg(F.avg("agreement").alias("robust"))
    v = m.groupBy("axis").agg(F.avg(F.col("label").isin("A", "large", "high").cast("int")).alias("valid"))
    got = ms.reliability_gate(t.join(r, "axis").join(v, "axis"), {"retest": 0.4, "robust": 0.4, "valid": 0.5})
    return got.select("axis", r6("retest"), r6("robust"), r6("valid"), "reliable", "reason")


SWAPS = "x AS (SELECT o_orderpriority AS axis, year(o_orderdate) AS s, o_orderstatus AS swapped, lag(o_orderstatus) OVER w AS source, lead(o_orderstatus) OVER w AS donor FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), y AS (SELECT * FROM x WHERE source IS NOT NULL AND donor IS NOT NULL)"


def swaps(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("axis"), F.year("o_orderdate").cast("long").alias("s"), F.col("o_orderstatus").alias("swapped"), F.lag("o_orderstatus").over(w).alias("source"), F.lead("o_orderstatus").over(w).alias("donor"))
    return x.where("source IS NOT NULL AND donor IS NOT NULL")


@query("d29_follow_retain", f"WITH {SWAPS} SELECT axis, s, round(avg((swapped = donor)::INT), 6) AS follow_rate, round(avg((swapped = source)::INT), 6) AS retention_rate, round(avg((swapped <> source AND swapped <> donor)::INT), 6) AS neither_rate, count(*) AS n FROM y GROUP BY axis, s")
def d29(spark, d):
    s = F.col("swapped")
    got = ms.follow_rates(swaps(spark, d), ["axis", "s"], ms.matches(s, F.col("donor")), ms.matches(s, F.col("source")))
    return got.select("axis", "s", r6("follow_rate"), r6("retention_rate"), r6("neither_rate"), "n")


@query("d30_collision_corrected", f"""WITH {SWAPS}, f AS (SELECT axis, sum(p * p) AS floor FROM (SELECT axis, swapped, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY axis) AS p FROM y GROUP BY axis, swapped) GROUP BY axis)
 SELECT axis, count(*) AS n, count(*) FILTER (source = donor) AS collisions, round(avg((swapped = donor AND swapped <> source)::INT), 6) AS strict_follow, round(avg((swapped = source AND swapped <> donor)::INT), 6) AS strict_retain,
  round(avg((swapped = donor)::INT) FILTER (source <> donor), 6) AS follow_where_differ, round(max(floor), 6) AS floor FROM y JOIN f USING (axis) GROUP BY axis""")
def d30(spark, d):
    got = ms.corrected_rates(swaps(spark, d), ["axis"])
    return got.select("axis", "n", "collisions", r6("strict_follow"), r6("strict_retain"), r6("follow_where_differ"), r6("floor"))


@query("d31_completion", "SELECT role, count(*) AS total, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS completed, round(avg((length(trim(coalesce(text, ''))) > 0)::INT), 6) AS coverage, count(*) FILTER (contains(text, '.')) AS sentences FROM conversations GROUP BY role")
def d31(spark, d):
    done = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return ms.completion(table(spark, d, "conversations"), ["role"], done, sentences=F.contains("text", F.lit("."))).withColumn("coverage", r6("coverage"))


@query("d32_trend", f"WITH {CURVES}, a AS (SELECT axis, s, avg(gain) AS g FROM curves GROUP BY ALL) SELECT axis, round(regr_slope(g, s), 6) AS slope, round(arg_max(g, s) - arg_min(g, s), 6) AS delta, arg_max(g, s) - arg_min(g, s) > 1e-6 AS increasing FROM a GROUP BY axis")
def d32(spark, d):
    from .curves import curves

    a = curves(spark, d).groupBy("axis", "s").agg(F.avg("gain").alias("g"))
    return ms.trend(a, ["axis"], "s", "g").select("axis", r6("slope"), r6("delta"), "increasing")


@query("d33_representation_similarity", f"""WITH {VECTORS}, b AS (SELECT vec_id, label, v[1:32] AS x, v[33:64] AS y FROM vecs), p AS (SELECT list_cosine_similarity(i.x, j.x) AS cx, list_cosine_similarity(i.y, j.y) AS cy FROM b i JOIN b j ON i.label = j.label AND i.vec_id < j.vec_id),
 r AS (SELECT rank() OVER (ORDER BY round(cx, 9)) + (count(*) OVER (PARTITION BY round(cx, 9)) - 1) / 2.0 AS rx, rank() OVER (ORDER BY round(cy, 9)) + (count(*) OVER (PARTITION BY round(cy, 9)) - 1) / 2.0 AS ry FROM p)
 SELECT count(*) AS pairs, round(corr(rx, ry), 6) AS rho FROM r""")
def d33(spark, d):
    b = vectors(spark, d).select("vec_id", "label", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))
    return kn.representation_similarity(b, "vec_id", "x", "y", ["label"], places=9).select("pairs", r6("rho"))


@query("d34_status_merge", "SELECT o_custkey AS shard, coalesce(min(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END), max(CASE WHEN o_orderstatus = 'O' THEN 'OK' END), 'MISSING') AS status FROM orders GROUP BY o_custkey")
def d34(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("shard"), F.when(F.col("o_orderstatus") == "O", "OK").otherwise(F.col("o_orderstatus")).alias("token"))
    return ms.status_merge(o, ["shard"], "token")


@query("d35_taxonomy", f"""WITH {CURVES}, c AS (SELECT axis, unit, max(a_ind) AS a_ind, min(CASE WHEN gain >= 0.7 THEN s END) AS t, arg_min(a_fork, s) - max(a_ind) AS seed FROM curves GROUP BY ALL)
 SELECT axis, count(*) FILTER (a_ind >= 0.9) AS pinned, count(*) FILTER (seed >= 0.3) AS seed, count(*) FILTER (t <= 0.4) AS early, count(*) FILTER (t > 0.4 AND t < 0.7) AS mid, count(*) FILTER (t >= 0.7) AS late, count(*) FILTER (t IS NULL) AS never FROM c GROUP BY axis""")
def d35(spark, d):
    from .curves import curves

    return ms.taxonomy(curves(spark, d), ["axis"])


ACCEPT = [("ECONOMY", "small"), ("ECONOMY", "blue"), ("SMALL", "small"), ("STANDARD", "red"), ("STANDARD", "blue"), ("LARGE", "large"), ("PROMO", "red"), ("MEDIUM", "green")]


@query("d36_accept_sets", f"""WITH acc(category, label) AS (VALUES {", ".join(map(str, ACCEPT))}), p AS (SELECT p_type AS category, split_part(p_name, ' ', 1) AS label, p_size FROM part),
 q AS (SELECT category, CASE WHEN p_size % 9 = 0 THEN 'abstain' ELSE label END AS label FROM p)
 SELECT category, count(*) AS n, round(avg((a.label IS NOT NULL)::INT), 6) AS accuracy, round(avg((a.label IS NOT NULL)::INT) FILTER (q.label <> 'abstain'), 6) AS confident_accuracy, round(avg((q.label = 'abstain')::INT), 6) AS abstain_rate, avg((a.label IS NOT NULL)::INT) >= 0.1 AS passed FROM q LEFT JOIN acc a USING (category, label) GROUP BY category""")
def d36(spark, d):
    accept = spark.createDataFrame(ACCEPT, "category string, label string")
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") % 9 == 0, "abstain").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("label"))
    got = ms.accept_accuracy(p, accept, "category", "label", 0.1)
    return got.select("category", "n", r6("accuracy"), r6("confident_accuracy"), r6("abstain_rate"), "passed")
