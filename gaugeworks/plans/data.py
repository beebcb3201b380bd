"""Queries of scans, sinks and table checks (SURVEY A, B)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import checks as ck
from ..operators import tables as tb
from ..sources import journal as jn
from ..sources.tables import scratch
from .bindings import M, measurements, r6, table
from .catalog import query


@query("a01_journal_scan", "SELECT 'e' || event_id AS gen_id, event_type AS label, CASE WHEN event_id % 3 = 0 THEN 'independent' ELSE 'fork' END AS role, user_id::VARCHAR AS clip, round(day(ts) / 31.0, 6) AS s FROM events WHERE event_id % 3 = 0")
def a01(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("gen_id"), F.lit("type").alias("axis_id"), F.lit("label").alias("kind"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 3 == 0, "independent").otherwise("fork").alias("role"), F.col("user_id").cast("string").alias("clip"), F.round(F.dayofmonth("ts") / 31.0, 6).alias("s"), F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(spark, "journal")
    jn.journal_line(rows).write.text(path)
    return jn.read_journal(spark, path, "independent").where("broken IS NULL").select("gen_id", "label", "role", "clip", "s")


@query("a02_result_table", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS quantity, l_returnflag AS flag FROM lineitem")
def a02(spark, d):
    li = table(spark, d, "lineitem")
    q = F.when(F.col("l_linenumber") % 6 == 0, "nan").when(F.col("l_linenumber") % 3 == 0, "None").otherwise(F.col("l_quantity").cast("string"))
    path = scratch(spark, "results")
    li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("quantity"), F.col("l_returnflag").alias("flag")).write.option("header", True).csv(path)
    return jn.read_result_table(spark, path, {"l_orderkey": "long", "l_linenumber": "int", "l_partkey": "long", "l_suppkey": "long", "quantity": "double", "flag": "string"})


@query("a03_unit_maps", "SELECT o_custkey AS unit, o_orderstatus AS axis, month(o_orderdate)::DOUBLE AS s, max(o_totalprice) AS value FROM orders GROUP BY ALL")
def a03(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("axis"), F.month("o_orderdate").cast("string").alias("s")).agg(F.max("o_totalprice").alias("value"))
    inner = o.groupBy("unit", "axis").agg(F.map_from_entries(F.collect_list(F.struct("s", "value"))).alias("inner"))
    docs = inner.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("axis", "inner"))).alias("maps"))
    path = scratch(spark, "units")
    docs.write.json(path)
    read = spark.read.schema("unit long, maps map<string, map<string, double>>").json(path)
    return jn.flatten_unit_maps(read, "unit", "maps")


@query("a04_packed_keys", "SELECT l_orderkey AS clip, l_linenumber AS line, l_suppkey AS supp, max(l_quantity) AS value FROM lineitem GROUP BY ALL")
def a04(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_quantity").alias("value"))
    packed = jn.pack_keys(rows, ["l_linenumber", "l_suppkey"], "value", "l_orderkey")
    return jn.unpack_keys(packed, {"line": "int", "supp": "long"}, "l_orderkey").withColumnRenamed("l_orderkey", "clip")


@query("a05_payloads", "SELECT source, count(*) FILTER (doc_id % 7 <> 0 AND starts_with(text, 'T')) AS ok, count(*) FILTER (doc_id % 7 = 0) AS decode_error, count(*) FILTER (doc_id % 7 <> 0 AND NOT starts_with(text, 'T')) AS bad_magic, count(*) AS seen FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) GROUP BY source")
def a05(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", F.when(F.col("doc_id") % 7 == 0, "%%%").otherwise(F.base64(F.col("text").cast("binary"))).alias("payload"))
    todo = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    got = jn.decode_payloads(todo, "payload", "T")
    n = {k: F.count_if(F.col("status") == k).alias(k) for k in ("ok", "decode_error", "bad_magic")}
    return got.groupBy("source").agg(*n.values(), F.count(F.lit(1)).alias("seen"))


@query("a05_payload_index", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE starts_with(text, 'T')")
def a05_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("payload"))
    return jn.decode_payloads(docs, "payload", "T").where("status = 'ok'").select("doc_id", "sha256", "size")


REGISTRY = [("flag", "TIER1", "label", "exact_match"), ("size", "TIER1", "label", "krippendorff"), ("disc", "TIER2", "label", "cosine"), ("shape", "TIER2", "embedding", "cosine")]


@query("a06_config", f"""WITH {M}, reg(axis, tier, kind, metric) AS (VALUES {", ".join(map(str, REGISTRY))}) SELECT axis, tier, kind, metric, (kind = 'embedding') = (metric = 'cosine') AS coupled, count(m.unit) AS n FROM reg LEFT JOIN m USING (axis) GROUP BY ALL""")
def a06(spark, d):
    reg = spark.createDataFrame(REGISTRY, "axis string, tier string, kind string, metric string")
    return tb.registry_check(reg, measurements(spark, d)).select("axis", "tier", "kind", "metric", "coupled", "n")


@query("a07_result_sink", "WITH w AS (SELECT o_orderpriority AS axis, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1) SELECT o_orderpriority AS axis, o_orderstatus AS s, count(*) AS n, printf('%.4f', round(max(o_totalprice), 4)) AS top, low, high FROM orders JOIN w ON axis = o_orderpriority GROUP BY ALL")
def a07(spark, d):
    o = table(spark, d, "orders")
    cells = o.groupBy(F.col("o_orderpriority").alias("axis"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.format_string("%.4f", F.round(F.max("o_totalprice"), 4)).alias("top"))
    windows = o.groupBy(F.col("o_orderpriority").alias("axis")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    path = scratch(spark, "sink")
    tb.write_results(cells, windows, ["axis"], path, ["axis", "s", "n", "top", "low", "high"])
    return spark.read.parquet(path)


@query("a08_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM labels")
def a08(spark, d):
    old = table(spark, d, "labels").select("doc_id", "quality", F.lit("old").alias("version"))
    new = old.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("new").alias("version"))
    return jn.upsert(old, new, ["doc_id"])


@query("a09_pending", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 4 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def a09(spark, d):
    return jn.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", 4, 1)


@query("a09_budget", "SELECT call_key, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256('model|prompt|' || text) AS call_key FROM documents) GROUP BY call_key ORDER BY 2, 1 LIMIT 120")
def a09_budget(spark, d):
    calls = table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("model|prompt|"), "text"), 256).alias("call_key"))
    return jn.within_budget(calls, ["doc_id"], 120)


@query("a10_storage", "SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS bytes, sum(n_chars)::BIGINT * 1000 > 100000000 AS over_cap FROM documents GROUP BY lang")
def a10(spark, d):
    return jn.storage_rollup(table(spark, d, "documents"), "lang", "n_chars").withColumn("over_cap", F.col("bytes") * 1000 > 100_000_000)


@query("a10_running_cap", "SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) > 20000 AS over FROM documents".replace(" AS over ", ' AS "over" '))
def a10_cap(spark, d):
    return jn.running_cap(table(spark, d, "documents"), ["source"], "doc_id", "n_chars", 20_000).select("doc_id", "source", "running", "over")


# Checks


@query("b01_row_validation", "SELECT event_id, concat_ws(',', CASE WHEN value < 1 THEN 'low_value' END, CASE WHEN event_type = 'error' THEN 'error_type' END, CASE WHEN (props->>'k')::INT > 90 THEN 'bad_props' END) AS errors FROM events WHERE value < 1 OR event_type = 'error' OR (props->>'k')::INT > 90")
def b01(spark, d):
    rules = {"low_value": F.col("value") < 1, "error_type": F.col("event_type") == "error", "bad_props": F.get_json_object("props", "$.k").cast("int") > 90}
    return ck.with_errors(table(spark, d, "events"), rules).where(F.size("errors") > 0).select("event_id", F.concat_ws(",", "errors").alias("errors"))


@query("b01_vector_validation", "SELECT vec_id, len(embedding) <> 64 OR list_inner_product(embedding, embedding) = 0 AS bad FROM embeddings WHERE embedding IS NOT NULL")
def b01_vectors(spark, d):
    v = F.col("embedding").cast("array<double>")
    rules = {"dimension": F.size(v) != 64, "zero": exprs.dot(v, v) == 0, "not_finite": F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))}
    return ck.with_errors(table(spark, d, "embeddings").where("embedding IS NOT NULL"), rules).select("vec_id", (F.size("errors") > 0).alias("bad"))


@query("b02_completeness", """WITH k AS (SELECT l_orderkey AS o, l_linenumber AS l, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT o_orderkey AS o, unnest([1, 2, 3, 4]) AS l FROM orders)
 SELECT o, l, CASE WHEN n IS NULL THEN 'missing' WHEN x.o IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' END AS problem, coalesce(n, 0) AS n FROM k FULL JOIN x USING (o, l) WHERE n IS NULL OR x.o IS NULL OR n > 1""".replace("x.o IS NULL", "w IS NULL").replace("unnest([1, 2, 3, 4]) AS l FROM orders", "unnest([1, 2, 3, 4]) AS l, true AS w FROM orders"))
def b02(spark, d):
    actual = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("l"))
    return ck.completeness(actual, expected, ["o", "l"])


@query("b03_reconcile", """WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1), b AS (SELECT k, CASE WHEN k % 5 = 0 THEN q + 1 ELSE q END AS q, CASE WHEN k % 7 <> 0 THEN t END AS t FROM a WHERE k % 11 <> 0)
 SELECT 'q' AS field, count(*) FILTER (b.k IS NOT NULL AND abs(a.q - b.q) <= 1e-6) AS matches, count(*) - count(*) FILTER (b.k IS NOT NULL AND abs(a.q - b.q) <= 1e-6) AS mismatches, round(max(abs(a.q - b.q)), 6) AS max_delta FROM a LEFT JOIN b USING (k)
 UNION ALL SELECT 't', count(*) FILTER (b.k IS NOT NULL AND abs(a.t - b.t) <= 1e-6), count(*) - count(*) FILTER (b.k IS NOT NULL AND abs(a.t - b.t) <= 1e-6), round(max(abs(a.t - b.t)), 6) FROM a LEFT JOIN b USING (k)""")
def b03(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    k = F.col("k")
    b = a.where(k % 11 != 0).select("k", F.when(k % 5 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"), F.when(k % 7 != 0, F.col("t")).alias("t"))
    return ck.reconcile(a, b, ["k"], ["q", "t"], 1e-6).withColumn("max_delta", r6("max_delta"))


@query("b04_provenance", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'not_in_ledger' WHEN s_acctbal < 0 THEN 'not_ok' ELSE 'ratified' END AS reason FROM supplier")
def b04(spark, d):
    s = table(spark, d, "supplier")
    ledger = s.where("s_suppkey % 4 <> 0").select("s_suppkey", (F.col("s_acctbal") >= 0).alias("ok"))
    return tb.certified(s.select("s_suppkey"), ledger, ["s_suppkey"])


@query("b05_rater_integrity", "WITH s AS (SELECT role, count(DISTINCT conv_id) AS items, list_sort(list(DISTINCT conv_id::VARCHAR)) AS xs FROM conversations GROUP BY role) SELECT sha256(lower(trim(role))) AS rater, items, xs = (SELECT arg_min(xs, role) FROM s) AS same_items FROM s")
def b05(spark, d):
    return ck.rater_integrity(table(spark, d, "conversations"), "role", "conv_id").select(exprs.rater_hash(F.col("role")).alias("rater"), "items", "same_items")


@query("b06_event_catalog", "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'view') AS anchors, count(*) FILTER (value < 50) AS inside, count(DISTINCT event_id) = count(*) AS unique_ids, count(*) >= 5 AS declared_ok FROM events GROUP BY user_id")
def b06(spark, d):
    return tb.event_catalog(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "view", F.col("value") < 50, 5)


MIN_N = [("flag", 100), ("size", 150), ("disc", 5000)]


@query("b07_underpowered", f"""WITH {M}, mn(axis, min_n) AS (VALUES {", ".join(map(str, MIN_N))}) SELECT axis, min_n, count(DISTINCT unit) AS n, count(DISTINCT unit) < min_n AS underpowered FROM m JOIN mn USING (axis) GROUP BY axis, min_n""")
def b07(spark, d):
    return tb.underpowered(measurements(spark, d), spark.createDataFrame(MIN_N, "axis string, min_n int"), ["axis"])


@query("b08_eligibility", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size > 10 AND p_brand <> 'Brand#1' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)")
def b08(spark, d):
    excluded = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    rule = (F.col("p_type") == "ECONOMY") & (F.col("p_size") > 10) & (F.col("p_brand") != "Brand#1")
    return tb.eligible(table(spark, d, "part"), rule, excluded, ["p_partkey"]).select("p_partkey")


@query("b09_preflight", """WITH t AS (SELECT doc_id, 'quality' AS task FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id + 1000000, 'quality' FROM labels WHERE doc_id < 20), g AS (SELECT doc_id, string_agg(task, '+' ORDER BY task) AS tasks FROM t GROUP BY doc_id)
 SELECT g.doc_id, tasks, CASE WHEN d.doc_id IS NULL THEN 'index_join_missing' WHEN n_chars < 200 THEN 'caption_missing' WHEN source = 'src0' THEN 'missing_payload' END AS reason FROM g LEFT JOIN documents d USING (doc_id)""")
def b09(spark, d):
    labels = table(spark, d, "labels")
    tasks = [labels.where("quality = 1").select("doc_id", F.lit("quality").alias("task")), labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("task")), labels.where("doc_id < 20").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("quality").alias("task"))]
    return tb.preflight(tasks, table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id", {"caption_missing": F.col("n_chars") < 200, "missing_payload": F.col("source") == "src0"})
