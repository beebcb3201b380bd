"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, covertree, exact, lexical, mixing, quality, repair, setsketch, sharding, spm, tagpaths, toxicity, urlfilter
from .common import documents, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_dedup(documents(spark, sf_dir), width=2, percent=80)


#: A conversation made of the template's own control strings, added to the table.
HARD_CASE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(HARD_CASE, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_chats(chat.conversation_records(rows), "conv_id", "turn", "record"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(documents(spark, sf_dir))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_dedup(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns, report = repair.repair(repair.damaged(rows))
    every = rows.select("conv_id").distinct()
    for part in (report.withColumnRenamed("conv", "_r"), repair.digests(turns).withColumnRenamed("conv", "_d")):
        every = every.join(part, F.col("conv_id").eqNullSafe(F.col(part.columns[0])), "left")
    none = hashlib.sha256().hexdigest()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select("conv_id", *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in counts),
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


#: What a url may not begin with, and what may follow nevertheless.
URL_RULES = [
    urlfilter.Rule("allow", "org"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/"),
]
#: Pages of hosts with such a word are listed; other spellings of their urls are caught by their canonical form.
LISTED_WORDS = "casino|bets|pills|spam|adult|ads-"


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(urlfilter.url_host(F.col("url")).rlike(LISTED_WORDS))
    return urlfilter.judge_urls(pages, listed, URL_RULES, keep=["page_id"]).drop("canonical")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_main_text": op2_main_text,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat": op5_chat,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_cover_tree": op7_cover_tree,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filter": op12_url_filter,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 20 AS f
              FROM conversations, tab),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM k, (SELECT unnest(range(2)) AS copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pre FROM o),
        r AS (SELECT *, z = '' OR again AS gone, CASE WHEN z <> '' AND NOT again AND z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS short FROM p),
        w AS (
          SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'r': ''} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS v FROM (SELECT DISTINCT conv_id FROM r)
          UNION ALL
          SELECT conv_id, i, {'c': e.c + 4, 'a': e.a || 'D', 'r': e.r},
            list_min([{'c': s.c + 4, 'a': s.a || 'D', 'r': s.r}, CASE WHEN NOT gone AND ini = 's' THEN {'c': e.c + short, 'a': e.a || 'K', 'r': e.r || chr(10) || role || ':' || text} END]),
            list_min(list_concat([{'c': u.c + 4, 'a': u.a || 'D', 'r': u.r}], flatten(list_transform([e, s, v], lambda x: [
              CASE WHEN NOT gone AND ini = 'u' AND x.c IS NOT NULL THEN {'c': x.c + short, 'a': x.a || 'K', 'r': x.r || chr(10) || role || ':' || text} END,
              CASE WHEN NOT gone AND x.c IS NOT NULL THEN {'c': x.c + 3 + short, 'a': x.a || 'R', 'r': x.r || chr(10) || 'user:' || text} END])))),
            list_min([{'c': v.c + 4, 'a': v.a || 'D', 'r': v.r},
              CASE WHEN NOT gone AND ini = 'a' AND u.c IS NOT NULL THEN {'c': u.c + short, 'a': u.a || 'K', 'r': u.r || chr(10) || role || ':' || text} END,
              CASE WHEN NOT gone AND u.c IS NOT NULL THEN {'c': u.c + 3 + short, 'a': u.a || 'R', 'r': u.r || chr(10) || 'assistant:' || text} END])
          FROM (
            SELECT conv_id, i + 1 AS i, e, s, u, list_min(list_filter([v, {'c': u.c + 3, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}], lambda x: x.c IS NOT NULL)) AS v
            FROM (SELECT conv_id, i, e, s, v, list_min(list_filter([u, {'c': e.c + 3, 'a': e.a || 'I', 'r': e.r || chr(10) || 'user:'}, {'c': s.c + 3, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'}, {'c': v.c + 3, 'a': v.a || 'I', 'r': v.r || chr(10) || 'user:'}], lambda x: x.c IS NOT NULL)) AS u
              FROM (SELECT conv_id, i, e, CASE WHEN s.c IS NOT NULL THEN s END AS s, CASE WHEN u.c IS NOT NULL THEN u END AS u, CASE WHEN v.c IS NOT NULL THEN v END AS v FROM w))) q
          JOIN r USING (conv_id, i)),
        n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (z = '') AS blank, count(*) FILTER (z <> '' AND again) AS duplicate, count(*) FILTER (short > 0) AS truncated,
                count(*) FILTER (pre IS NOT NULL AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
        fin AS (SELECT conv_id, list_min(list_filter([e, v, {'c': u.c + 3, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}, {'c': s.c + 6, 'a': s.a || 'II', 'r': s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}], lambda x: x.c IS NOT NULL)) AS x
                FROM w JOIN n USING (conv_id) WHERE i = n.n)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(substr(x.r, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN fin USING (conv_id)""",
    "op12_url_filter": r"""
        WITH p AS (
          SELECT page_id, url,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
            list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'), lambda q: NOT regexp_matches(q, '^((utm_[a-z]+|ref|gclid|fbclid)(=|$)|$)'))) AS asked
          FROM pages),
        c AS (
          SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                         || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END ELSE '' END AS canonical
          FROM p),
        r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(v, h, p)),
        fits AS (
          SELECT page_id, max_by(h || p, len(h || p)) AS rule, max_by(v, len(h || p)) AS v
          FROM c, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
        listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, 'casino|bets|pills|spam|adult|ads-') AND canonical <> '')
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
        FROM c LEFT JOIN fits USING (page_id)""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        size AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
        total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
        tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, term),
        w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
        s AS (
          SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
