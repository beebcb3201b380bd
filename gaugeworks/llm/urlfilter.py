"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, PAGE = 8, 64  # a block is 8 words of 64 bits, one bit of each word a key; a row of the filter holds 64 blocks
BITS_PER_KEY = 16

# Query parameters that say where a visitor comes from, not what the page is.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"


class Rule(NamedTuple):
    """``verdict`` for the host and its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One name for the usual spellings of an address: no scheme, leading ``www.`` or ``m.``, default port, trailing
    slashes, fragment or tracking parameters; other parameters sorted. Empty where the host is empty."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), "^(www|m)\\.", ""), ":(80|443)$", "")
    asked = F.split(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), "&")
    kept = F.array_join(F.sort_array(F.filter(asked, lambda p: ~p.rlike(f"^(({TRACKING})(=|$)|$)"))), "&")
    whole = F.concat(host, F.regexp_replace(url_path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", F.coalesce(whole, F.lit(""))).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule (host and path together, then host) that fits, else null."""
    if not rules:
        return F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    return F.coalesce(*(F.when(r.fits(host, path), F.lit(value(r))) for r in order))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each word of the block as a mask."""
    bits = F.xxhash64(key, F.lit(1))
    masks = [F.expr("cast(1 as bigint)")] * WORDS
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [
        F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j, one in enumerate(masks)
    ]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (page, words) of a blocked Bloom filter: every key sets eight bits of one 512-bit block.

    Bits are joined by ``bit_or``, first inside tasks, so a hot key or block is one row a task. A page is 64 blocks.
    """
    block, masks = _places(F.col(key), blocks)
    per_block = keys.select(block.alias("block"), *[m.alias(f"w{j}") for j, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])
    entry = F.struct((F.col("block") % PAGE).cast("int").alias("at"), F.array(*[f"w{j}" for j in range(WORDS)]).alias("words"))
    paged = per_block.groupBy(F.floor(F.col("block") / PAGE).alias("page")).agg(F.map_from_entries(F.collect_list(entry)).alias("at"))
    none = F.array(*[F.lit(0).cast("long")] * WORDS)
    filled = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda b: F.coalesce(F.try_element_at("at", b), none)))
    return paged.select("page", filled.alias("words"))


def with_possible(df: DataFrame, pages: DataFrame, key: str, blocks: int) -> DataFrame:
    """Add boolean ``_possible``: false only for keys that are certainly not in the filter.

    The filter is joined by page, with no hint: Spark sends a small one to all tasks and shuffles narrow rows to a large one.
    """
    block, masks = _places(F.col(key), blocks)
    first = ((F.col("_block") % PAGE) * WORDS).cast("int")
    joined = df.withColumn("_block", block).withColumn("_page", F.floor(F.col("_block") / PAGE)).join(pages.toDF("_page", "_words"), "_page", "left")
    hit = reduce(Column.__and__, (F.get("_words", first + j).bitwiseAND(m) != 0 for j, m in enumerate(masks)))
    return joined.withColumn("_possible", F.coalesce(hit, F.lit(False))).drop("_block", "_page", "_words")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url_col: str = "url", listed_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row (None: all) with host, path, canonical, rule and verdict (``allow`` or ``block``).

    The longest rule that fits decides. Where none fits, ``block`` if the canonical url is that of a row of
    ``listed``: a blocked Bloom filter lets possible hits through, an exact join on the canonical url removes the
    false ones; rows that the filter rules out meet no join. ``rules`` is a list of the program; ``listed`` may be
    of any size (16 bits of filter a url), as may the number of rows that share a url, host or listed url.

    Null urls and urls without ``://`` have empty host, path and canonical, fit no rule and are allowed; such rows of
    ``listed`` list nothing. Repeated rows are judged each, repeated list rows count once, an empty list blocks
    nothing, an empty table gives an empty result. Columns named like a result are replaced by it. A url of any
    length is judged whole.
    """
    names = ("host", "path", "canonical", "rule", "verdict")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in names]
    lists = written(listed.select(canonical(F.col(listed_col)).alias("_canonical")).where("_canonical <> ''").distinct())
    blocks = max(PAGE, 1 << (lists.count() * BITS_PER_KEY // (64 * WORDS)).bit_length())
    url = F.col("_url")
    rows = pages.select(F.struct(*kept).alias("_row") if kept else F.struct(F.lit(None)).alias("_row"), F.col(url_col).alias("_url")).select(
        "_row", url_host(url).alias("host"), url_path(url).alias("path"), canonical(url).alias("canonical")
    ).withColumns({"rule": longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.name), "_ruled": longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict)})
    marked = with_possible(rows, written(bloom_filter(lists, "_canonical", blocks)), "canonical", blocks)
    asked = F.col("_possible") & F.col("_ruled").isNull()
    sure = marked.where(~asked).withColumn("verdict", F.coalesce("_ruled", F.lit("allow")))
    exact = marked.where(asked).join(lists, F.col("canonical") == F.col("_canonical"), "left")
    found = exact.withColumn("verdict", F.when(F.col("_canonical").isNotNull(), "block").otherwise("allow")).drop("_canonical")
    out = [F.col(f"_row.{c}") for c in kept]
    return sure.select(*out, *names).unionAll(found.select(*out, *names))
