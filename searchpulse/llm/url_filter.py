"""URL filtering: host rules, then a list of canonical URLs behind a blocked Bloom filter.

Every page gets a verdict. A host rule that fits decides; otherwise the page is
blocked when its canonical URL is on the list. A blocked Bloom filter (one 512-bit
block per key, eight bits set in it) keeps all but the possible hits away from the
exact hash join, which then removes the false positives.

Edge cases: a null URL or one without ``://`` has an empty host and path, no
canonical form, and is allowed; repeated URLs are judged row by row; an empty list
blocks nothing; an empty table gives no rows; URLs of any length are judged whole; columns of the input whose names clash with an output column are
replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchpulse.llm.common import ascii_lower, stored

BLOCK_WORDS = 8
WORD_BITS = 64
BITS_PER_KEY = 16
#: A filter up to this size is broadcast; a larger one is joined by shuffling (block, page) rows.
BROADCAST_BYTES = 8 << 20
#: Query parameters that do not name a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query string; all empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical_url(url: Column) -> Column:
    """Host, path without closing slashes and the sorted query without tracking parameters; null without a host."""
    host, path, query = url_parts(url)
    named = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    kept = F.array_join(F.array_sort(named), "&")
    whole = F.concat(host, F.rtrim(path, F.lit("/")), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host != "", whole)


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[0] + rule[1]


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host, path, verdict) that fits; nulls when none does.

    A rule fits its host and every subdomain when the path starts with its path.
    The rules are configuration written by hand and become one conditional expression.
    """
    name = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(rule_name(r)), len(r[0])))
    for rule in ordered:
        fits = ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))
        name = F.when(fits, rule_name(rule)).otherwise(name)
        verdict = F.when(fits, rule[2]).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bit set in each of the block's words: six bits of a second hash choose it."""
    bits = F.xxhash64(key, F.lit(1))
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(BLOCK_WORDS)
    ]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows (block, w0..w7); words are merged with OR before and after the shuffle."""
    masks = {f"m{i}": m for i, m in enumerate(_masks(F.col(key)))}
    words = [F.bit_or(f"m{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)]
    return keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(n) for n, m in masks.items()]).groupBy("block").agg(*words)


def bloom_size(n_keys: int) -> tuple[int, int]:
    """Number of blocks for ``n_keys`` and the filter's bytes."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (BLOCK_WORDS * WORD_BITS)))
    return blocks, blocks * (BLOCK_WORDS * WORD_BITS // 8 + 8)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, canonical, maybe_listed and listed.

    ``listed`` has one column ``canonical``. The list is counted, so the filter's
    size is known before it is broadcast; beyond ``broadcast_bytes`` the blocks are
    joined by shuffle instead, with the same result.
    """
    listed = stored(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed-urls")
    blocks, size = bloom_size(listed.count())
    bloom = bloom_blocks(listed, "canonical", blocks)
    if size <= broadcast_bytes:
        bloom = F.broadcast(bloom)

    host, path, _ = url_parts(F.col(url))
    made = {"host", "path", "rule", "verdict", "canonical", "maybe_listed", "listed"}
    kept = [c for c in pages.columns if c not in made]
    base = pages.select(*kept, host.alias("host"), path.alias("path"), canonical_url(F.col(url)).alias("canonical"))
    name, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "by_rule": by_rule})

    undecided = F.col("by_rule").isNull() & F.col("canonical").isNotNull()
    probe = base.withColumn("block", F.when(undecided, _block(F.col("canonical"), blocks)))
    all_set = reduce(
        lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canonical")))]
    )
    open_rows = probe.where("block IS NOT NULL").join(bloom, "block", "left")
    open_rows = open_rows.withColumn("maybe_listed", F.coalesce(all_set, F.lit(False)))
    columns = [*kept, "host", "path", "rule", "by_rule", "canonical", "maybe_listed"]
    hits = open_rows.where("maybe_listed").select(columns).join(
        listed.withColumn("listed", F.lit(True)), "canonical", "left"
    )
    missed = open_rows.where("NOT maybe_listed").select(columns).withColumn("listed", F.lit(False))
    ruled = probe.where("block IS NULL").withColumn("maybe_listed", F.lit(False)).select(columns)
    ruled = ruled.withColumn("listed", F.lit(False))
    everything = ruled.unionByName(missed).unionByName(hits)
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("by_rule", F.when(is_listed, "block").otherwise("allow"))
    return everything.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "canonical", "maybe_listed", is_listed.alias("listed"))
