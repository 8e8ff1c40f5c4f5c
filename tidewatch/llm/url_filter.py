"""URL filtering by host and path rules: a blocked Bloom filter, then an exact hash join.

Each rule's canonical key is its host and its path up to the last `/`. A page's keys are all
suffixes of its host at dots with all prefixes of its path at slashes, as deep as the rules go. A
blocked Bloom filter of the rules' keys (one block of four words a key) drops nearly all keys of
pages without a rule; the rest meet the rules in an exact join that removes false positives. All
steps are DataFrame functions; distinct (host, path) pairs are judged once, so a hot host is split by
its paths, and the pages of a URL that holds over a thousandth of all (null ones, too) are dealt to
several tasks where they meet its verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join

#: Blocks of a Bloom filter that is broadcast: 65,536 rows of five longs, 2.6 MB. A larger one is joined by block.
BROADCAST_BLOCKS = 1 << 16
#: Keys that a block is meant for.
KEYS_A_BLOCK = 8

#: The listed rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _keyed(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit of each of the block's four words."""
    bits = [F.pmod(F.shiftright(F.xxhash64(key, F.lit(7)), 6 * j), F.lit(64)).cast("int") for j in range(4)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in bits]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocks of a Bloom filter of keys(key): block, w0 to w3; at most `blocks` rows."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(_masks(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)])


def possible_hits(keys: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Rows of keys(key, ...) that the Bloom filter passes: all listed ones and few others."""
    held = F.broadcast(filter_blocks) if blocks <= BROADCAST_BLOCKS else filter_blocks
    found = keys.withColumn("block", _block(F.col("key"), blocks)).join(held, "block")
    passes = reduce(lambda a, b: a & b, [F.col(f"w{j}").bitwiseAND(m) == m for j, m in enumerate(_masks(F.col("key")))])
    return found.where(passes).drop("block", "w0", "w1", "w2", "w3")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url, ...).

    rules(host, path, verdict): a rule fits its host and all subdomains where the url's path starts
    with the rule's; the longest fitting rule (host and path together) decides, and of equally long
    ones the first in order. Rules with a null are left out; rule hosts are lower-cased. Pages
    without a rule get `default`. Null urls, empty ones and urls without `://` have an empty host; urls
    of any length are read whole. Repeated pages are judged each; an empty table of rules gives every
    page the default. Other columns are left out.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = rules.dropna().select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    listed = listed.withColumn("key", F.concat("rule_host", _keyed(F.col("rule_path"))))
    slashes = F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))
    # One row: how many rules there are and how deep they go.
    n, labels, depth = listed.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\."))), F.max(slashes)).first()
    blocks = 1 << (n // KEYS_A_BLOCK).bit_length()

    names = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(names) - F.lit((labels or 1) - 1))
    suffixes = F.transform(F.sequence(first, F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    depths = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(depths, F.lit(depth or 0))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"), F.lit("/"))),
    )
    pairs = judged.groupBy("host", "path").agg(F.count("*").alias("_n"))
    keys = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    keys = keys.select("host", "path", "suffix", F.explode("prefixes").alias("prefix")).select("host", "path", F.concat("suffix", "prefix").alias("key"))
    hits = possible_hits(keys, bloom_filter(listed.select("key"), blocks), blocks).join(listed, "key").where(F.expr("startswith(path, rule_path)"))
    name = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length(name)).alias("size"), name.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return spread_join(judged, best, ["host", "path"], pages.count(), "left", pairs).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = """
WITH r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT h.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM f WHERE k = 1
"""
