"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list is a table of canonical URLs: host and path prefix, with a verdict. An URL's
candidate keys are all its parent domains with all path prefixes of listed lengths. Inside
the row, each key looks into one 64-bit block of the filter; only keys whose bits are all
set leave the row for the exact join on the key, which removes false positives. DataFrame
functions only.

The filter has `BITS` bits a listed URL, up to `FILTER_BLOCKS` blocks of 8 bytes, and is a
scalar of the plan, so a list of any length is filtered the same way; beyond that size
more keys pass, which the exact join then tells apart. Listed URLs are broadcast to that
join under `SMALL_ROWS` rows, which are counted, else it shuffles on the key.

The list where no rule speaks, `listed_hosts`, is derived from the pages: canonical hosts
with a word of `BLOCKED_WORDS` among the words of their labels, and some given ones.
Canonical hosts have no user, no port and no last dot.

Edge cases: a null URL, or one without `://`, has an empty host and path and matches
no rule; distinct (host, path) pairs are judged once, so repeated URLs and a host with
a third of all rows cost one row each; the longest listed URL wins, then the longer
host, then the text order; an URL that is listed with two verdicts is blocked; a very long
URL has as many keys as labels times listed lengths; an empty list blocks nothing; an
empty table gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hosts that are listed whatever the pages are.
BLOCKED_HOSTS = ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
#: Words of a host's labels that put it on the list.
BLOCKED_WORDS = ("ads", "adult", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")
BITS, FILTER_BLOCKS, SMALL_ROWS = 128, 1 << 20, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit block."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows (block, bits) over listed (key)."""
    own = listed.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("mask"))
    return own.groupBy("block").agg(F.bit_or("mask").alias("bits"))


def packed_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as one row with an array of all blocks; at most `FILTER_BLOCKS` of them."""
    every = listed.sparkSession.range(blocks).select(F.col("id").alias("block")).join(bloom(listed, blocks), "block", "left")
    packed = every.agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    return packed.select(F.col("all.bits").alias("filter"))


def canonical(of: Column) -> Column:
    """A host without user, port and last dot."""
    return F.regexp_replace(of, r"^.*@|:[0-9]*$|\.$", "")


def listed_hosts(pages: DataFrame, words=BLOCKED_WORDS, given=BLOCKED_HOSTS) -> DataFrame:
    """The list (host, path, verdict) of the pages' hosts that have a listed word, and of given ones."""
    hosts = pages.select(canonical(host(F.col("url"))).alias("host")).distinct()
    found = hosts.where(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words))))
    always = pages.sparkSession.createDataFrame([(h,) for h in given], "host string")
    return found.unionByName(always).distinct().select("host", F.lit("/").alias("path"), F.lit("block").alias("verdict"))


def possible_keys(urls: DataFrame, entries: DataFrame, lengths: list[int], size: int, most: int = FILTER_BLOCKS) -> DataFrame:
    """(host, path, key) of distinct URLs' candidate keys that pass the filter over `size` entries."""
    blocks = max(1, min((size * BITS + 63) // 64, most))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    heads = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    probed = urls.select("host", "path").distinct().withColumn("filter", packed_bloom(entries, blocks).scalar())
    passed = F.filter(keys, lambda k: F.get("filter", _block(k, blocks).cast("int")).bitwiseAND(_mask(k)) == _mask(k))
    return probed.select("host", "path", F.explode(passed).alias("key"))


def listed_matches(urls: DataFrame, listed: DataFrame, most: int = FILTER_BLOCKS) -> DataFrame:
    """Longest listed URL of each distinct (host, path): host, path, rule, verdict.

    `listed` has host, path (a prefix) and verdict; "block" wins over "allow".
    """
    entries = listed.select(F.concat("host", "path").alias("key"), F.length("host").alias("_h"), "verdict").groupBy("key").agg(F.max("_h").alias("_h"), F.max("verdict").alias("verdict"))
    size = entries.count()
    lengths = [r["n"] for r in listed.select(F.length("path").alias("n")).distinct().collect()]
    exact = possible_keys(urls, entries, lengths, size, most).join(F.broadcast(entries) if size <= SMALL_ROWS else entries, "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "_h", "key", "verdict")).alias("top"))
    return best.select("host", "path", F.col("top.key").alias("rule"), F.col("top.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, others: DataFrame) -> DataFrame:
    """Per page: host, path, rule and verdict; `others` is the list where no rule fits.

    Rules see hosts and paths as they are; the list sees canonical hosts, and / for an
    empty path.
    """
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = listed_matches(split, rules)
    as_listed = lambda df: df.withColumn("_host", canonical(F.col("host"))).withColumn("_path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    plain = as_listed(split).select(F.col("_host").alias("host"), F.col("_path").alias("path"))
    other = listed_matches(plain, others).select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_other"))
    joined = as_listed(split.join(ruled, ["host", "path"], "left")).join(other, ["_host", "_path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", "_other", F.lit("allow")).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
