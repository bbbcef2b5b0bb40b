"""Operator 5: URL rules behind a blocked Bloom filter, DataFrame functions only.

A rule is a canonical URL: a host, which stands for its subdomains too, and the
beginning of a path.  A URL has a candidate for each pair of a number of labels that
some rule's host has and a length that some rule's path has, so their number is bounded
by the rules, whatever the URL.  The candidates pass a Bloom filter are rows of 256 bits: one lookup of a block decides.  Those that pass meet the rules in
an exact join that removes false positives.  The filter is broadcast only up to
``BROADCAST_BLOCKS`` blocks.

A null URL or one without ``://`` has an empty host and path and fits no rule with a
host.  Of rules that fit the longest wins; a rule listed as both is a block; a null rule,
or one whose host or path no URL has, fits none.  A URL that fits none is allowed, as all
are without rules.  URLs of any length are read whole.  Null ids and rows that repeat each
give a row, no pages give none; columns but ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter for each rule, about; and the most blocks of 32 bytes that are broadcast.
BITS_PER_RULE, BLOCK_BITS, BROADCAST_BLOCKS = 16, 256, 1 << 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    tail = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail.substr(F.length(host) + 1, F.length(tail)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the bit it sets in each of the block's words."""
    bits, one = F.xxhash64(key, F.lit(1)), F.lit(1).cast("long")
    at = [F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BLOCK_BITS // 64)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.call_function("shiftleft", one, b) for b in at]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block with bits: block, w0..w3."""
    block, words = probe(F.col("key"), blocks)
    return keys.select(block.alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(words))])


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    # a host has none of /?#, a path is empty or begins with /: the first / parts them in a key
    usable = rules.where(r"host NOT RLIKE '[/?#]' AND path NOT RLIKE '[?#]' AND (path = '' OR startswith(path, '/')) AND verdict IS NOT NULL")
    keyed = usable.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("path_size"), F.length("host").alias("host_size"), "verdict")
    listed = keyed.groupBy("key", "labels", "path_size", "host_size").agg(F.max("verdict").alias("verdict"))
    # numbers of labels and lengths of paths: as many as differ among the rules
    count, sizes = listed.agg(F.count(F.lit(1)), F.collect_set(F.struct("labels", "path_size"))).first()
    blocks = max(1, -(-count * BITS_PER_RULE // BLOCK_BITS))
    bloom = bloom_filter(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)

    host, path = host_and_path(pages["url"])
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = [F.when(F.length("path") >= n, F.concat(F.substring_index("host", ".", -k), F.col("path").substr(F.lit(1), F.lit(n)))) for k, n in sorted(map(tuple, sizes))]
    # most end at the filter, where they are read; what passes is combined by URL before the shuffle
    tried = urls.where("host != '' or path != ''").select("host", "path", F.explode(F.array_distinct(F.array(*keys or [F.lit(None).cast("string")]))).alias("key")).where("key IS NOT NULL")
    block, words = probe(F.col("key"), blocks)
    probes = tried.select("*", block.alias("block"), *[w.alias(f"b{k}") for k, w in enumerate(words)])
    passed = probes.join(bloom, "block").where(" and ".join(f"(w{k} & b{k}) = b{k}" for k in range(len(words)))).select("host", "path", "key")
    exact = passed.join(listed, "key")
    verdicts = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(F.length("key"), "host_size")).alias("r"))
    joined = urls.join(verdicts, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"))
