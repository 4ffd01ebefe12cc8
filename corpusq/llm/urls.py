"""URL filters: a blocked Bloom filter of the listed keys lets possible hits through to an exact hash join.

A listed key is host + path. A URL fits a key if the key's host is its host or a parent domain of it, and its path starts
with the key's path. So a URL's possible keys are its domain suffixes, each with the prefixes of its path that have the
length of some listed path. Each possible key is looked up in the filter (one block of four 64-bit words, a bit in
each) where it is made, and only those that pass become rows, which join the list exactly. The longest listed key wins (ties: the
first by code point).

The filter goes to the tasks as one value of at most MAX_BLOCKS blocks of 32 bytes. For a longer list the filter is a
table that is joined by block, so it grows with the list and lets no more through.

Defined cases: a null URL, or one without "://", has empty host and path and fits no rule; rows with equal page_id and
URL are judged each by itself and all returned; a very long URL has a key for each of its domains and listed lengths; an empty table gives no rows, an empty list only default verdicts;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_BLOCKS = 1 << 18
#: Listed keys to a block of 256 bits.
KEYS_PER_BLOCK = 16


def parsed(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lowered, and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)").alias("rest"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column `key`: (block, w0 .. w3)."""
    each = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return each.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url) and the list (host, path, verdict) to page_id, host, path, rule, verdict."""
    listed = stage(
        listed.where("host is not null").groupBy(F.concat(F.col("host"), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("path_length")).agg(F.min("verdict").alias("rule_verdict")).select("key", "path_length", "rule_verdict"), "url-list"
    )
    lengths = [r[0] for r in listed.select("path_length").distinct().orderBy("path_length").collect()]  # no more than the longest path has letters
    if not lengths:
        lengths = [0]
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    bloom = bloom_blocks(listed.select("key"), blocks)

    rows = pages.select("page_id", "url")
    host, path = parsed(F.col("url"))
    urls = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.struct(n.alias("n"), F.substring(F.col("path"), F.lit(1), n).alias("p")))
    keys = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(F.concat(h, p["p"]).alias("key"), p["n"].alias("n"))))))
    keys = F.coalesce(keys, F.array().cast("array<struct<key:string,n:int>>"))
    words = [f"w{i}" for i in range(4)]
    if blocks <= MAX_BLOCKS:
        # every block in order, those without a key as zeros, as one value
        dense = pages.sparkSession.range(blocks).withColumnRenamed("id", "block").join(bloom, "block", "left").select("block", *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in words])
        urls = urls.withColumn("filter", dense.agg(F.array_sort(F.collect_list(F.struct("block", *words)))).scalar())

        def likely(x):
            own = F.element_at("filter", (F.pmod(F.xxhash64(x["key"]), F.lit(blocks)) + 1).cast("int"))
            return reduce(Column.__and__, [own[w].bitwiseAND(bit) != 0 for w, bit in zip(words, _bits(x["key"]), strict=True)])

        keys = F.filter(keys, likely)
    # A first entry without a key keeps every row, and counts rows that are the same.
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("n")))
    passed = urls.select("page_id", "url", "host", "path", F.explode(F.concat(none, keys)).alias("x")).select("page_id", "url", "host", "path", "x.key", "x.n")
    if blocks > MAX_BLOCKS:
        tested = passed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(bloom, "block", "left")
        passed = tested.where(F.col("key").isNull() | reduce(Column.__and__, [F.col(w).bitwiseAND(bit) != 0 for w, bit in zip(words, _bits(F.col("key")), strict=True)]))
    found = passed.join(listed.withColumnRenamed("key", "rule"), F.expr("key = rule and n = path_length"), "left").select("page_id", "url", "host", "path", F.col("key").isNull().alias("row"), "rule", "rule_verdict")
    best = F.min_by(F.struct("rule", "rule_verdict"), F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), "rule"))).alias("best")
    return (
        found.groupBy("page_id", "url", "host", "path")
        .agg(best, F.count_if("row").alias("rows"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"), F.explode(F.expr("sequence(1L, rows)")).alias("r"))
        .drop("r")
    )
