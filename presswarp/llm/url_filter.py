"""URL filters, native: a blocked Bloom filter of the listed canonical URLs, then an exact hash join of what passes.

A listed URL is a rule (host, path): it fits its host and all subdomains where the page's path starts with the rule's path.
A page's candidates are its host's suffixes combined with the prefixes of its path that have the length of a rule's path.
Only candidates that pass the Bloom filter are joined exactly; the longest rule that fits decides (of equally long ones,
``block`` wins, then the smaller rule string).

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; null page ids and repeated rows
are kept as they are; an empty table gives an empty result, an empty list no rule for any row; only the key and url columns
are read, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the contract: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

BITS = 64  # of a block, one long
PROBES = 4  # bits of a key in its block
KEYS_PER_BLOCK = 4
MOST_LITERAL_BLOCKS = 1 << 17  # 1 MB of longs; larger filters are joined by block
MOST_PREFIX_LENGTHS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """a.b.c: [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def bloom_key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("|"), path)


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks).cast("bigint")).cast("int")


def bloom_mask(key: Column) -> Column:
    """The key's bits in its block: 6 hash bits for each probe."""
    again = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(again, 6 * k).bitwiseAND(F.lit(BITS - 1).cast("bigint")).cast("int")) for k in range(PROBES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def build_bloom(rules: DataFrame, n_rules: int) -> tuple[DataFrame, int]:
    """(block, word) of the filter, one row for each block that holds a key; number of blocks."""
    blocks = max(1, -(-n_rules // KEYS_PER_BLOCK))
    key = bloom_key(F.col("rule_host"), F.col("rule_path"))
    return rules.select(bloom_block(key, blocks).alias("block"), bloom_mask(key).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word")), blocks


def words_array(filter_rows: DataFrame, blocks: int) -> Column:
    """The filter's words as one value of the plan: a text that the optimizer turns into an array once, however many words there are."""
    words = {r.block: r.word for r in filter_rows.collect()}
    return F.split(F.lit(",".join(str(words.get(b, 0)) for b in range(blocks))), ",").cast("array<bigint>")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict), one row for each of ``pages``. rules: (rule_verdict, rule_host, rule_path).

    The filter's words are one value of the plan up to MOST_LITERAL_BLOCKS (a size known before they are fetched) and a table joined by block
    beyond. Pages without a candidate that passes have their verdict at once and are not shuffled. Of the others each distinct host and path is
    judged once, whatever number of pages has it, and the pages get its verdict by a join, whose small side the planner broadcasts below
    its own threshold.
    """
    rules = rules.select("rule_verdict", "rule_host", "rule_path").distinct()
    n_rules = rules.count()
    filter_rows, blocks = build_bloom(rules, n_rules)
    lengths = [r.n for r in rules.select(F.length("rule_path").alias("n")).distinct().orderBy("n").limit(MOST_PREFIX_LENGTHS + 1).collect()]
    rows = pages.select(F.col(key).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>") if len(lengths) <= MOST_PREFIX_LENGTHS else F.sequence(F.lit(0), F.length("path"))
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path")))))
    none = F.array().cast("array<struct<rule_host: string, rule_path: string>>")
    literal = blocks <= MOST_LITERAL_BLOCKS
    if literal:
        table = words_array(filter_rows, blocks)

        def passes(c: Column) -> Column:
            k = bloom_key(c["rule_host"], c["rule_path"])
            return F.get(table, bloom_block(k, blocks)).bitwiseAND(bloom_mask(k)) == bloom_mask(k)

        candidates = F.filter(candidates, passes)
    rows = rows.withColumn("candidates", F.when(F.col("host") != "", candidates).otherwise(none))
    plain = rows.filter(F.size("candidates") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    some = rows.filter(F.size("candidates") > 0)
    hits = some.groupBy("host", "path").agg(F.any_value("candidates").alias("c")).select("host", "path", F.explode("c").alias("c")).select("host", "path", "c.rule_host", "c.rule_path")
    if not literal:
        k = bloom_key(F.col("rule_host"), F.col("rule_path"))
        hits = hits.withColumn("block", bloom_block(k, blocks)).join(filter_rows, "block").filter(F.col("word").bitwiseAND(bloom_mask(k)) == bloom_mask(k))
    # the exact join: false positives find no rule
    found = hits.join(rules, ["rule_host", "rule_path"])
    rule = F.struct((-F.length("rule_host") - F.length("rule_path")).alias("order"), (F.col("rule_verdict") != "block").alias("allows"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    best = found.groupBy("host", "path").agg(F.min(rule).alias("best"))
    judged = some.select("page_id", "host", "path").join(best, ["host", "path"], "left")
    return plain.unionByName(judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))


def contract_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule_verdict string, rule_host string, rule_path string")
