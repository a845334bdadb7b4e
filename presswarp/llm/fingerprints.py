"""Document fingerprints, native: consistent weighted sampling over a document's words, weighted by their counts.

For sample k, every term draws from its hash a r ~ Gamma(2, 1), a c ~ Gamma(2, 1) and a b ~ U(0, 1). With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The sample is the (term, t) with the smallest a. Two documents agree
in a sample with the probability sum(min(w)) / sum(max(w)), their generalised Jaccard similarity.

The smallest a and its (term, t) are found by one long for each sample, which has ln a in fixed point above 32 hash bits
of (term, t), so a plain min() aggregate does the work. Documents are dealt into ranges of descending key; a range also
gets a copy of the next range's first document, so "the next document" never needs a second shuffle of texts.

Defined results: null and empty texts are without terms and have the fingerprint of zeros, as like each other as can be
(1.0) and unlike any other (0.0); null keys come last in descending order; rows of the same key are in the order of their
texts; a table of one row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty

SAMPLES = 32
SPACE = "[\\x20\\x09-\\x0D]+"
RANGES_PER_PARTITION = 4
_FIXED = 1 << 20  # steps of ln a


def _uniform(h: Column, shift: int) -> Column:
    """25 bits of a hash as a number inside (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 25) - 1).cast("bigint")).cast("double") + 0.5) / float(1 << 25)


def packed_sample(term: Column, log_weight: Column, k: int) -> Column:
    h, g = F.xxhash64(term, F.lit(k)), F.xxhash64(term, F.lit(-1 - k))
    r = -F.log(_uniform(h, 0) * _uniform(h, 25))
    log_c = F.log(-F.log(_uniform(g, 0) * _uniform(g, 25)))
    b = (F.shiftrightunsigned(h, 50).bitwiseAND(F.lit(16383).cast("bigint")).cast("double") + 0.5) / 16384.0
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b + 1.0)
    return F.shiftleft(F.floor(log_a * float(_FIXED)).cast("bigint"), 32).bitwiseOR(g.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def weighted_terms(text: Column) -> Column:
    """Each distinct word once, followed by its repeats: sorted words, cut into runs by one regular expression.

    A run is "word word word", so its weight follows from the two lengths, without a shuffle or an aggregate.
    """
    words = F.array_sort(F.array_remove(F.split(text, SPACE), ""))
    return F.regexp_extract_all(F.array_join(words, " "), F.lit("(\\S+)(?= |$)(?: \\1(?= |$))*+"), F.lit(0))


def fingerprints(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys and ``sample``: array of 32-bit values, zeros for a text without words. keys must tell rows apart.

    If ``rows`` are already dealt by some of the keys, nothing is shuffled.
    """
    terms = rows.select(*keys, F.explode_outer(weighted_terms(F.col(text))).alias("run"))
    word = F.substring_index("run", " ", 1)
    weight = (F.length("run") + 1) / (F.length(word) + 1)
    terms = terms.select(*keys, F.xxhash64(word).alias("term"), F.log(weight).alias("lw"), F.col("run").isNotNull().alias("real"))
    found = terms.groupBy(*keys).agg(F.bool_or("real").alias("real"), *[F.min(packed_sample(F.col("term"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)])
    low = [F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) for k in range(samples)]
    return found.select(*keys, F.when(F.col("real"), F.array(*low)).otherwise(F.array_repeat(F.lit(0).cast("bigint"), samples)).alias("sample"))


def as_hex(sample: Column) -> Column:
    return F.array_join(F.transform(sample, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def dealt_descending(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, id, text, guest), dealt by range of descending id; ``guest`` marks the copy of the row that comes after a range.

    Only quantiles of the ids and the first id of every range come to the driver: as many numbers as there are ranges.
    """
    n = partitions(docs.sparkSession) * RANGES_PER_PARTITION
    ids = docs.select(F.col(key).cast("bigint").alias("id"))
    found = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 20 * n).alias("q")).first().q
    cuts = sorted({*(found or [])})
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    number = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - F.size(F.filter(bounds, lambda c: c < F.col("id"))))
    heads = ids.select("id", number.alias("range")).groupBy("range").agg(F.max("id").alias("head")).orderBy("range").collect()
    rows = docs.select(F.col(key).cast("bigint").alias("id"), text_or_empty(text).alias("text")).withColumn("range", number)
    if not heads:
        return rows.select("range", "id", "text", F.lit(False).alias("guest"))
    # the first row of each range is the guest of the range before it; the first range's, of the last one
    to = F.create_map(*[F.lit(x) for k, r in enumerate(heads) for x in (r.range, heads[k - 1].range)])
    first = F.col("id").isin([r["head"] for r in heads if r["head"] is not None]) | F.col("id").isNull()
    guests = rows.filter(first).groupBy("range", "id").agg(F.min("text").alias("text"))
    guests = guests.select(F.element_at(to, F.col("range")).alias("range"), "id", "text", F.lit(True).alias("guest"))
    every = rows.select("range", "id", "text", F.lit(False).alias("guest")).unionByName(guests)
    return every.repartition(partitions(docs.sparkSession), "range")


def edited_text(text: Column, after: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``after``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edit (see ``edited_text``) with the next text in descending key order, and how
    like the text's fingerprint is to the edit's and to the next text's. Texts are shuffled once."""
    order = Window.partitionBy("range").orderBy(F.col("guest"), F.col("id").desc_nulls_last(), F.col("text"))
    rows = dealt_descending(docs, key, text)
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    rows = rows.select("range", "seq", "id", "guest", F.length("text").alias("n_chars"), "text", edited_text(F.col("text"), F.coalesce("after", F.lit(""))).alias("edited"))
    own = F.struct(F.lit(0).alias("v"), F.lit(None).cast("binary").alias("sha"), F.col("text"))
    edit = F.struct(F.lit(1).alias("v"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("edited").alias("text"))
    both = rows.select("range", "seq", "id", "guest", "n_chars", F.explode(F.when(F.col("guest"), F.array(own)).otherwise(F.array(own, edit))).alias("x"))
    both = both.select("range", "seq", "id", "guest", "n_chars", "x.v", "x.sha", "x.text")
    found = fingerprints(both, ["range", "seq", "id", "guest", "n_chars", "v", "sha"], "text", samples)
    pick = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))  # noqa: E731  one row for each v
    found = found.groupBy("range", "seq", "id", "guest", "n_chars").agg(pick(0, "sample").alias("own"), pick(1, "sample").alias("edit"), pick(1, "sha").alias("sha"))
    found = found.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("seq"))).filter(~F.col("guest"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("next", "own")).alias("near_next"),
    )
