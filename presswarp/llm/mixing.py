"""Mixing sources to target weights.

Every document gets a hash-random key. Inside each source the documents are sorted by range of the key: range totals are
summed over the ranges before (a small table), and a window inside the range in which the budget ends adds the rest of the
prefix sum. The mix takes whole epochs of a source first and cuts the last one at the source's exact budget of words.

Nulls and other odd rows: a null text has size 0 and is taken 0 words; a null source is a source of its own (last in
order); a null doc_id has the key of the empty string; repeated rows each take their own turn; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_name, text_or_empty

RANGE_DIGITS = 3  # ranges of the key: 16 ** 3 for each source
MOST_REPEATS = 3


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MOST_REPEATS) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight and target.

    Target = min(cap * size, level * weight), where the level makes all targets sum to all sizes: what sources above their
    cap can't use goes to the others by weight, again and again, which ends at this level. One row a source, so the
    windows over the whole table are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest).cast("double")
    rows = rows.withColumn("level", level)
    right = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    rows = rows.withColumn("level", F.first(right, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def random_key(key: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))


def cuts(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """rows: (doc_id, source, size, random). One row a source: its size, target, whole epochs, and where the last epoch is cut:
    rows before (cut_random, cut_id, cut_size) are taken once more, of the equal_rows at that place cut_words in all.

    Sums of ranges come first; then only the one range of each source in which its budget ends is put in order, with rows that
    agree in key, id and size counted before, so a key that many rows share is no larger than any other.
    """
    rows = rows.withColumn("part", F.substring("random", 1, RANGE_DIGITS))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    budget = F.floor("target").cast("bigint")
    epochs = F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint")
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    here = parts.join(targets, F.col("source").eqNullSafe(F.col("of"))).filter("part_start < rest and rest <= part_start + part_size").select("of", F.col("part").alias("in_part"), (F.col("rest") - F.col("part_start")).alias("left"))
    groups = rows.join(here, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part"))).groupBy("of", "left", "random", "doc_id", "size").agg(F.count(F.lit(1)).alias("equal_rows"))
    inside = Window.partitionBy("of").orderBy("random", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("ahead", F.coalesce(F.sum(F.col("equal_rows") * F.col("size")).over(inside), F.lit(0)))
    at = groups.filter("ahead < left and left <= ahead + equal_rows * size").select(F.col("of").alias("cut_of"), F.col("random").alias("cut_random"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), "equal_rows", (F.col("left") - F.col("ahead")).alias("cut_words"))
    return targets.join(at, F.col("of").eqNullSafe(F.col("cut_of")), "left").select("of", "source_size", "target", "epochs", "cut_random", "cut_id", "cut_size", "equal_rows", "cut_words")


def _numbered(joined: DataFrame, names: dict[str, str], tie: Column, order: Column) -> DataFrame:
    """Adds ``turn``: the place of a row among those at its source's cut, 0 for all others."""
    turn = names["turn"]
    if not joined.filter(tie & (F.col(names["equal_rows"]) > 1)).take(1):
        return joined.withColumn(turn, F.lit(0).cast("bigint"))
    at = F.coalesce(tie & (F.col(names["equal_rows"]) > 1), F.lit(False))
    place = F.row_number().over(Window.partitionBy(names["of"]).orderBy(order)) - 1
    return joined.filter(~at).withColumn(turn, F.lit(0).cast("bigint")).unionByName(joined.filter(at).withColumn(turn, place.cast("bigint")))


_OWN = ("of", "source_size", "target", "epochs", "cut_random", "cut_id", "cut_size", "equal_rows", "cut_words", "turn", "random", "size", "taken")


def with_taken(docs: DataFrame, at: DataFrame, names: dict[str, str], key: str, source: str, order: Column) -> DataFrame:
    """docs with ``size`` and ``random`` under the names given, joined with cuts(): adds ``taken``. Rows of docs stay where they are
    as long as Spark deems the sources' table (a row each) small enough to broadcast."""
    n = {k: F.col(v) for k, v in names.items()}
    joined = docs.join(at.select(*[F.col(c).alias(names[c]) for c in at.columns]), F.col(source).eqNullSafe(n["of"]))
    id_, cut = F.col(key), n["cut_id"]
    same_key = n["random"] == n["cut_random"]
    less_id = (id_.isNull() & cut.isNotNull()) | F.coalesce(id_ < cut, F.lit(False))
    whole = (n["random"] < n["cut_random"]) | (same_key & (less_id | (id_.eqNullSafe(cut) & (n["size"] < n["cut_size"]))))
    tie = same_key & id_.eqNullSafe(cut) & (n["size"] == n["cut_size"])
    joined = _numbered(joined, names, tie, order)
    own = F.greatest(F.lit(0), F.least(n["size"], n["cut_words"] - n["turn"] * n["size"]))
    taken = n["epochs"] * n["size"] + F.when(whole, n["size"]).when(tie, own).otherwise(F.lit(0))
    return joined.withColumn(names["taken"], taken.cast("bigint"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, taken): words that the mix takes of each row, repeats counted.

    Only keys, sources and sizes are moved, and of those only what lies where a source's budget ends.
    """
    names = {c: c for c in _OWN}
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), random_key(F.col(key), seed).alias("random"))
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.put(rows)
    return with_taken(rows, scratch.put(cuts(rows, weights)), names, "doc_id", "source", F.col("size")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken whole, and the row at which a source's
    budget ends once more, cut after the last word that fits. Rows of which nothing is taken go. Where a budget ends among rows
    that agree in id, source and size, each takes its own turn, in the order of a hash of the texts."""
    columns = docs.columns
    names = {c: free_name(f"mix_{c}", columns) for c in (*_OWN, "cuts", "cut")}
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = scratch.put(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), random_key(F.col(key), seed).alias("random")))
    at = scratch.put(cuts(rows, weights))
    scratch.drop(rows)
    sized = docs.withColumn(names["size"], word_count(text)).withColumn(names["random"], random_key(F.col(key), seed))
    joined = with_taken(sized, at, names, key, source, F.xxhash64(text)).filter(F.col(names["taken"]) > 0)
    taken, size, cut = F.col(names["taken"]), F.col(names["size"]), F.col(names["cut"])
    whole, rest = F.floor(taken / size).cast("int"), (taken % size).cast("int")
    joined = joined.withColumn(names["cut"], F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.greatest(cut, F.lit(1))), "")
    out = joined.withColumn(text, F.when(cut > 0, words).otherwise(F.col(text)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(cut > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*columns)
