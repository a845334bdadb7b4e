"""Joins and per-key ranking that several surfaces share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ops import as_of
from .reading import first_of

__all__ = ["as_of", "carried_forward", "competition_rank", "fair_interleave", "first_of", "follow_chain", "interval_join", "mutual_links", "overlap_join", "quota"]


def overlap_join(left: DataFrame, right: DataFrame, left_array: str, right_array: str) -> DataFrame:
    """Pairs whose arrays share an element: an equi-join of elements instead of a comparison of all pairs."""
    a = left.withColumn("__e", F.explode(F.array_distinct(left_array)))
    b = right.withColumn("__e", F.explode(F.array_distinct(right_array)))
    return a.join(b, "__e").drop("__e").distinct()


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Right rows of the same key in the ``seconds`` up to each left row. Time is cut into bins of that length, so a left row
    meets two bins and a hot key is spread over its bins."""
    bin_of = lambda t: F.floor(F.unix_seconds(t) / seconds)
    a = left.withColumn("__bin", F.explode(F.array(bin_of(left_time), bin_of(left_time) - 1)))
    b = right.withColumn("__bin", bin_of(right_time))
    age = F.unix_seconds(left_time) - F.unix_seconds(right_time)
    return a.join(b, [key, "__bin"]).filter((age >= 0) & (age < seconds)).drop("__bin")


def carried_forward(rows: DataFrame, keys: list[str], snapshot: str, newest: Column, days: int = 7) -> DataFrame:
    """The newest row of each key among snapshots at most ``days`` before the newest one; marks what is carried."""
    near = rows.withColumn("__newest", newest).filter(F.date_diff("__newest", snapshot).between(0, days))
    w = Window.partitionBy(*keys).orderBy(F.col(snapshot).desc())
    return near.withColumn("__n", F.row_number().over(w)).filter("__n = 1").withColumn("carried", F.col(snapshot) < F.col("__newest")).drop("__n", "__newest")


def competition_rank(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """1, 2, 2, 4."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order)))


def quota(rows: DataFrame, archived: Column, order: list[Column], reserved: int, total: int) -> DataFrame:
    """At most ``reserved`` archived rows first, then others, then the rest of the archived, ``total`` in all."""
    a = rows.filter(archived).orderBy(*order).limit(total)
    a = a.withColumn("__n", F.row_number().over(Window.orderBy(*order))).withColumn("__band", F.when(F.col("__n") <= reserved, 0).otherwise(2))
    b = rows.filter(~archived).orderBy(*order).limit(total)
    b = b.withColumn("__n", F.row_number().over(Window.orderBy(*order))).withColumn("__band", F.lit(1))
    return a.unionByName(b).orderBy("__band", "__n").limit(total).drop("__n", "__band")


def fair_interleave(rows: DataFrame, key: str, first: list[Column], second: list[Column], n: int, oldest: list[Column] | None = None) -> DataFrame:
    """(place, key): turns of two orders over the same rows, each row once: the next row of the first order that was not taken, of the second, of
    the first, ...; the first row of a third order before them all, where one is given.

    Only the first n of either order can be taken in n turns, so what is taken in turns is one row with two lists of at most n keys.
    """
    lines = [("a", first, n), ("b", second, n), *([("c", oldest, 1)] if oldest else [])]
    state = None
    for name, order, most in lines:
        ranked = rows.orderBy(*order).limit(most).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
        line = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(key).alias("k")))), lambda x: x["k"]).alias(name))
        state = line if state is None else state.crossJoin(F.broadcast(line))
    start = F.slice("c", 1, 1) if oldest else F.slice("a", 1, 0)

    def turn(taken: Column, k: Column) -> Column:
        fresh = lambda line: F.filter(line, lambda x: ~F.array_contains(taken, x))
        return F.concat(taken, F.slice(F.when(k % 2 == 0, fresh(F.col("a"))).otherwise(fresh(F.col("b"))), 1, 1))

    taken = F.slice(F.aggregate(F.sequence(F.lit(0), F.lit(2 * n - 1)), start, turn), 1, n)
    return state.select(F.posexplode(taken).alias("place", key)).select((F.col("place") + 1).cast("bigint").alias("place"), key)


def follow_chain(pointers: DataFrame, key: str, to: str, hops: int = 20) -> DataFrame:
    """(key, target): where merges end, following at most ``hops`` pointers; the distance followed doubles each round."""
    now = pointers.select(F.col(key).alias("k"), F.col(to).alias("t"))
    rounds = max(1, (hops - 1).bit_length())
    for _ in range(rounds):
        step = now.select(F.col("k").alias("t"), F.col("t").alias("further"))
        now = now.join(step, "t", "left").select("k", F.coalesce("further", "t").alias("t"))
    return now.select(F.col("k").alias(key), F.col("t").alias("target"))


def mutual_links(members: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """(a, b, shared): items that at least ``least`` groups have together, both ways. members should have few items a group."""
    m = members.select(group, item).distinct()
    pairs = m.select(group, F.col(item).alias("a")).join(m.select(group, F.col(item).alias("b")), group).filter("a < b")
    found = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
