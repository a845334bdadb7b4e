"""Pools of sources and jobs: statistics, reserves, retention, repair and archive groups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILING_LEAST, FAILING_SHARE, MOST_REPLACED = 10, 0.1, 12
OLD_TURNS = (2, 5, 8)  # fixed value


def outage(failing: Column, total: Column, replaced: Column) -> Column:
    """Replacing stops when too much fails at once, or too much was replaced in a day."""
    return (failing >= F.greatest(F.lit(FAILING_LEAST), F.ceil(total * FAILING_SHARE))) | (replaced >= MOST_REPLACED)


def pool_statistics(sources: DataFrame, active: DataFrame, resting: DataFrame, key: str) -> DataFrame:
    """Counts of sources that are active, resting and not active, and neither: flags by left joins, one aggregate."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    s = sources.join(flag(active, "a"), key, "left").join(flag(resting, "r"), key, "left")
    return s.agg(F.count_if(F.col("a").isNotNull()).alias("active"), F.count_if(F.col("a").isNull() & F.col("r").isNotNull()).alias("resting"), F.count_if(F.col("a").isNull() & F.col("r").isNull()).alias("idle"))


def retained(rows: DataFrame, time: str, now: datetime, days: dict[str, int], status: str) -> DataFrame:
    """Rows that are younger than their status allows; a status without a limit is kept."""
    keep = F.lit(False)
    for value, n in days.items():
        keep = keep | ((F.col(status) == value) & (F.col(time) >= F.lit(now - timedelta(days=n))))
    return rows.filter(keep | ~F.col(status).isin(*days))


def terminal_jobs(jobs: DataFrame, key: str, time: str, state: str, live: tuple[str, ...], ended: tuple[str, ...], before: Column) -> DataFrame:
    """Each key's latest ended job, if it ended long enough ago and no job of the key is live."""
    last = jobs.filter(F.col(state).isin(*ended)).groupBy(key).agg(F.max(F.struct(time, state)).alias("x"))
    running = jobs.filter(F.col(state).isin(*live)).select(key).distinct()
    return last.filter(F.col(f"x.{time}") <= before).join(running, key, "left_anti").select(key, f"x.{state}", f"x.{time}")


def archive_groups(rows: DataFrame, day: str, by: str) -> DataFrame:
    """Editions by month, by the month of their week's Monday, or by year, newest first inside a group."""
    key = {"month": F.date_format(day, "yyyy-MM"), "week": F.date_format(F.date_trunc("week", day), "yyyy-MM"), "year": F.date_format(day, "yyyy")}[by]
    each = rows.groupBy(key.alias("group")).agg(F.sort_array(F.collect_set(F.date_format(day, "yyyy-MM-dd")), asc=False).alias("days"))
    return each.select("group", "days", F.size("days").alias("n"))


def stratified_sample(rows: DataFrame, keys: list[str], id_: str, k: int, seed: int) -> DataFrame:
    """k rows of each stratum in the order of a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_))).filter(F.col("__n") <= k).drop("__n")


# A linear congruential generator of 32 bits.
LCG_FACTOR, LCG_STEP, LCG_SIZE = 1664525, 1013904223, 1 << 32


def lcg_key(position: Column, seed: int) -> Column:
    """The number that the generator gives for the row at a position (from 0): its state position + 1 steps after the seed. The steps 1, 2, 4, ... are affine maps
    that are known before, so a row needs 40 small ones at most and no row waits for another."""
    maps, factor, step = [], LCG_FACTOR, LCG_STEP
    for k in range(40):
        maps.append(F.struct(F.lit(k).alias("k"), F.lit(factor).cast("bigint").alias("factor"), F.lit(step).cast("bigint").alias("step")))
        factor, step = factor * factor % LCG_SIZE, (factor * step + step) % LCG_SIZE
    steps = position.cast("bigint") + 1
    used = F.filter(F.array(*maps), lambda m: F.pmod(F.floor(steps / F.pow(F.lit(2.0), m["k"])).cast("bigint"), F.lit(2)) == 1)

    def moved(state: Column, m: Column) -> Column:
        """The state's halves of 16 bits are taken one by one, so that no product leaves a long."""
        high = F.pmod(F.floor(state / 65536).cast("bigint") * F.pmod(m["factor"], F.lit(65536)), F.lit(65536)) * 65536
        return F.pmod(F.pmod(state, F.lit(65536)) * m["factor"] + high + m["step"], F.lit(LCG_SIZE).cast("bigint"))

    return F.aggregate(used, F.lit(seed % LCG_SIZE).cast("bigint"), moved)


def seeded_sample(rows: DataFrame, position: str, n: int, seed: int) -> DataFrame:
    """The n rows that come first in the generator's order; every run with a seed takes the same. A top n, so each task keeps n rows."""
    return rows.orderBy(lcg_key(F.col(position), seed), position).limit(n)


def weight_head(spread: Column, head: Column) -> Column:
    """A pool's members by weight with the head repeated until it is as many as all others together; as it is without a head that serves, or others."""
    others = F.size(F.filter(spread, lambda m: m != head))
    more = F.greatest(others - (F.size(spread) - others), F.lit(0))
    return F.when(F.coalesce(F.array_contains(spread, head), F.lit(False)) & (others > 0), F.concat(spread, F.array_repeat(head, more))).otherwise(spread)


def nearest_ranks(rows: DataFrame, rank: str, of: int, k: int = 5) -> DataFrame:
    """The k rows whose rank is nearest, the better one first."""
    return rows.filter(F.col(rank) != of).orderBy(F.abs(F.col(rank) - of), rank).limit(k)


def adaptive_interval(per_day: Column, floor: int, ceiling: int) -> Column:
    """Minutes between visits: three for each new item a day, inside the bounds."""
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.round(F.lit(1440.0) / (3 * F.greatest(per_day, F.lit(0.01)))).cast("int")))


def share_of_backlog(claims: DataFrame, queue: list[str], order: list[str]) -> DataFrame:
    """Marks the claims of each queue that go to old work: turns OLD_TURNS of every ten, counted from 0."""
    turn = (F.row_number().over(Window.partitionBy(*queue).orderBy(*order)) - 1) % 10
    return claims.withColumn("old", turn.isin(*OLD_TURNS))


def pressure_states(samples: DataFrame, keys: list[str], time: str, hot: str, recovery_seconds: int = 30) -> DataFrame:
    """Whether pressure holds at each sample: from a hot sample until ``recovery_seconds`` have passed without one."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col(hot), F.unix_seconds(time))).over(w)
    return samples.withColumn("pressed", F.coalesce(F.unix_seconds(time) - last < recovery_seconds, F.lit(False)))
