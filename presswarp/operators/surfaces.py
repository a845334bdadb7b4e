"""Rows that boards, pools and readers show: trust, capacity, refusals, routing, faces, records in JSON."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACES = 40
LEAST_CALLS, LEAST_MS, LEAST_ACCEPTED, MOST_WEIGHT = 6, 1000, 0.8, 4  # fixed values


def trusted(members: DataFrame, manual: Column, pending: DataFrame, key: str) -> DataFrame:
    """Members set by hand, and those that no regrouping waits for."""
    waits = pending.select(F.col(key)).distinct().withColumn("waits", F.lit(True))
    return members.join(waits, key, "left").filter(manual | F.col("waits").isNull()).drop("waits")


def over_capacity(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """Rows beyond the first ``cap`` in the order. Rows are counted by their values, those among the first are taken off, and what is left is
    given out again, so of equal rows as many are beyond as there are."""
    names = rows.columns
    kept = rows.orderBy(*order).limit(cap).groupBy(*[F.col(c).alias(f"kept_{c}") for c in names]).agg(F.count(F.lit(1)).alias("kept_rows"))
    every = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("all_rows"))
    left = F.col("all_rows") - F.coalesce("kept_rows", F.lit(0))
    beyond = every.join(kept, [F.col(c).eqNullSafe(F.col(f"kept_{c}")) for c in names], "left").withColumn("left_rows", left).filter("left_rows > 0")
    return beyond.select(*names, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("left_rows")))).select(*names)


def newest_refusals(calls: DataFrame, keys: list[str], time: str, id_: str, declared: Column, connect: Column, now: datetime, declared_seconds: int = 3600, connect_seconds: int = 120, newest: int = 6, hours: int = 6) -> DataFrame:
    """Members to bench by their ``newest`` calls of the last hours: the newest one was refused for a declared reason and is
    recent, or the newest two both failed to connect and are very recent."""
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(id_).desc())
    near = calls.filter((F.col(time) <= F.lit(now)) & (F.col(time) > F.lit(now - timedelta(hours=hours))))
    ranked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= newest)
    two = F.col("place") <= 2
    since = lambda s: F.max(time) > F.lit(now - timedelta(seconds=s))
    both = (F.count_if(two) == 2) & (F.count_if(two & connect) == 2) & since(connect_seconds)
    found = ranked.groupBy(*keys).agg(both.alias("connect_failed"), ((F.count_if((F.col("place") == 1) & declared) == 1) & since(declared_seconds)).alias("declared"))
    return found.filter("connect_failed or declared").drop("declared")


def routing_weights(samples: DataFrame, purpose: str) -> DataFrame:
    """samples: (purpose, total, accepted, median_ms, pending). Adds ``weight`` from 1 to 4: speed against the fastest measured
    member of the purpose, by the square of what is accepted, by what waits. Without two measured members all weigh 1."""
    share = F.col("accepted") / F.col("total")
    measured = F.coalesce((F.col("accepted") >= LEAST_CALLS) & (F.col("median_ms") >= LEAST_MS) & (share >= LEAST_ACCEPTED), F.lit(False))
    w = Window.partitionBy(purpose)
    fastest, n = F.min(F.when(measured, F.col("median_ms"))).over(w), F.count_if(measured).over(w)
    raw = F.lit(4) * fastest / F.greatest(F.lit(LEAST_MS), "median_ms") * share * share / (1 + F.col("pending"))
    weight = F.greatest(F.lit(1), F.least(F.lit(MOST_WEIGHT), F.floor(raw + 0.5)))
    return samples.withColumn("weight", F.when(measured & (n >= 2), weight).otherwise(1).cast("int"))


def faces(participants: DataFrame, story: str, name: str, editorial: str, tier: str, at: str, most: int = FACES) -> DataFrame:
    """(story, faces): the first ``most`` participants: editorial ones, then by tier, then the most recently active."""
    order = Window.partitionBy(story).orderBy(F.col(editorial).desc(), F.col(tier), F.col(at).desc(), F.col(name))
    few = participants.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    each = few.groupBy(story).agg(F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("name")))).alias("f"))
    return each.select(story, F.transform("f", lambda x: x["name"]).alias("faces"))


def plausible(counts: DataFrame, keys: list[str], time: str, n: str) -> DataFrame:
    """Adds why a fetch is held back: no rows, or under half of those of the fetch before it; null where it is not."""
    last = F.lag(n).over(Window.partitionBy(*keys).orderBy(time))
    return counts.withColumn("held", F.when(F.col(n) == 0, "no rows").when(F.col(n) < last / 2, F.concat(F.lit("only "), F.col(n).cast("string"), F.lit(" of "), last.cast("string"))))


def earliest_same(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """Adds ``first``: the least id among the rows of the same key; rows without a key have none."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias("first"))
    return rows.join(first, key, "left")


def as_json(rows: DataFrame, group: str, fields: dict[str, Column], name: str = "payload") -> DataFrame:
    """(group, payload): a group's rows as one JSON array of objects, in the order of the fields."""
    each = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(k) for k, c in fields.items()]))).alias("x"))
    return each.select(group, F.to_json("x").alias(name))


def recordset(rows: DataFrame, payload: str, keep: list[str], schema: str) -> DataFrame:
    """The objects of a JSON array as rows; what is no array gives none."""
    return rows.select(*keep, F.inline(F.from_json(payload, f"array<struct<{schema}>>")))
