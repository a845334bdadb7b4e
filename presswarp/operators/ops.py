"""Operational analytics: usage by ranges and grouping sets, latency percentiles, budgets, health, as-of prices."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = ((1, 1), (2, 7), (4, 30), (8, 90))  # bit, days
UNITS_PER_PRICE = 1_000_000


def range_mask(at: datetime, moment: Column) -> Column:
    """Bits of the ranges (days back from the end of the clock's day) that the moment is in."""
    age = F.date_diff(F.to_date(F.lit(at)), F.to_date(moment))
    mask = F.lit(0)
    for bit, days in RANGES:
        mask = mask.bitwiseOR(F.when((age >= 0) & (age < days), F.lit(bit)).otherwise(F.lit(0)))
    return mask


def usage_by_ranges(calls: DataFrame, at: datetime, keys: list[str]) -> DataFrame:
    """calls: (keys, at, value). One scan: first by keys and mask, then each of the few sums goes to the ranges of its mask."""
    partial = calls.groupBy(*keys, range_mask(at, F.col("at")).alias("mask")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value"))
    days = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(d).alias("days")) for b, d in RANGES])
    each = partial.withColumn("r", F.explode(F.filter(days, lambda x: F.col("mask").bitwiseAND(x["bit"]) > 0)))
    return each.groupBy(*keys, F.col("r.days").alias("days")).agg(F.sum("calls").alias("calls"), F.sum("value").alias("value"))


def grouping_labels(keys: list[str]) -> list[Column]:
    """Names of keys that are summed over read 'all'."""
    return [F.when(F.grouping(k) == 1, "all").otherwise(F.col(k).cast("string")).alias(k) for k in keys]


def latency_percentiles(calls: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Discrete percentiles (the least value with that share of the values at or below it) and the median. Equal values are counted
    before the shuffle, and a key's counts are summed in a sort that can spill, so no task holds a key's values."""
    each = calls.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("rows")).withColumn("known", F.when(F.col(value).isNotNull(), F.col("rows")).otherwise(0))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("upto", F.sum("known").over(upto)).withColumn("total", F.sum("known").over(whole))
    least = lambda at: F.min(F.when(F.col("upto") >= at, F.col(value)))
    cols = [least(F.ceil(F.col("total") * p)).alias(f"p{round(p * 100)}") for p in shares]
    median = (least(F.floor((F.col("total") - 1) / 2) + 1) + least(F.ceil((F.col("total") - 1) / 2) + 1)) / 2
    return each.groupBy(*keys).agg(*cols, median.alias("median"), F.sum("rows").alias("n"))


def budgets(calls: DataFrame, at: datetime, limits: dict[str, int]) -> DataFrame:
    """calls: (service, at, billed). Counts of the last minute (all calls), hour and day (billed ones), and what is exceeded."""
    recent = calls.filter((F.col("at") > F.lit(at - timedelta(days=1))) & (F.col("at") <= F.lit(at)))
    out = recent.groupBy("service").agg(
        F.count_if(F.col("at") > F.lit(at - timedelta(minutes=1))).alias("minute"),
        F.count_if((F.col("at") > F.lit(at - timedelta(hours=1))) & F.col("billed")).alias("hour"),
        F.count_if(F.col("billed")).alias("day"),
    )
    reason = F.when(F.lit(min(limits.values()) <= 0), "stopped")
    for name in ("minute", "hour", "day"):
        reason = reason.when(F.col(name) >= limits[name], name)
    wait = {"minute": 60, "hour": 600, "day": 3600}
    out = out.withColumn("reason", reason)
    return out.withColumn("wait_seconds", F.create_map(*[F.lit(x) for p in wait.items() for x in p])[F.col("reason")])


def newest(calls: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    """The newest k rows of each key, numbered."""
    return calls.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def benched(calls: DataFrame, at: datetime) -> DataFrame:
    """calls: (service, model, at, id, refused, failed). Benched: the newest is a refusal within an hour, or the newest two are
    connection failures within two minutes."""
    two = newest(calls, ["service", "model"], 2, [F.col("at").desc(), F.col("id").desc()])
    age = F.unix_seconds(F.lit(at).cast("timestamp")) - F.unix_seconds("at")
    return two.groupBy("service", "model").agg(
        F.bool_or((F.col("place") == 1) & F.col("refused") & (age <= 3600)).alias("by_refusal"),
        (F.count_if(F.col("failed") & (age <= 120)) == 2).alias("by_failures"),
    )


def mask_numbers(text: Column) -> Column:
    """Messages without their digits and hexadecimal ids."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9a-f]{8,}", "#"), "[0-9]+", "#")


def error_groups(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(message, n, example): the example is the row with the largest key."""
    return rows.groupBy(mask_numbers(F.col(text)).alias("message")).agg(F.count(F.lit(1)).alias("n"), F.max_by(text, key).alias("example"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, carried: list[str]) -> DataFrame:
    """Adds the latest right row at or before each left row, by key; nulls where there is none.

    Both sides are put in one order by time and the last right row is carried forward: one shuffle by key and a sort, however
    many versions a key has, and no row meets more than one other. Where a key has several right rows of one time, the
    largest counts.
    """
    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*carried)).dtypes[0][1]).alias("__carry"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*carried).alias("__carry"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__carry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__found", F.last("__carry", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(*left.columns, *[F.col(f"__found.{c}").alias(c) for c in carried])


def token_cost(calls: DataFrame, peak: Column | None = None) -> Column:
    """Price of (tokens_in, cached, unknown_cache, tokens_out) at (price_in, price_cached, price_out) for a million."""
    cached_price = F.coalesce("price_cached", "price_in")
    missed = F.greatest(F.lit(0), F.col("tokens_in") - F.col("cached") - F.col("unknown_cache"))
    cost = missed * F.col("price_in") + (F.col("cached") + F.col("unknown_cache")) * cached_price + F.col("tokens_out") * F.col("price_out")
    return cost * (peak if peak is not None else F.lit(1.0)) / UNITS_PER_PRICE


def peak_factor(moment: Column, holidays: list[str] = ()) -> Column:
    """Twice on weekdays from 9 to 12 and 14 to 18 o'clock, eight hours ahead of UTC; once on holidays and else."""
    local = F.timestamp_seconds(F.unix_seconds(moment) + 8 * 3600)
    hour, day = F.hour(local), F.dayofweek(local)
    busy = day.between(2, 6) & (((hour >= 9) & (hour < 12)) | ((hour >= 14) & (hour < 18)))
    if holidays:
        busy = busy & ~F.date_format(local, "yyyy-MM-dd").isin(*holidays)
    return F.when(busy, 2.0).otherwise(1.0)


def change_runs(states: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """Stretches of the same state: (keys, state, n, run)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = states.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run", state).agg(F.count(F.lit(1)).alias("n"))
