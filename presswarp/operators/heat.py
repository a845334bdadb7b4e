"""Decayed attention: how much distinct participants signal a story, now and six hours before.

signals: (story, participant, source, editorial boolean, observed_at). Everything is relative to an explicit clock ``at``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = timedelta(hours=48)
HALF_LIFE_HOURS = 24.0
TREND_BACK = timedelta(hours=6)
MIN_PARTICIPANTS, MIN_EDITORIAL, BOARD = 2, 1, 10


def hours_before(at: datetime | Column, moment: Column) -> Column:
    clock = at if isinstance(at, Column) else F.lit(at)
    return (F.unix_micros(clock.cast("timestamp")) - F.unix_micros(moment)) / 3.6e9


def decay(at: datetime | Column, moment: Column) -> Column:
    return F.pow(F.lit(0.5), hours_before(at, moment) / HALF_LIFE_HOURS)


def behind(clocks: DataFrame, at: datetime) -> DataFrame:
    """clocks: (source, last_ok, interval_minutes). Adds whether a source is late: never seen, or for over three of its
    intervals (90 minutes at least)."""
    allowed = F.greatest(F.col("interval_minutes") * 3, F.lit(90)) * 60
    late = F.col("last_ok").isNull() | (F.unix_seconds(F.lit(at).cast("timestamp")) - F.unix_seconds("last_ok") > allowed)
    return clocks.withColumn("behind", late)


def participants(signals: DataFrame, at: datetime, late: DataFrame | None = None) -> DataFrame:
    """One row for each (story, participant), from one pass over 54 hours: both windows are conditional aggregates."""
    prev = at - TREND_BACK
    seen = signals.filter((F.col("observed_at") > F.lit(prev - WINDOW)) & (F.col("observed_at") <= F.lit(at)))
    if late is not None:
        seen = seen.join(late.filter("behind").select("source", F.lit(True).alias("__late")), "source", "left")
    else:
        seen = seen.withColumn("__late", F.lit(None).cast("boolean"))
    now = F.col("observed_at") > F.lit(at - WINDOW)
    before = F.col("observed_at") <= F.lit(prev)
    return seen.groupBy("story", "participant").agg(
        F.max(F.when(now, F.col("observed_at"))).alias("last_at"),
        F.min(F.when(now, F.col("observed_at"))).alias("first_at"),
        F.coalesce(F.bool_or(F.when(now, F.col("editorial"))), F.lit(False)).alias("editorial"),
        F.coalesce(F.bool_or(F.when(now, F.col("__late"))), F.lit(False)).alias("behind"),
        F.max(F.when(before, F.col("observed_at"))).alias("last_prev"),
    )


def story_heat(signals: DataFrame, at: datetime, late: DataFrame | None = None) -> DataFrame:
    """Stories with a participant in the window now."""
    prev = at - TREND_BACK
    p = participants(signals, at, late)
    here, seen = F.col("last_at").isNotNull(), ~F.col("behind")
    now, then = decay(at, F.col("last_at")), decay(prev, F.col("last_prev"))
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))
    out = p.groupBy("story").agg(
        F.count(F.when(here, 1)).alias("participants"),
        F.count(F.when(here & F.col("editorial"), 1)).alias("editorial"),
        F.count(F.when(here & F.col("behind"), 1)).alias("behind"),
        F.count(F.when(F.col("first_at") > F.lit(prev), 1)).alias("recent"),
        total(here, now).alias("heat"),
        total(F.col("last_prev").isNotNull(), then).alias("heat_prev"),
        total(here & seen, now).alias("heat_seen"),
        total(here & seen & F.col("last_prev").isNotNull(), then).alias("heat_prev_seen"),
        F.max("last_at").alias("latest_at"),
        F.min("first_at").alias("first_at"),
    )
    return out.filter("participants > 0")


def trend(board: DataFrame, at: datetime) -> DataFrame:
    """Adds pct, trend and badge. Observed values count where a participant's source is late."""
    some = F.col("behind") > 0
    cur, prev = F.when(some, F.col("heat_seen")).otherwise(F.col("heat")), F.when(some, F.col("heat_prev_seen")).otherwise(F.col("heat_prev"))
    pct = F.when(prev > 0, (cur - prev) / prev)
    surge = (F.col("recent") >= 3) & (F.col("recent") * 2 >= F.col("participants"))
    direction = F.when(F.col("heat_prev") <= 0, "new").when(F.col("pct").isNull(), "unknown").when(F.col("pct") > 0.1, "up").when(F.col("pct") < -0.1, "down").otherwise("flat")
    badge = F.when(surge, "surge").when(hours_before(at, F.col("first_at")) < 6, "new").when(F.col("pct") > 0.15, "rising")
    return board.withColumn("pct", pct).withColumns({"trend": direction, "badge": badge})


def hot_board(signals: DataFrame, at: datetime, late: DataFrame | None = None, size: int = BOARD, readable: DataFrame | None = None) -> DataFrame:
    """The hottest stories, ranked; readable: the stories (story) with a report that readers may see, others are passed over."""
    ranked = story_heat(signals, at, late).filter((F.col("participants") >= MIN_PARTICIPANTS) & (F.col("editorial") >= MIN_EDITORIAL))
    if readable is not None:
        ranked = ranked.join(readable.select("story").distinct(), "story", "left_semi")
    order = [F.col("heat").desc(), F.col("latest_at").desc_nulls_last(), F.col("story").asc()]
    top = trend(ranked.orderBy(*order).limit(size), at)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("shown", F.round(F.col("heat") * 100) / 10)


def hourly(signals: DataFrame, start: datetime, stop: datetime, late: DataFrame | None = None) -> DataFrame:
    """(story, hour, heat, complete) at every full hour of [start, stop] at which a story has heat.

    A participant's heat at an hour comes from its last signal in the 48 hours before. Signals are reduced to the last of
    each (story, participant, hour), which then counts for the hours up to the next one: no signal meets all 48 hours alone.
    """
    own = signals.filter((F.col("observed_at") > F.lit(start - WINDOW)) & (F.col("observed_at") <= F.lit(stop)))
    at = F.timestamp_seconds(F.ceil(F.unix_micros("observed_at") / 3.6e9) * 3600)
    last = own.groupBy("story", "participant", at.alias("first_hour")).agg(F.max("observed_at").alias("seen"), F.max("source").alias("source"))
    following = F.lead("first_hour").over(Window.partitionBy("story", "participant").orderBy("first_hour"))
    until = F.least(F.timestamp_micros(F.unix_micros("seen") + int(WINDOW.total_seconds() * 1e6) - 1), F.lit(stop).cast("timestamp"))
    last = last.withColumn("until", F.least(until, F.coalesce(F.timestamp_micros(F.unix_micros(following) - 1), until)))
    first = F.greatest("first_hour", F.lit(start).cast("timestamp"))
    spread = last.withColumn("first", first).filter("first <= until").withColumn("hour", F.explode(F.expr("sequence(first, until, interval 1 hour)")))
    if late is not None:
        spread = spread.join(late.filter("behind").select("source", F.lit(True).alias("__late")), "source", "left")
    else:
        spread = spread.withColumn("__late", F.lit(None).cast("boolean"))
    return spread.groupBy("story", "hour").agg(F.sum(decay(F.col("hour"), F.col("seen"))).alias("heat"), (~F.coalesce(F.bool_or("__late"), F.lit(False))).alias("complete"))


def sparkline(heat: DataFrame, stop: datetime, slots: int = 25) -> DataFrame:
    """(story, values): the last hours in order, null where there is none."""
    first = F.lit(stop - timedelta(hours=slots - 1)).cast("timestamp")
    inside = heat.filter((F.col("hour") >= first) & (F.col("hour") <= F.lit(stop)))
    slot = ((F.unix_seconds("hour") - F.unix_seconds(first)) / 3600).cast("int")
    each = inside.groupBy("story").agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("k"), F.col("heat").alias("v")))).alias("m"))
    return each.select("story", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.try_element_at("m", k)).alias("values"))


def latest_of_each(signals: DataFrame) -> DataFrame:
    """Each (story, participant)'s signal to show: editorial before others, then the latest."""
    order = Window.partitionBy("story", "participant").orderBy(F.col("editorial").desc(), F.col("observed_at").desc(), F.col("signal").desc())
    return signals.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
