"""Heat over ``events``: story = props.k, participant = user, source = user modulo 40."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import heat
from ..sources.tables import table
from .registry import query

EDITORIAL = ("view", "click", "purchase")
SIGNALS = "sig AS (SELECT event_id AS signal, CAST(json_extract_string(props, '$.k') AS BIGINT) AS story, user_id AS participant, user_id % 40 AS source, event_type IN ('view', 'click', 'purchase') AS editorial, ts AS observed_at FROM events), clock AS (SELECT max(ts) AS clk FROM events)"
LATE = "late AS (SELECT source, last_ok IS NULL OR floor(epoch(clk)) - floor(epoch(last_ok)) > 10800 AS behind FROM (SELECT source, max(observed_at) AS last_ok FROM sig GROUP BY source), clock)"
PARTICIPANTS = """part AS (
    SELECT story, participant,
           max(observed_at) FILTER (observed_at > clk - INTERVAL 48 HOUR) AS last_at,
           min(observed_at) FILTER (observed_at > clk - INTERVAL 48 HOUR) AS first_at,
           coalesce(bool_or(editorial) FILTER (observed_at > clk - INTERVAL 48 HOUR), false) AS editorial,
           coalesce(bool_or(behind) FILTER (observed_at > clk - INTERVAL 48 HOUR), false) AS behind,
           max(observed_at) FILTER (observed_at <= clk - INTERVAL 6 HOUR) AS last_prev
    FROM sig JOIN late USING (source), clock
    WHERE observed_at > clk - INTERVAL 54 HOUR AND observed_at <= clk GROUP BY story, participant)"""
HEAT = """agg AS (
    SELECT story, count(last_at) AS participants, count(*) FILTER (last_at IS NOT NULL AND editorial) AS editorial,
           count(*) FILTER (last_at IS NOT NULL AND behind) AS behind, count(*) FILTER (first_at > clk - INTERVAL 6 HOUR) AS recent,
           coalesce(sum(pow(0.5, (epoch_us(clk) - epoch_us(last_at)) / 3.6e9 / 24)), 0) AS heat,
           coalesce(sum(pow(0.5, (epoch_us(clk - INTERVAL 6 HOUR) - epoch_us(last_prev)) / 3.6e9 / 24)), 0) AS heat_prev,
           coalesce(sum(pow(0.5, (epoch_us(clk) - epoch_us(last_at)) / 3.6e9 / 24)) FILTER (NOT behind), 0) AS heat_seen,
           coalesce(sum(pow(0.5, (epoch_us(clk - INTERVAL 6 HOUR) - epoch_us(last_prev)) / 3.6e9 / 24)) FILTER (NOT behind AND last_at IS NOT NULL), 0) AS heat_prev_seen,
           max(last_at) AS latest_at, min(first_at) AS first_at
    FROM part, clock GROUP BY story HAVING count(last_at) > 0)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("signal"), F.get_json_object("props", "$.k").cast("bigint").alias("story"), F.col("user_id").alias("participant"),
        (F.col("user_id") % 40).alias("source"), F.col("event_type").isin(*EDITORIAL).alias("editorial"), F.col("ts").alias("observed_at"),
    )


def clock(signals_: DataFrame):
    return signals_.agg(F.max("observed_at")).first()[0]


def late_sources(sig: DataFrame, at) -> DataFrame:
    return heat.behind(sig.groupBy("source").agg(F.max("observed_at").alias("last_ok")).withColumn("interval_minutes", F.lit(60)), at)


@query(f"""WITH {SIGNALS}, {LATE}, {PARTICIPANTS}, {HEAT},
    top AS (SELECT *, row_number() OVER (ORDER BY heat DESC, latest_at DESC, story) AS rank FROM agg WHERE participants >= 2 AND editorial >= 1 QUALIFY rank <= 10),
    t AS (SELECT *, CASE WHEN (CASE WHEN behind > 0 THEN heat_prev_seen ELSE heat_prev END) > 0
                    THEN ((CASE WHEN behind > 0 THEN heat_seen ELSE heat END) - (CASE WHEN behind > 0 THEN heat_prev_seen ELSE heat_prev END)) / (CASE WHEN behind > 0 THEN heat_prev_seen ELSE heat_prev END) END AS pct FROM top)
    SELECT rank, story, participants, editorial, recent, round(heat * 100) / 10 AS shown, round(1000 * pct) / 10 AS trend_pct,
           CASE WHEN heat_prev <= 0 THEN 'new' WHEN pct IS NULL THEN 'unknown' WHEN pct > 0.1 THEN 'up' WHEN pct < -0.1 THEN 'down' ELSE 'flat' END AS trend,
           CASE WHEN recent >= 3 AND recent * 2 >= participants THEN 'surge' WHEN (epoch_us(clk) - epoch_us(first_at)) / 3.6e9 < 6 THEN 'new' WHEN pct > 0.15 THEN 'rising' END AS badge
    FROM t, clock""")
def heat_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = signals(spark, sf_dir)
    at = clock(sig)
    board = heat.hot_board(sig, at, late_sources(sig, at))
    return board.select(F.col("rank").cast("bigint").alias("rank"), "story", "participants", "editorial", "recent", "shown", (F.round(F.col("pct") * 1000) / 10).alias("trend_pct"), "trend", "badge")


@query(f"""WITH {SIGNALS}, {LATE}, {PARTICIPANTS}, {HEAT}
    SELECT story, participants, behind, round(heat, 6) AS heat, round(heat_prev, 6) AS heat_prev, round(heat_seen, 6) AS heat_seen, round(heat_prev_seen, 6) AS heat_prev_seen FROM agg""")
def heat_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = signals(spark, sf_dir)
    at = clock(sig)
    found = heat.story_heat(sig, at, late_sources(sig, at))
    return found.select("story", "participants", "behind", *[F.round(c, 6).alias(c) for c in ("heat", "heat_prev", "heat_seen", "heat_prev_seen")])


HOURLY = """hours AS (SELECT unnest(generate_series(date_trunc('hour', clk) - INTERVAL 47 HOUR, date_trunc('hour', clk), INTERVAL 1 HOUR)) AS hour FROM clock),
    lastp AS (SELECT story, participant, hour, max(observed_at) AS seen FROM sig JOIN hours ON observed_at <= hour AND observed_at > hour - INTERVAL 48 HOUR GROUP BY ALL),
    hourly AS (SELECT story, hour, sum(pow(0.5, (epoch_us(hour) - epoch_us(seen)) / 3.6e9 / 24)) AS heat FROM lastp GROUP BY story, hour)"""


@query(f"WITH {SIGNALS}, {HOURLY} SELECT story, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(heat, 6) AS heat FROM hourly")
def heat_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = signals(spark, sf_dir)
    stop = clock(sig).replace(minute=0, second=0, microsecond=0)
    found = heat.hourly(sig, stop - timedelta(hours=47), stop)
    return found.select("story", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), F.round("heat", 6).alias("heat"))


@query(f"""WITH {SIGNALS}, {HOURLY}, slots AS (SELECT unnest(range(25)) AS k), stories AS (SELECT DISTINCT story FROM hourly, clock WHERE hour >= date_trunc('hour', clk) - INTERVAL 24 HOUR)
    SELECT s.story, string_agg(coalesce(CAST(CAST(round(heat * 100) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY k) AS line
    FROM stories s CROSS JOIN slots CROSS JOIN clock LEFT JOIN hourly h ON h.story = s.story AND h.hour = date_trunc('hour', clk) - INTERVAL 24 HOUR + k * INTERVAL 1 HOUR GROUP BY s.story""")
def heat_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = signals(spark, sf_dir)
    stop = clock(sig).replace(minute=0, second=0, microsecond=0)
    lines = heat.sparkline(heat.hourly(sig, stop - timedelta(hours=24), stop), stop)
    return lines.select("story", F.array_join(F.transform("values", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",", "-").alias("line"))


@query(f"WITH {SIGNALS} SELECT story, participant, signal, editorial FROM sig QUALIFY row_number() OVER (PARTITION BY story, participant ORDER BY editorial DESC, observed_at DESC, signal DESC) = 1")
def participant_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.latest_of_each(signals(spark, sf_dir)).select("story", "participant", "signal", "editorial")


@query(f"WITH {SIGNALS}, {LATE} SELECT source, behind FROM late")
def behind_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = signals(spark, sf_dir)
    return late_sources(sig, clock(sig)).select("source", "behind")


@query(f"""WITH {SIGNALS}, {HOURLY}, b AS (SELECT hour, story, heat, row_number() OVER (PARTITION BY hour ORDER BY heat DESC, story) AS rank FROM hourly)
    SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, story, rank FROM b WHERE rank <= 10 QUALIFY hour = max(hour) OVER ()""")
def newest_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hour's board that is not empty."""
    sig = signals(spark, sf_dir)
    stop = clock(sig).replace(minute=0, second=0, microsecond=0)
    found = heat.hourly(sig, stop - timedelta(hours=47), stop)
    newest = found.agg(F.max("hour").alias("hour"))
    rank = F.row_number().over(Window.partitionBy("hour").orderBy(F.col("heat").desc(), "story"))
    top = found.join(F.broadcast(newest), "hour").withColumn("rank", rank.cast("bigint")).filter("rank <= 10")  # newest is one row
    return top.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "story", "rank")
