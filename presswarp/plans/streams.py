"""Streams over ``events``, run over all there is and compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..sources.tables import table
from ..streaming import derived, streams
from .registry import query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of every (hour, type): updates replace what earlier batches gave."""
    out = streams.run_available(streams.hourly_counts(event_stream(spark, sf_dir), "ts", ["event_type"]), _place(spark), "update")
    last = out.groupBy("w", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("""WITH r AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS revision FROM r""")
def stream_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.revisions(event_stream(spark, sf_dir), "user_id", "event_type", "event_id"), _place(spark))
    return out.select(F.col("key").alias("user_id"), F.col("content").alias("event_type"), "revision")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN event_type ELSE '' END AS want FROM events), c AS (SELECT *, lag(want, 1, '') OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM e)
    SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) FILTER (want <> '') AS upserts, count(*) FILTER (want = '') AS removes FROM c WHERE want <> was GROUP BY user_id""")
def stream_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).withColumn("live", F.col("event_type") != "signup")
    log = streams.run_available(streams.change_log(e, "user_id", "event_type", "live", "event_id"), _place(spark))
    return log.groupBy(F.col("key").alias("user_id")).agg(F.count_if(F.col("op") == "upsert").alias("upserts"), F.count_if(F.col("op") == "remove").alias("removes"))


@query("""WITH w AS (SELECT unnest(generate_series(date_trunc('day', ts) + INTERVAL 6 HOUR * CAST(floor(hour(ts) / 6) AS INTEGER) - INTERVAL 42 HOUR, date_trunc('day', ts) + INTERVAL 6 HOUR * CAST(floor(hour(ts) / 6) AS INTEGER), INTERVAL 6 HOUR)) AS start, event_type FROM events)
    SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days every six hours."""
    out = streams.run_available(streams.sliding_counts(event_stream(spark, sf_dir), "ts", ["event_type"]), _place(spark), "update")
    last = out.groupBy("w", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 6 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'view'""")
def stream_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and the views of their users that came at most six hours before."""
    from datetime import timedelta

    side = lambda kind, name: event_stream(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", F.col("ts").alias(f"{name}_at"), F.col("event_id").alias(name))
    joined = streams.waiting_join(side("purchase", "a"), side("view", "b"), "user_id", "a_at", "b_at", timedelta(hours=6))
    return streams.run_available(joined.select("a", "b"), _place(spark)).select("a", "b")


@query("""WITH n AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(CAST(round(value * 100) AS BIGINT), event_id) AS cents FROM events GROUP BY 1) SELECT event_type, count(*) AS users, CAST(sum(cents) AS BIGINT) AS cents FROM n WHERE event_type <> 'signup' GROUP BY 1""")
def derived_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their latest event, kept by signed deltas over seven batches that come out of order, compacted at the end."""
    place = _place(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_type") != "signup").alias("live"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    for part in (3, 0, 6, 1, 5, 2, 4):
        e.filter(F.pmod(F.floor(F.col("event_id") / 500), F.lit(7)) == part).coalesce(1).write.mode("append").parquet(f"{place}/in")
    schema = "event_id bigint, user_id bigint, event_type string, live boolean, cents bigint"
    facts = derived.DerivedSums(spark, f"{place}/facts", schema, "user_id", "event_id", "live", ["event_type"], ["cents"])
    derived.maintain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"), facts.apply, f"{place}/state")
    facts.compact()
    return facts.sums().withColumnRenamed("rows", "users")


@query("""SELECT c_custkey AS key, c_acctbal > 0 AND CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE n_regionkey END <> 2 AS ready, CASE WHEN c_custkey % 11 = 0 THEN 2 WHEN n_nationkey % 5 = 0 AND n_regionkey <> 2 THEN 1 ELSE 0 END AS batch FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 13 <> 0 OR c_custkey % 11 <> 0""")
def derived_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact of two tables: all keys come, then rows of the one table change, then keys come, go or change in what does not matter; each batch
    computes its own keys only."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    moved = n.withColumn("region", F.when(F.col("nation") % 5 == 0, 2).otherwise(F.col("region")))
    here = c.filter("key % 11 <> 0 or key % 13 <> 0")
    now = {"customers": here, "nations": n}
    text = lambda *names: F.create_map(*[x for k in names for x in (F.lit(k), F.col(k).cast("string"))])
    none = F.lit(None).cast("map<string,string>")

    def compute(keys: DataFrame) -> DataFrame:
        own = now["customers"].join(keys.select(F.col("key").cast("bigint").alias("key")), "key", "left_semi").join(now["nations"], "nation")
        return own.select("key", ((F.col("balance") > 0) & (F.col("region") != 2)).alias("fact"))

    watched = {"customers": derived.Watched("key", ["balance", "nation"]), "nations": derived.Watched("nation", ["region"], lambda: now["customers"].select(F.col("nation").alias("link"), "key"))}
    facts = derived.InvalidatedFacts(spark, f"{_place(spark)}/facts", "boolean", watched, compute)
    facts.apply(here.select(F.lit("customers").alias("table"), none.alias("before"), text("key", "balance", "nation").alias("after")), 0)
    now["nations"] = moved
    change = n.join(moved.withColumnRenamed("region", "then"), "nation")
    facts.apply(change.select(F.lit("nations").alias("table"), text("nation", "region").alias("before"), F.create_map(F.lit("nation"), F.col("nation").cast("string"), F.lit("region"), F.col("then").cast("string")).alias("after")), 1)
    gone = c.filter("key % 11 = 0").select(F.lit("customers").alias("table"), text("key", "balance", "nation").alias("before"), none.alias("after"))
    idle = here.filter("key % 11 <> 0").select(F.lit("customers").alias("table"), F.map_concat(text("key", "balance", "nation"), F.create_map(F.lit("name"), F.lit("a"))).alias("before"), F.map_concat(text("key", "balance", "nation"), F.create_map(F.lit("name"), F.lit("b"))).alias("after"))
    facts.apply(gone.unionByName(idle), 2)
    return facts.facts().select(F.col("key").cast("bigint").alias("key"), F.col("fact").alias("ready"), "batch")
