"""Pool, retention and archive queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pool
from ..sources.tables import table
from .registry import query


@query("""WITH s AS (SELECT n_regionkey AS region, count(*) AS total, count(*) FILTER (s_acctbal < 0) AS failing, count(*) FILTER (s_acctbal > 9000) AS replaced FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT *, failing >= greatest(10, CAST(ceil(total * 0.1) AS BIGINT)) OR replaced >= 12 AS stopped FROM s""")
def outage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = s.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("s_acctbal") < 0).alias("failing"), F.count_if(F.col("s_acctbal") > 9000).alias("replaced"))
    return g.withColumn("stopped", pool.outage(F.col("failing"), F.col("total"), F.col("replaced")))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-09-01'), r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01')
    SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM a)) AS active, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM a) AND c_custkey IN (SELECT o_custkey FROM r)) AS resting, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM a) AND c_custkey NOT IN (SELECT o_custkey FROM r)) AS idle FROM customer""")
def pool_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return pool.pool_statistics(table(spark, sf_dir, "customer"), o.filter("o_orderdate > timestamp '2000-09-01'"), o.filter("o_orderdate > timestamp '1999-01-01'"), "c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY) OR (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY) OR o_orderstatus NOT IN ('P', 'F')""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.retained(table(spark, sf_dir, "orders"), "o_orderdate", datetime(2000, 1, 1), {"P": 30, "F": 365}, "o_orderstatus").select("o_orderkey")


@query("""WITH l AS (SELECT user_id, max(ROW(ts, event_type)) AS x FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id) SELECT user_id, x[2] AS event_type FROM l WHERE x[1] <= TIMESTAMP '2024-01-27' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 150)""")
def terminal_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("state", F.when((F.col("event_type") == "view") & (F.col("value") > 150), "live").otherwise(F.col("event_type")))
    return pool.terminal_jobs(e, "user_id", "ts", "state", ("live",), ("purchase", "signup"), F.lit(datetime(2024, 1, 27))).select("user_id", F.col("state").alias("event_type"))


@query("""SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m') AS "group", string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC) AS days, CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS INTEGER) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1""")
def archive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.archive_groups(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), "o_orderdate", "week").withColumn("days", F.array_join("days", ","))


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= 20""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 20, 7)


@query("""WITH RECURSIVE n AS (SELECT max(doc_id) AS top FROM documents), g(k, s) AS (SELECT CAST(0 AS BIGINT), (CAST(42 AS BIGINT) * 1664525 + 1013904223) % 4294967296 UNION ALL SELECT k + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g, n WHERE k < top)
    SELECT doc_id FROM documents JOIN g ON k = doc_id ORDER BY s, doc_id LIMIT 50""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that a seeded generator takes, row by row, without going through the rows one by one."""
    return pool.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 42)


@query("""WITH s AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS spread, CASE WHEN o_custkey % 3 <> 0 THEN '1-URGENT' END AS head FROM orders GROUP BY 1), c AS (SELECT *, len(list_filter(spread, lambda x: x <> head)) AS others FROM s)
    SELECT o_custkey, CASE WHEN head IS NOT NULL AND list_contains(spread, head) AND others > 0 THEN greatest(len(spread), 2 * others) ELSE len(spread) END AS members, len(list_filter(spread, lambda x: x = '1-URGENT')) + CASE WHEN head IS NOT NULL AND list_contains(spread, head) AND others > 0 THEN greatest(0, 2 * others - len(spread)) ELSE 0 END AS heads FROM c""")
def weighted_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools in which the head gets half of the turns at least."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("spread"))
    out = pool.weight_head(F.col("spread"), F.when(F.col("o_custkey") % 3 != 0, "1-URGENT"))
    s = s.withColumn("out", out)
    return s.select("o_custkey", F.size("out").cast("bigint").alias("members"), F.size(F.filter("out", lambda m: m == "1-URGENT")).cast("bigint").alias("heads"))


@query("""WITH r AS (SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_size = 7) SELECT p_partkey FROM r WHERE rank <> 10 ORDER BY abs(rank - 10), rank LIMIT 5""")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").filter("p_size = 7")
    ranked = p.withColumn("rank", F.rank().over(Window.partitionBy("p_size").orderBy(F.col("p_retailprice").desc(), "p_partkey")))
    return pool.nearest_ranks(ranked, "rank", 10).select("p_partkey")


@query("""WITH n AS (SELECT user_id, count(*) / 30.0 AS per_day FROM events GROUP BY user_id) SELECT user_id, greatest(10, least(1440, CAST(floor(1440.0 / (3 * greatest(per_day, 0.01)) + 0.5) AS INTEGER))) AS minutes FROM n""")
def adaptive_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count(F.lit(1)) / 30.0).alias("per_day"))
    return n.select("user_id", pool.adaptive_interval(F.col("per_day"), 10, 1440).alias("minutes"))


@query("""SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 10 IN (2, 5, 8) AS old FROM events""")
def backlog_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are the claims of a queue, in order of time."""
    return pool.share_of_backlog(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "old")


@query("""WITH l AS (SELECT event_id, user_id, floor(epoch(ts)) AS t, max(CASE WHEN value > 100 THEN floor(epoch(ts)) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM events) SELECT event_id, coalesce(t - last < 7200, false) AS pressed FROM l""")
def pressure_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("hot", F.col("value") > 100)
    return pool.pressure_states(e, ["user_id"], "ts", "hot", 7200).select("event_id", "pressed")


@query("""SELECT user_id % 10 AS service, count(DISTINCT user_id) FILTER (ts > c - INTERVAL 12 HOUR) AS recent, count(DISTINCT user_id) AS every FROM events, (SELECT max(ts) AS c FROM events) GROUP BY 1""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subjects of the last twelve hours and in all."""
    e = table(spark, sf_dir, "events")
    edge = e.agg(F.max(F.unix_micros("ts"))).first()[0] - 12 * 3_600_000_000
    return e.groupBy((F.col("user_id") % 10).alias("service")).agg(F.count_distinct(F.when(F.unix_micros("ts") > edge, F.col("user_id"))).alias("recent"), F.count_distinct("user_id").alias("every"))


@query("""WITH d AS (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1), u AS (SELECT k, unnest(ids) AS id FROM d) SELECT k, count(*) AS items, count(*) FILTER (id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS stale FROM u GROUP BY k""")
def stale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of stored documents whose current row has changed."""
    d = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list("c_custkey").alias("ids"))
    now = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.lit(True).alias("changed")).distinct()
    u = d.select("k", F.explode("ids").alias("id")).join(now, "id", "left")
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("items"), F.count("changed").alias("stale"))
