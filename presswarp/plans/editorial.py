"""Selection and readiness over ``orders``, ``customer`` and ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editorial
from ..sources.tables import table
from .registry import query


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tier = F.element_at(F.array(F.lit("T1"), F.lit("T1_5"), F.lit("T2"), F.lit("EXCLUDE")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") != "P").alias("passes"), (F.col("o_orderkey") % 100).alias("first"), (F.col("o_custkey") % 97).alias("second"), tier.alias("tier"), (F.col("o_totalprice") > 250000).alias("selected"), F.col("o_orderdate").alias("at"))


SCORED = """s AS (SELECT o_orderkey AS id, o_orderpriority AS source, o_orderstatus <> 'P' AS passes, o_orderkey % 100 AS first, o_custkey % 97 AS second, CASE o_custkey % 4 WHEN 0 THEN 46 WHEN 1 THEN 49 WHEN 2 THEN 52 END AS bar, o_totalprice > 250000 AS stored, o_orderdate AS moment FROM orders),
    t AS (SELECT *, coalesce(passes AND first + second >= 2 * bar, false) AS selected FROM s)"""


@query(f"WITH {SCORED} SELECT id, selected, (first + second) // 2 AS shown, coalesce(first + second >= 2 * bar OR first + second > 72, false) AS rich FROM t")
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, t = F.col("first"), F.col("second"), F.col("tier")
    return scored(spark, sf_dir).select("id", editorial.selected(F.col("passes"), f, s, t).alias("selected"), editorial.shown_score(f, s).alias("shown"), editorial.rich(f, s, t).alias("rich"))


@query(f"WITH {SCORED} SELECT source, count(*) FILTER (selected) AS gained, count(*) FILTER (NOT selected) AS lost FROM t WHERE selected IS DISTINCT FROM stored GROUP BY source")
def reselection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.reselected(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, v AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE moment + INTERVAL 1 DAY END AS visible FROM t), r AS (SELECT *, NOT selected OR visible <= TIMESTAMP '1999-06-01' AS released FROM v)
    SELECT id, released, CASE WHEN id % 7 <> 0 AND passes AND released THEN 'public' WHEN id % 7 <> 0 AND passes THEN 'summary-only' ELSE 'unavailable' END AS availability FROM r""")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("picked", editorial.selected(F.col("passes"), F.col("first"), F.col("second"), F.col("tier")))
    visible = F.when(F.col("id") % 3 != 0, F.timestamp_seconds(F.unix_seconds("at") + 86400))
    s = s.withColumn("released", editorial.released(F.col("picked"), visible, F.lit(datetime(1999, 6, 1))))
    return s.select("id", "released", editorial.availability(F.when(F.col("id") % 7 != 0, "public"), F.col("passes"), F.col("released")).alias("availability"))


@query(f"""WITH {SCORED}, p AS (SELECT DISTINCT id % 500 AS k FROM t WHERE NOT selected AND passes) SELECT id FROM t WHERE selected AND EXISTS (SELECT 1 FROM p WHERE p.k = id % 500)""")
def ready_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("picked", editorial.selected(F.col("passes"), F.col("first"), F.col("second"), F.col("tier"))).withColumns({"article": F.col("id") % 500, "revision": F.lit(1), "analysis": F.lit(1)})
    return editorial.ready(s.filter("picked"), s.filter("not picked and passes")).select("id")


@query("""WITH a AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 = 0), f AS (SELECT o_custkey AS key, max(o_totalprice) AS detail FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
    SELECT coalesce(a.key, f.key) AS key, CASE WHEN a.key IS NULL THEN 'open' WHEN f.key IS NULL THEN 'recover' WHEN a.key % 10 = 0 THEN 'repeat' ELSE 'quiet' END AS action FROM a FULL JOIN f ON a.key = f.key""")
def alert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(datetime(2000, 1, 2)).cast("timestamp")
    told = F.when(F.col("c_custkey") % 10 == 0, F.lit(datetime(2000, 1, 1)).cast("timestamp")).otherwise(now)
    a = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"), told.alias("told"))
    f = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("detail"))
    return editorial.alert_changes(a, f, now).select("key", "action")


@query("""WITH c AS (SELECT user_id AS worker, floor(epoch(ts)) AS t, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) <> event_type THEN 1 ELSE 0 END AS c FROM events),
    n AS (SELECT worker, sum(c) OVER (PARTITION BY worker ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM c) SELECT worker, CAST(max(n) AS BIGINT) AS changes FROM n GROUP BY worker HAVING max(n) >= 6""")
def boot_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").alias("at"), F.col("event_type").alias("started"))
    return editorial.boot_loops(e, 24 * 60, 6)
