"""Joins, set operations, ranking and paging over the relational tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.tables import table
from .registry import query


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 350000""")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    dear = o.filter("o_totalprice > 350000")
    return dear.join(c, dear.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("""SELECT c_custkey, count(o_orderkey) AS orders, max(o_totalprice) AS dearest FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice >= c_acctbal GROUP BY c_custkey""")
def join_left_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice >= c.c_acctbal), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("dearest"))


@query("""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, p_name FROM k JOIN part ON p_partkey = k""")
def join_computed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("p_partkey"))
    return e.join(table(spark, sf_dir, "part"), "p_partkey").select("event_id", "p_name")


@query("""SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
    UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def semi_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    count = lambda how: c.join(o, c.c_custkey == o.o_custkey, how).agg(F.lit(how.removeprefix("left_")).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("left_semi").unionByName(count("left_anti"))


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150""")
def null_safe_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    buyers = e.filter("event_type = 'purchase' and value > 150").select("user_id").distinct().withColumnRenamed("user_id", "u")
    return e.filter("event_type = 'view'").select("user_id").distinct().join(buyers, F.col("user_id").eqNullSafe(F.col("u")), "left_anti")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "x.o_orderkey", "x.o_totalprice")


@query("""SELECT c_custkey, count(*) FILTER (o_orderdate > TIMESTAMP '2000-06-01') AS recent, count(o_orderkey) AS every FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderdate") > F.expr("timestamp '2000-06-01'")).alias("recent"), F.count(F.lit(1)).alias("every"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["recent", "every"])


@query("""WITH p AS (SELECT o_custkey % 20 AS service, o_shippriority AS model, max(o_totalprice) AS price FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE '' END AS o_shippriority FROM orders) WHERE o_custkey % 20 < 15 GROUP BY 1, 2)
    SELECT DISTINCT s.s_suppkey, coalesce(a.price, b.price) AS price FROM supplier s LEFT JOIN p a ON a.service = s.s_suppkey % 20 AND a.model = CASE WHEN s.s_nationkey < 12 THEN 'P' ELSE 'Q' END LEFT JOIN p b ON b.service = s.s_suppkey % 20 AND b.model = ''""")
def join_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By (service, model), else by the service alone."""
    o = table(spark, sf_dir, "orders").withColumn("model", F.when(F.col("o_orderstatus") == "P", "P").otherwise(""))
    p = o.withColumn("service", F.col("o_custkey") % 20).filter("service < 15").groupBy("service", "model").agg(F.max("o_totalprice").alias("price"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20).alias("service"), F.when(F.col("s_nationkey") < 12, "P").otherwise("Q").alias("model"))
    general = p.filter("model = ''").select("service", F.col("price").alias("general"))
    return s.join(p, ["service", "model"], "left").join(general, "service", "left").select("s_suppkey", F.coalesce("price", "general").alias("price"))


@query("""SELECT a.event_id AS newer, b.event_id AS older FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND floor(epoch(a.ts)) - floor(epoch(b.ts)) >= 0 AND floor(epoch(a.ts)) - floor(epoch(b.ts)) < 21600""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("newer"), F.col("ts").alias("at"))
    b = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("older"), F.col("ts").alias("seen"))
    return rel.interval_join(a, b, "user_id", "at", "seen", 6 * 3600).select("newer", "older")


@query("""SELECT p_partkey, slug FROM part, (VALUES ('a', ['STEEL', 'TIN']), ('b', ['BRASS']), ('c', ['PROMO', 'BRASS', 'SMALL'])) t(slug, tags) WHERE list_has_any(string_split(p_type, ' '), tags)""")
def theta_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("a", ["STEEL", "TIN"]), ("b", ["BRASS"]), ("c", ["PROMO", "BRASS", "SMALL"])], "slug string, tags array<string>")
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("own"))
    return rel.overlap_join(p, t, "own", "tags").select("p_partkey", "slug")


@query("""SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
    UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
    UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    few, all_c = c.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")), c.select(F.col("c_nationkey").alias("k"))
    high, mid = s.filter("s_acctbal > 9000").select("s_nationkey"), s.filter("s_acctbal > 5000").select("s_nationkey")
    tag = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return tag("union", few.union(high).distinct()).unionByName(tag("intersect", few.intersect(mid))).unionByName(tag("except", all_c.subtract(mid)))


@query("""(SELECT 'unknown' AS branch, o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20) UNION ALL (SELECT 'failed', o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL (SELECT 'pending', o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20)""")
def limited_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    take = lambda name, s, *order: o.filter(F.col("o_orderstatus") == s).orderBy(*order).limit(20).select(F.lit(name).alias("branch"), "o_orderkey")
    return take("unknown", "P", "o_orderkey").unionByName(take("failed", "F", F.col("o_totalprice").desc(), "o_orderkey")).unionByName(take("pending", "O", "o_orderdate", "o_orderkey"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey % 30 AS model, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), n AS (SELECT *, max(day) OVER () AS newest FROM s)
    SELECT l_suppkey, model, score, day < newest AS carried FROM n WHERE date_diff('day', day, newest) BETWEEN 0 AND 30 QUALIFY row_number() OVER (PARTITION BY l_suppkey, model ORDER BY day DESC) = 1""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_suppkey", (F.col("l_partkey") % 30).alias("model"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("score"))
    newest = s.agg(F.max("day")).first()[0]
    return rel.carried_forward(s, ["l_suppkey", "model"], "day", F.lit(newest), 30).select("l_suppkey", "model", "score", "carried")


@query("""SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-01' QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC) = 1""")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit(datetime(1998, 6, 1)))
    return li.groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("l_orderkey"))


@query("""SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part""")
def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.competition_rank(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size").desc()]).select("p_brand", "p_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH c AS (SELECT p_brand, p_type, p_partkey, p_size % 4 AS label FROM part WHERE p_size <> 7) SELECT p_brand, p_type, p_partkey FROM c QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY label DESC, p_partkey) = 1""")
def representative_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration that stands for a (brand, type): eligible ones only, best label, first id."""
    p = table(spark, sf_dir, "part").filter("p_size <> 7")
    return rel.first_of(p, ["p_brand", "p_type"], [(F.col("p_size") % 4).desc(), F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey")


@query("""SELECT s_suppkey FROM supplier ORDER BY s_nationkey = 7 DESC, s_acctbal > 5000 DESC, s_acctbal DESC, s_suppkey LIMIT 2""")
def reserve_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.orderBy(F.col("s_nationkey").eqNullSafe(F.lit(7)).desc(), (F.col("s_acctbal") > 5000).desc(), F.col("s_acctbal").desc(), "s_suppkey").limit(2).select("s_suppkey")


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 300000)
    SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN n <= 100 THEN 0 ELSE 2 END AS band, n FROM a UNION ALL SELECT o_orderkey, 1, n FROM b) ORDER BY band, n LIMIT 400""")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' or o_totalprice > 300000")
    return rel.quota(o, F.col("o_orderstatus") == "F", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100, 400).select("o_orderkey")


@query("""WITH RECURSIVE a AS (SELECT list(doc_id ORDER BY doc_id DESC)[1:60] AS l FROM documents), b AS (SELECT list(doc_id ORDER BY n_chars, doc_id DESC)[1:60] AS l FROM documents), c AS (SELECT [min(doc_id)] AS l FROM documents WHERE doc_id % 3 = 1),
    t(turn, taken) AS (SELECT 0, l FROM c UNION ALL SELECT turn + 1, taken || list_filter(CASE WHEN turn % 2 = 0 THEN a.l ELSE b.l END, lambda x: NOT list_contains(taken, x))[1:1] FROM t, a, b WHERE turn < 120),
    f AS (SELECT taken[1:60] AS taken FROM t WHERE turn = 120) SELECT CAST(unnest(range(1, len(taken) + 1)) AS BIGINT) AS place, unnest(taken) AS doc_id FROM f""")
def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest and shortest documents in turns, one of the oldest before them."""
    d = table(spark, sf_dir, "documents")
    return rel.fair_interleave(d, "doc_id", [F.col("doc_id").desc()], [F.col("n_chars"), F.col("doc_id").desc()], 60, [F.col("doc_id") % 3 != 1, F.col("doc_id")])


@query("""SELECT o_orderkey, CAST(floor(epoch(o_orderdate) / 60) * 2 + CASE WHEN o_orderdate > TIMESTAMP '1999-12-29' THEN 1 ELSE 0 END AS BIGINT) AS priority FROM orders WHERE o_orderstatus = 'P'""")
def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return o.select("o_orderkey", (F.floor(F.unix_seconds("o_orderdate") / 60) * 2 + F.when(F.col("o_orderdate") > F.expr("timestamp '1999-12-29'"), 1).otherwise(0)).cast("bigint").alias("priority"))


@query("""SELECT o_orderkey FROM orders ORDER BY greatest(o_orderdate, TIMESTAMP '2000-01-01') DESC, o_totalprice DESC, o_orderkey LIMIT 100""")
def freshness_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.greatest("o_orderdate", F.expr("timestamp '2000-01-01'")).desc(), F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey")


@query("""SELECT s_suppkey FROM supplier ORDER BY CASE WHEN s_acctbal < 5000 THEN s_acctbal END ASC NULLS FIRST, s_suppkey LIMIT 30""")
def due_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due sources: never fetched first, then the oldest."""
    return table(spark, sf_dir, "supplier").orderBy(F.when(F.col("s_acctbal") < 5000, F.col("s_acctbal")).asc_nulls_first(), "s_suppkey").limit(30).select("s_suppkey")


@query("""WITH RECURSIVE c(k, t, hop) AS (SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN n_nationkey + 1 + n_nationkey % 3 ELSE n_nationkey END, 1 FROM nation UNION ALL SELECT k, CASE WHEN t < 20 THEN t + 1 + t % 3 ELSE t END, hop + 1 FROM c WHERE t < 20)
    SELECT CAST(k AS BIGINT) AS n_nationkey, CAST(max(t) AS BIGINT) AS target FROM c GROUP BY k""")
def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint"))
    to = F.when(F.col("n_nationkey") < 20, F.col("n_nationkey") + 1 + F.col("n_nationkey") % 3).otherwise(F.col("n_nationkey"))
    return rel.follow_chain(n.withColumn("merged_into", to), "n_nationkey", "merged_into", 20)


@query("""WITH m AS (SELECT DISTINCT date_trunc('hour', ts) AS g, CAST(json_extract_string(props, '$.k') AS BIGINT) AS story FROM events), p AS (SELECT a.story AS a, b.story AS b, count(*) AS shared FROM m a JOIN m b ON a.g = b.g AND a.story < b.story GROUP BY 1, 2 HAVING count(*) >= 18)
    SELECT a, b, shared FROM p UNION ALL SELECT b, a, shared FROM p""")
def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories signalled in the same hours at least 18 times."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("g"), F.get_json_object("props", "$.k").cast("bigint").alias("story"))
    return rel.mutual_links(e, "g", "story", 18)


@query("""SELECT c_mktsegment, p.r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region p ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("c_mktsegment", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, min_by(text, turn) AS opening, max_by(role, turn) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id""")
def first_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"), F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("turns"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, CAST(len(json_keys(props)) AS INTEGER) AS keys FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.size(F.json_object_keys("props")).alias("keys"))


@query("""SELECT DISTINCT CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS label, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders""")
def iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select(label.alias("label"), F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("monday")).distinct()


@query("""SELECT CAST(ts AS DATE) + 1 AS edition, count(*) AS n FROM events GROUP BY 1""")
def edition_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's edition covers 8 to 8 o'clock, eight hours ahead of UTC: the UTC day before."""
    return table(spark, sf_dir, "events").groupBy(F.date_add(F.to_date("ts"), 1).alias("edition")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_id, ts AS discovered, ts - to_seconds(CAST(CASE WHEN value < 10 THEN -7200 WHEN value < 40 THEN 3600 WHEN value < 90 THEN 200000 END AS BIGINT)) AS claimed FROM events),
    p AS (SELECT *, CASE WHEN claimed > discovered + INTERVAL 1 HOUR THEN NULL ELSE claimed END AS published FROM e),
    b AS (SELECT *, CASE WHEN published IS NULL THEN 'undated' WHEN discovered - published > INTERVAL 48 HOUR THEN 'stale' END AS backfill FROM p)
    SELECT event_id, backfill, epoch_us(CASE WHEN backfill IS NOT NULL AND published IS NOT NULL THEN published ELSE discovered END) AS timeline_us FROM b""")
def timeline_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.dates import timeline

    e = table(spark, sf_dir, "events")
    back = F.when(F.col("value") < 10, -7200).when(F.col("value") < 40, 3600).when(F.col("value") < 90, 200000)
    e = e.select("event_id", F.col("ts").alias("discovered"), F.timestamp_micros(F.unix_micros("ts") - back.cast("bigint") * 1_000_000).alias("claimed"))
    t = timeline(F.col("claimed"), F.col("discovered"))
    return e.select("event_id", t["backfill"].alias("backfill"), F.unix_micros(t["timeline_at"]).alias("timeline_us"))


@query("""WITH d AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(avg(m), 9) AS mean FROM d GROUP BY l_suppkey HAVING count(*) = 3""")
def complete_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of category means, only where every category is there."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("m"))
    return d.groupBy("l_suppkey").agg(F.round(F.avg("m"), 9).alias("mean"), F.count(F.lit(1)).alias("k")).filter("k = 3").drop("k")


@query("""WITH d AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id) SELECT CAST(sum(days - 1) AS BIGINT) AS repeats, count(*) AS users FROM d WHERE days > 1""")
def repeated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days")).filter("days > 1")
    return d.agg(F.sum(F.col("days") - 1).alias("repeats"), F.count(F.lit(1)).alias("users"))


@query("""SELECT user_id, event_id, ts_gap FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS ts_gap FROM events) WHERE ts_gap > 86400""")
def long_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("ts_gap", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))).filter("ts_gap > 86400").select("user_id", "event_id", "ts_gap")
