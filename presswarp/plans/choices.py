"""Queries of choices: what stands, what is referred to, what qualifies, what is due, and rules of publications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import choices as ch
from ..operators import heat
from ..sources.tables import table
from .heat import HEAT, LATE, PARTICIPANTS, SIGNALS, clock, late_sources, signals
from .registry import query


@query(r"""WITH p AS (SELECT p_partkey, p_brand AS model_id, p_type AS metric_key, CASE p_partkey % 3 WHEN 0 THEN 'brand-' || p_partkey % 10 WHEN 1 THEN 'Brand ' || p_partkey % 10 ELSE p_brand END AS name, p_brand AS slug, p_size % 3 AS rank, CASE p_partkey % 4 WHEN 0 THEN 'FIRST_PARTY' WHEN 1 THEN 'SCAFFOLDED' ELSE 'OTHER' END AS kind, CASE WHEN p_size = 7 THEN 'mixed' END AS ineligible FROM part),
    r AS (SELECT *, ineligible IS NULL AND row_number() OVER (PARTITION BY model_id, metric_key ORDER BY ineligible IS NOT NULL, rank DESC, kind = 'FIRST_PARTY' DESC, regexp_matches(name, '^[a-z0-9-]+$') DESC, false DESC, length(name), name, kind) = 1 AS selected FROM p),
    s AS (SELECT *, CASE WHEN ineligible IS NOT NULL THEN ineligible WHEN selected AND kind = 'SCAFFOLDED' THEN 'scaffolded' WHEN selected AND kind = 'FIRST_PARTY' THEN 'first-party' WHEN selected THEN 'default' WHEN kind = 'SCAFFOLDED' THEN 'scaffolded-lower' ELSE 'lower-priority' END AS reason FROM r)
    SELECT model_id, metric_key, name, kind, reason, count(*) AS n FROM s GROUP BY ALL""")
def representative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stands for each brand and type, by six keys, and why."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("brand-"), k % 10)).when(k % 3 == 1, F.concat(F.lit("Brand "), k % 10)).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model_id"), F.col("p_type").alias("metric_key"), name.alias("source_model_name"), F.lit("none").alias("model_slug"), (F.col("p_size") % 3).alias("rank"), F.when(k % 4 == 0, "FIRST_PARTY").when(k % 4 == 1, "SCAFFOLDED").otherwise("OTHER").alias("kind"), F.when(F.col("p_size") == 7, "mixed").alias("ineligible"))
    found = ch.representatives(rows).withColumnRenamed("source_model_name", "name").withColumnRenamed("selection_reason", "reason")
    return found.groupBy("model_id", "metric_key", "name", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH m AS (SELECT o_orderkey AS article_id, 'u' || o_custkey AS url, 'x:' || o_orderkey AS identity_key, o_orderkey % 400 AS fact_id, o_orderdate AS created_at, o_orderkey % 10 <> 0 AS trusted, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS reply_to, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 3 END AS quoted FROM orders),
    r AS (SELECT a.article_id, b.fact_id, b.created_at, b.article_id AS other FROM m a JOIN m b ON b.trusted AND b.article_id <> a.article_id AND (b.article_id = a.reply_to OR b.article_id = a.quoted)),
    f AS (SELECT article_id, fact_id, min((created_at, other)) AS since FROM r GROUP BY 1, 2)
    SELECT a.article_id, (SELECT arg_min(b.fact_id, (b.created_at, b.article_id)) FROM m b WHERE b.url = a.url AND b.trusted AND b.article_id <> a.article_id) AS same_url, coalesce((SELECT string_agg(fact_id, ',' ORDER BY since) FROM f WHERE f.article_id = a.article_id), '') AS referenced FROM m a""")
def related_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of other reports of a post's page, and of the posts it replies to or quotes."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    posts = o.select(k.alias("article_id"), F.concat(F.lit("u"), "o_custkey").alias("url"), F.when(k % 3 == 0, F.floor(k / 2).cast("string")).alias("reply_to"), F.when(k % 4 == 0, F.concat(F.lit("https://x.com/a/status/"), F.floor(k / 3))).alias("quoted_url"))
    members = o.select(k.alias("article_id"), F.concat(F.lit("u"), "o_custkey").alias("url"), F.concat(F.lit("x:"), k).alias("identity_key"), (k % 400).alias("fact_id"), F.col("o_orderdate").alias("created_at"), (k % 10 != 0).alias("trusted"))
    found = ch.related_facts(posts, members)
    return found.select("article_id", "same_url", F.array_join(F.col("referenced").cast("array<string>"), ",").alias("referenced"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 9 AS u, l_partkey % 40 AS m FROM lineitem WHERE (l_partkey % 40 + l_suppkey % 9) % 4 < 2), o AS (SELECT *, u % 4 AS family, u % 3 AS operator, CASE u % 5 WHEN 0 THEN 'broad' WHEN 1 THEN 'preference' ELSE 'b' || u % 5 END AS budget FROM s WHERE u <> 8),
    a AS (SELECT o.m, count(DISTINCT x.m) AS met FROM o JOIN o x ON x.u = o.u AND x.m IN (1, 4, 7, 12) AND x.m <> o.m GROUP BY 1)
    SELECT CAST(m AS VARCHAR) AS model FROM o JOIN a USING (m) WHERE m % 10 <> 3 GROUP BY m HAVING count(DISTINCT u) >= 2 AND count(DISTINCT family) >= 2 AND count(DISTINCT operator) >= 2 AND count(DISTINCT budget) FILTER (budget NOT IN ('broad', 'preference')) >= 1 AND any_value(met) >= 2""")
def qualified_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of enough units, families, operators and budgets that meet anchors and came out in time."""
    s = table(spark, sf_dir, "lineitem").filter("(l_partkey % 40 + l_suppkey % 9) % 4 < 2").select((F.col("l_suppkey") % 9).alias("unit"), (F.col("l_partkey") % 40).cast("string").alias("model"))
    budgets = ["broad", "preference", "b2", "b3", "b4"]
    units = spark.createDataFrame([(k, 0.0 if k == 8 else 1.0, k % 4, k % 3, budgets[k % 5]) for k in range(9)], "unit bigint, weight double, family int, operator int, budget string")
    models = s.select("model").distinct().select("model", F.when(F.col("model").cast("int") % 10 == 3, F.lit(datetime(2020, 1, 1))).when(F.col("model").cast("int") % 10 == 4, F.lit(datetime(2024, 1, 1))).alias("released"))
    return ch.qualified_models(s, units, models, ["1", "4", "7", "12"], datetime(2023, 1, 1), 2, 2, 2, 1, 2)


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_acctbal < 0 OR c_acctbal <= 5000) AND c_custkey % 11 <> 0 ORDER BY CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal) END NULLS FIRST, c_custkey LIMIT 40""")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 7 != 0).alias("enabled"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_acctbal") >= 0, F.timestamp_seconds(F.floor("c_acctbal"))).alias("next_fetch_at"))
    return ch.due_sources(rows, ["BUILDING", "MACHINERY"], datetime(1970, 1, 1, 1, 23, 20), 40, F.col("source_id") % 11 == 0).select(F.col("source_id").alias("c_custkey"))


@query("""SELECT page_id, url || CASE WHEN page_id % 4 = 0 THEN '' ELSE ',https://b.com/' || page_id END AS addresses FROM pages WHERE NOT regexp_matches(url, '(?i)[.](png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|map|woff2?|ttf|eot|mp4|mp3|pdf)([?#]|$)')
    UNION ALL SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'https://b.com/' || page_id END FROM pages WHERE regexp_matches(url, '(?i)[.](png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|map|woff2?|ttf|eot|mp4|mp3|pdf)([?#]|$)')""")
def harvested_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses among the strings of search answers, at any depth, without files."""
    k = F.col("page_id")
    deep = F.struct(F.struct(F.array(F.lit("no address"), F.concat(F.lit("https://a.com/x.png?"), k), F.when(k % 4 != 0, F.concat(F.lit("https://b.com/"), k)), F.col("url"))).alias("more"))
    payload = F.to_json(F.struct(F.col("url").alias("first"), F.lit(3).alias("n"), deep.alias("deep")))
    return ch.harvested(table(spark, sf_dir, "pages").select("page_id", payload.alias("payload")), "payload").select("page_id", F.array_join("addresses", ",").alias("addresses"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS editorial, o_orderkey % 5 <> 0 AS pass, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'title_zh:' WHEN 2 THEN '标题' ELSE 'title' END AS title, o_orderkey % 2 = 0 AS judged, o_orderkey % 13 = 0 AS mp, o_orderkey % 4 <> 0 AS site, o_orderkey % 6 <> 0 AS ok FROM orders),
    e AS (SELECT *, editorial AND pass AND title NOT IN ('', 'title_zh:') AS eligible, CASE WHEN site AND ok THEN 'full' ELSE 'summary' END AS body_mode FROM o), s AS (SELECT *, eligible AND judged AND NOT mp AS selectable FROM e)
    SELECT k, eligible, selectable, body_mode, k % 8 = 0 AND body_mode = 'full' AS redistributed, k % 9 <> 0 AND k % 17 <> 0 AND ((selectable AND title = '标题') OR k % 19 = 0) AS indexable, k % 2 = 0 AND (k % 10 = 0 OR k % 3 = 0) AS historical FROM s""")
def publication_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    now = F.lit(datetime(2024, 1, 10))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 3 != 0, "editorial").alias("participation_mode"), F.when(k % 5 != 0, "pass").otherwise("block").alias("relevance"), F.when(k % 7 == 0, "").when(k % 7 == 1, "title_zh:").when(k % 7 == 2, "标题").otherwise("title").alias("title"), F.lit("a summary").alias("summary"), F.when(k % 2 == 0, True).alias("judged_selected"), F.when(k % 13 == 0, "EXCLUDE_MP").when(k % 13 == 1, "T1").alias("tier"),
        (k % 4 != 0).alias("site_fulltext"), (k % 8 == 0).alias("syndicate_fulltext"), F.when(k % 6 != 0, "ok").alias("body_status"), F.lit(True).alias("has_body"), F.when(k % 9 != 0, "public").alias("visibility"), F.when(k % 19 == 0, now).alias("indexed_at"), F.when(k % 17 == 0, now).alias("excluded_at"),
        ch.historical(k % 2 == 0, F.when(k % 10 != 0, F.when(k % 3 == 0, F.lit(datetime(2024, 1, 1))).otherwise(F.lit(datetime(2024, 1, 9)))), now).alias("historical"),
    )
    return ch.publication_flags(rows).select("k", "eligible", "selectable", "body_mode", "redistributed", "indexable", "historical")


@query(f"""WITH {SIGNALS}, {LATE}, {PARTICIPANTS}, {HEAT}, top AS (SELECT story, row_number() OVER (ORDER BY heat DESC, latest_at DESC, story) AS rank FROM agg WHERE participants >= 2 AND editorial >= 1 AND story % 3 <> 0 QUALIFY rank <= 10) SELECT rank, story FROM top""")
def readable_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hot board of stories with a report to read."""
    sig = signals(spark, sf_dir)
    at = clock(sig)
    shown = sig.select("story").filter("story % 3 <> 0")
    return heat.hot_board(sig, at, late_sources(sig, at), readable=shown).select(F.col("rank").cast("bigint").alias("rank"), "story")
