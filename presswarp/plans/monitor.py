"""Queries of why-hot counts, story pages, the monitor's numbers and findings, over ``events``, ``orders`` and ``nation``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import developments as dv
from ..operators import monitor as mo
from ..sources.tables import table
from .registry import query

NOW = datetime(2024, 1, 20, 6)

_SIGNALS = "s AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS story_id, user_id AS participant_key, user_id % 8 AS source_id, CASE WHEN event_type = 'view' THEN 'editorial' ELSE 'signal' END AS kind, ts, event_id FROM events)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("story_id"), F.col("user_id").alias("participant_key"), (F.col("user_id") % 8).alias("source_id"), F.when(F.col("event_type") == "view", "editorial").otherwise("signal").alias("kind"), F.col("ts").alias("observed_at"), "event_id")


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.why_hot(_signals(spark, sf_dir), spark.createDataFrame([(3,)], "source_id bigint"), NOW)


_HOT = f"""{_SIGNALS}, o AS (SELECT * FROM s WHERE ts <= TIMESTAMP '{NOW}'),
    h AS (SELECT story_id, count(DISTINCT participant_key) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR) AS participants_48h,
        count(DISTINCT participant_key) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND NOT EXISTS (SELECT 1 FROM o x WHERE x.story_id = o.story_id AND x.participant_key = o.participant_key AND x.ts <= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR)) AS new_participants_6h,
        count(*) FILTER (kind = 'editorial' AND ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS recent_reports_24h, count(*) FILTER (source_id = 3 AND ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR) = 0 AS observation_complete FROM o GROUP BY 1)"""


@query(f"WITH {_HOT} SELECT * FROM h")
def why_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir)


@query(f"""WITH {_HOT}, r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, event_id) AS place, row_number() OVER (PARTITION BY story_id, participant_key % 5 = 0 ORDER BY ts DESC, event_id) AS turn FROM o WHERE kind = 'editorial'),
    g AS (SELECT story_id, count(*) AS report_count, count(DISTINCT source_id) AS source_count, min(ts) AS first, max(ts) AS last, arg_min('text ' || event_id || ' by s' || source_id, (ts, event_id)) FILTER (event_id % 3 <> 0) AS origin,
        string_agg(event_id, ',' ORDER BY turn) FILTER (participant_key % 5 = 0 AND turn <= 12) AS official, string_agg(event_id, ',' ORDER BY place) FILTER (place <= 100) AS timeline FROM r GROUP BY 1)
    SELECT g.story_id, CASE WHEN epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', last)) < 24 * 3600 THEN 'active' WHEN epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', last)) < 72 * 3600 THEN 'watching' ELSE 'settled' END AS status, report_count, source_count, epoch_us(first) AS first_us, CASE WHEN g.story_id % 2 = 0 THEN coalesce(origin, '') ELSE '' END AS excerpt,
        coalesce(participants_48h, 0) AS participants_48h, CASE WHEN g.story_id % 10 = 0 THEN g.story_id END AS rank, coalesce(official, '') AS official, md5(timeline) AS timeline FROM g LEFT JOIN h USING (story_id)""")
def story_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's head and lists for each story with reports."""
    s = _signals(spark, sf_dir).filter(F.col("observed_at") <= F.lit(NOW))
    k = F.col("story_id")
    reports = s.filter("kind = 'editorial'").select("story_id", F.col("event_id").alias("report_id"), "source_id", F.concat(F.lit("s"), "source_id").alias("source_name"), F.col("observed_at").alias("at"), (F.col("participant_key") % 5 == 0).alias("first_party"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("text "), "event_id")).alias("summary"))
    stories = s.select("story_id").distinct().select("story_id", F.concat(F.lit("Story "), k).alias("title"), F.when(k % 2 == 1, "a digest").alias("digest"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("timestamp").alias("latest_at"), F.lit(None).cast("timestamp").alias("first_report_at"))
    ranks = stories.filter(k % 10 == 0).select("story_id", k.alias("rank"), F.lit(1.0).alias("heat"))
    found = mo.story_details(stories, reports, _hot(spark, sf_dir), ranks, NOW)
    text = F.coalesce(F.concat(F.col("excerpt.text"), F.lit(" by "), F.col("excerpt.source_name")), F.lit(""))
    return found.select("story_id", "status", "report_count", "source_count", F.unix_micros("first_report_at").alias("first_us"), text.alias("excerpt"), "participants_48h", "rank", F.array_join("official", ",").alias("official"), F.md5(F.array_join("timeline", ",")).alias("timeline"))


_DAY = "TIMESTAMP '1999-06-01'"


@query(f"""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'reset_credit' ELSE 'direct_reset' END AS type, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'pending' END AS state, CAST(o_orderdate + INTERVAL 8 HOUR AS DATE) AS date FROM orders WHERE o_orderkey % 90 < 4),
    l AS (SELECT * FROM e WHERE state <> 'pending'), n AS (SELECT * FROM l WHERE date > DATE '1999-06-01' - 90 AND date <= DATE '1999-06-01'), d AS (SELECT DISTINCT date FROM l WHERE type = 'direct_reset' AND date > DATE '1999-06-01' - 90), g AS (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM d)
    SELECT (SELECT count(*) FROM n WHERE type = 'direct_reset') AS resets, (SELECT count(*) FROM n WHERE type = 'reset_credit') AS credits, (SELECT strftime(max(date), '%Y-%m-%d') FROM l WHERE type = 'direct_reset' AND state = 'confirmed') AS last_reset, (SELECT CAST(median(gap) AS DOUBLE) FROM g) AS median_days""")
def monitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced and landed events of a monitor: counts, the median of the days between, the last day."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter(k % 90 < 4)
    events = o.select(k.alias("event_id"), F.when(k % 3 == 0, "reset_credit").otherwise("direct_reset").alias("type"), F.when(k % 4 == 0, "confirmed").otherwise("open").alias("status"), F.when(k % 4 == 1, "likely_completed").when(k % 4 == 2, "announced").alias("presented"), F.lit(True).alias("kind_explicit"), F.lit(None).cast("date").alias("occurred_on"), F.when(k % 2 == 0, F.col("o_orderdate")).alias("confirmed_at"), F.lit(None).cast("timestamp").alias("planned_from"), F.col("o_orderdate").alias("created_at"))
    found = mo.monitor_stats(mo.monitor_marks(events), datetime(1999, 6, 1, 2))
    return found.select("resets", "credits", F.date_format("last_reset", "yyyy-MM-dd").alias("last_reset"), "median_days")


@query(r"""WITH e AS (SELECT n_nationkey AS k, DATE '2024-01-01' + CAST(n_nationkey % 7 AS INTEGER) AS d FROM nation), l AS (SELECT *, k || '|' || strftime(d, '%Y-%m-%dT00:00:00.000') || '|' || CASE WHEN k % 2 = 0 THEN 'confirmed' ELSE '-' END AS line FROM e)
    SELECT substr(sha256(string_agg(line, chr(10) ORDER BY d DESC, k) || chr(10) || 'post1'), 1, 16) AS version FROM l""")
def monitor_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + 86400 * (F.col("n_nationkey") % 7)).alias("updated_at"), F.when(F.col("n_nationkey") % 2 == 0, "confirmed").alias("presented"))
    return mo.monitor_version(n, F.lit("post1"))


@query(f"""WITH a AS (SELECT ts, CASE user_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'failed' ELSE 'done' END AS state FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts > TIMESTAMP '{NOW}' - INTERVAL 2 DAY),
    p AS (SELECT count(*) FILTER (state = 'new' AND ts < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR) AS waiting, min(ts) FILTER (state = 'new') AS oldest, count(*) FILTER (state = 'failed' AND ts > TIMESTAMP '{NOW}' - INTERVAL 3 HOUR) AS failed FROM a),
    j AS (SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts <= TIMESTAMP '{NOW}' AND user_id % 2 = 0 GROUP BY 1),
    f AS (SELECT string_agg(n_name, ',' ORDER BY n_name) AS which FROM nation WHERE n_nationkey % 4 = 0)
    SELECT 'content.collect' AS key, 'now' AS level, 'nothing new for 360 minutes' AS detail, epoch_us(max(ts)) AS since_us FROM a HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 360 MINUTE
    UNION ALL SELECT 'content.process', 'now', 'waiting ' || waiting || ', failed ' || failed, CASE WHEN waiting >= 10 THEN epoch_us(oldest) END FROM p WHERE waiting >= 10 OR failed >= 20
    UNION ALL SELECT 'report.daily', 'now', 'no daily report of 2024-01-20', NULL
    UNION ALL SELECT 'backup.stale', 'digest', 'no whole backup for a day', NULL
    UNION ALL SELECT 'receipts.unknown', 'digest', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') || ' s/F,s/O,s/P', NULL WHERE false
    UNION ALL SELECT 'queue.' || event_type, 'digest', n || ' waiting', epoch_us(oldest) FROM j WHERE oldest < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR
    UNION ALL SELECT 'leaderboard.fetch', 'digest', which, epoch_us(TIMESTAMP '2024-01-01') FROM f
    UNION ALL SELECT 'receipts.unknown', 'digest', count(*) || ' ' || string_agg(DISTINCT o_orderpriority || '/p' ORDER BY o_orderpriority || '/p'), NULL FROM orders WHERE o_orderstatus = 'P'""")
def alert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong at one moment of the month: content, reports, backups, receipts, queues and fetches."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    state = F.when(F.col("user_id") % 3 == 0, "new").when(F.col("user_id") % 3 == 1, "failed").otherwise("done")
    articles = e.filter("ts <= timestamp '2024-01-20 00:00:00'").select(F.col("ts").alias("discovered_at"), state.alias("state"), F.lit(None).cast("string").alias("error"))
    sources = n.select((F.col("n_nationkey") == 3).alias("enabled"))
    reports = n.select(F.lit("daily").alias("kind"), F.date_add(F.lit("2023-12-01").cast("date"), F.col("n_nationkey")).alias("day"))
    backups = n.select(F.timestamp_seconds(F.lit(1705622400) - 86400 * F.col("n_nationkey")).alias("at"), (F.col("n_nationkey") != 0).alias("uploaded"))
    receipts = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("ok").alias("status"), F.col("o_orderpriority").alias("service"), F.lit("p").alias("purpose"))
    jobs = e.select(F.col("event_type").alias("name"), F.when(F.col("user_id") % 2 == 0, "retry").otherwise("completed").alias("state"), F.col("ts").alias("start_after"))
    fetches = n.select(F.col("n_name").alias("source_key"), (F.col("n_nationkey") % 4 != 0).alias("ok"), F.lit(datetime(2024, 1, 1)).alias("last_ok"))
    found = mo.findings(NOW, articles, sources, reports, backups, receipts, jobs, fetches)
    return found.select("key", "level", "detail", F.unix_micros("since").alias("since_us"))


_FACTS = """m AS (SELECT l_suppkey % 20 AS story_id, CASE WHEN l_linenumber <> 4 THEN l_partkey % 300 END AS fact_id, l_orderkey * 10 + l_linenumber AS article_id, l_returnflag = 'R' AS first_party, l_linestatus = 'F' AS full_text, l_quantity AS score, l_shipdate AS shipped FROM lineitem WHERE l_discount < 0.05),
    d AS (SELECT story_id, fact_id, min(shipped) AS first_at, first(article_id ORDER BY first_party DESC, full_text DESC, score DESC, shipped, article_id) AS representative, count(DISTINCT article_id) AS own FROM m WHERE fact_id IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT l_partkey % 300 AS fact_id, count(*) AS reports FROM lineitem WHERE l_partkey % 300 % 2 = 0 GROUP BY 1),
    p AS (SELECT d.*, coalesce(reports, own) AS reports, row_number() OVER (PARTITION BY story_id ORDER BY first_at DESC, CAST(d.fact_id AS VARCHAR)) AS place FROM d LEFT JOIN c ON c.fact_id = d.fact_id)"""


def _developments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fact = F.col("l_partkey") % 300
    members = li.filter("l_discount < 0.05").select((F.col("l_suppkey") % 20).alias("story_id"), F.when(F.col("l_linenumber") != 4, fact).alias("fact_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"), (F.col("l_returnflag") == "R").alias("first_party"), F.when(F.col("l_linestatus") == "F", "full").otherwise("summary").alias("body_mode"), F.col("l_quantity").alias("score"), F.col("l_shipdate").alias("timeline_at"), F.lit(None).cast("timestamp").alias("sort_at"))
    counts = li.groupBy(fact.alias("fact_id")).agg(F.count(F.lit(1)).alias("reports")).filter("fact_id % 2 = 0")
    facts = counts.select("fact_id", F.lit("title").alias("title"), F.lit(None).cast("timestamp").alias("occurred_at"))
    return dv.developments(members, counts, facts)


@query(f"WITH {_FACTS} SELECT story_id, place, fact_id, representative, reports, substr(sha256(string_agg(fact_id || ':' || representative || ':' || reports, ',' ORDER BY place) OVER (PARTITION BY story_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 10) AS revision FROM p")
def developments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in each story, the latest first."""
    return _developments(spark, sf_dir).select("story_id", "place", "fact_id", "representative", "reports", "revision")


@query(f"""WITH {_FACTS}, s AS (SELECT story_id, count(*) AS size FROM p GROUP BY 1), r AS (SELECT n_nationkey AS request_id, n_nationkey AS story_id, CASE n_nationkey % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'ok' WHEN 2 THEN 'invalid' ELSE 'changed' END AS said FROM nation),
    q AS (SELECT request_id, r.story_id, size, CASE WHEN size IS NULL THEN 'missing' ELSE said END AS outcome, CASE WHEN said = 'ok' THEN 5 ELSE 0 END AS o FROM r LEFT JOIN s ON s.story_id = r.story_id)
    SELECT request_id, outcome, outcome IN ('start', 'ok') AND o + 5 < size AS more, place, fact_id, representative FROM q LEFT JOIN p ON p.story_id = q.story_id AND outcome IN ('start', 'ok') AND place > o AND place <= o + 5""")
def development_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second pages, cursors of other queries and of other states, stories without developments."""
    rows = _developments(spark, sf_dir)
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k.alias("request_id"), k.alias("story_id"), F.lit("news").alias("channel")).join(rows.select("story_id", "revision").distinct(), "story_id", "left")
    bound, kind = dv.binding(F.col("story_id"), F.col("channel")), F.col("request_id") % 4
    mark = F.when(kind == 1, dv.cursor(F.lit(5), F.col("revision"), bound)).when(kind == 2, dv.cursor(F.lit(5), F.col("revision"), F.lit("other"))).when(kind == 3, dv.cursor(F.lit(5), F.lit("older"), bound))
    found = dv.page(rows, n.select("request_id", "story_id", "channel", mark.alias("cursor")), 5, "channel")
    return found.select("request_id", "outcome", F.col("next").isNotNull().alias("more"), "place", "fact_id", "representative")
