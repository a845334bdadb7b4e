"""Rules of sources, pools and boards over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import surfaces as sf
from ..operators.reading import first_of
from ..sources.tables import table
from .registry import query

NOON = datetime(2024, 1, 30, 12)
NOISE = {"deny": ["es"], "keep": ["licensed"], "drop_title": ["und", "la"], "drop": ["token", "gmail", "ssn"]}
_TITLE = "split_part(text, chr(10), 1)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))


@query(f"""WITH d AS (SELECT doc_id, lang, lower({_TITLE}) AS t, lower({_TITLE}) || chr(10) || lower(text) AS b FROM documents)
    SELECT doc_id, CASE WHEN lang = 'es' THEN true WHEN regexp_matches(b, '(^|[^a-z])(licensed)s?([^a-z]|$)') THEN false
        ELSE regexp_matches(t, '(^|[^a-z])(und|la)s?([^a-z]|$)') OR regexp_matches(b, '(^|[^a-z])(token|gmail|ssn)s?([^a-z]|$)') END AS noise FROM d""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", rules.noise(F.col("title"), F.col("text"), F.array("lang"), NOISE).alias("noise"))


@query(f"""WITH d AS (SELECT doc_id, lang, text, 'http://' || source || '/' || lang || '/' || doc_id AS url FROM documents), a AS (SELECT * FROM d WHERE starts_with(url, 'http://') AND NOT contains(url, '/fr/'))
    SELECT doc_id, 'https' || substr(url, 5) AS url FROM a WHERE NOT (lang = 'es' OR (NOT regexp_matches(lower({_TITLE}) || chr(10) || lower(text), '(^|[^a-z])(licensed)s?([^a-z]|$)')
        AND (regexp_matches(lower({_TITLE}), '(^|[^a-z])(und|la)s?([^a-z]|$)') OR regexp_matches(lower({_TITLE}) || chr(10) || lower(text), '(^|[^a-z])(token|gmail|ssn)s?([^a-z]|$)'))))""")
def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed addresses, then rewritten ones, then what is no noise."""
    d = _documents(spark, sf_dir).withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id"))
    allowed = d.filter(F.col("url").startswith("http://") & ~F.col("url").contains("/fr/"))
    rewritten = allowed.withColumn("url", F.concat(F.lit("https"), F.substring("url", 5, 1 << 20)))
    return rewritten.filter(~rules.noise(F.col("title"), F.col("text"), F.array("lang"), NOISE)).select("doc_id", "url")


@query(r"""WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'translated' ELSE 'new' END AS outcome, CAST(floor(value / 8) AS INTEGER) AS attempts, CASE WHEN user_id % 3 = 0 THEN 'http 503: busy' WHEN user_id % 3 = 1 THEN 'bad copy' END AS reason, ts FROM events),
    x AS (SELECT *, outcome = 'failed' AND regexp_matches(coalesce(reason, ''), '(?i)(connect failed|fetch failed|ECONN|CONNECT_TIMEOUT|connection.*closed|network|HTTP (429|5[0-9]{2}))') AS transport FROM t)
    SELECT event_id, outcome IN ('skipped', 'translated') OR (attempts >= 6 AND outcome <> 'partial' AND NOT transport)
        OR (outcome IN ('failed', 'partial') AND ts > TIMESTAMP '2024-01-30 12:00:00' - CASE WHEN transport THEN INTERVAL 5 MINUTE WHEN attempts >= 6 THEN INTERVAL 6 HOUR ELSE INTERVAL 5 MINUTE END) AS blocked FROM x""")
def attempts_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    outcome = F.when(kind == "error", "failed").when(kind == "view", "partial").when(kind == "purchase", "translated").otherwise("new")
    reason = F.when(F.col("user_id") % 3 == 0, "http 503: busy").when(F.col("user_id") % 3 == 1, "bad copy")
    return e.select("event_id", rules.attempt_blocked(outcome, F.floor(F.col("value") / 8).cast("int"), reason, F.col("ts"), F.lit(NOON)).alias("blocked"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 5000)""")
def trusted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return sf.trusted(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P", pending, "o_custkey").select("o_orderkey")


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%AN%' OR CAST(p_partkey AS VARCHAR) ILIKE '%77%' OR p_brand ILIKE '%#1%'""")
def entry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%AN%") | F.col("p_partkey").cast("string").ilike("%77%") | F.col("p_brand").ilike("%#1%")).select("p_partkey")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<IMG class="a" src = "https://e.com/a.png">' WHEN 1 THEN '<video controls poster=''http://e.com/p.png''>' WHEN 2 THEN '<img src="/a.png">' ELSE '' END || html AS html, page_id % 6 = 3 AS video FROM pages)
    SELECT page_id, regexp_matches(html, '(?i)<img\s[^>]*src\s*=\s*[''"]https?://') OR regexp_matches(html, '(?i)<video\s[^>]*poster\s*=\s*[''"]https?://') OR video AS needed FROM p""")
def media_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    head = F.when(k == 0, '<IMG class="a" src = "https://e.com/a.png">').when(k == 1, "<video controls poster='http://e.com/p.png'>").when(k == 2, '<img src="/a.png">').otherwise("")
    videos = F.when(F.col("page_id") % 6 == 3, F.array(F.struct(F.lit("video").alias("kind"), F.lit("https://e.com/v.png").alias("poster"))))
    return table(spark, sf_dir, "pages").select("page_id", rules.needs_media(F.concat(head, "html"), videos).alias("needed"))


@query("""SELECT o_orderkey AS id, CAST(round(o_totalprice / 1000) AS INTEGER) AS score, o_orderstatus = 'F' AS selected, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS reason FROM orders""")
def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow projection: rounded scores, reasons only where selected."""
    chosen = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000).cast("int").alias("score"), chosen.alias("selected"), F.when(chosen, F.col("o_orderpriority")).alias("reason"))


@query("""SELECT doc_id, md5(CASE WHEN lang <> 'fr' THEN lower(substr(text, 1, 12000)) ELSE '' END) AS body FROM documents""")
def search_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("lang") != "fr", "full").otherwise("summary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rules.search_body(F.col("text"), mode)).alias("body"))


@query("""SELECT l_orderkey, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_returnflag <> 'R' AND coalesce(CASE WHEN l_quantity >= 10 THEN l_quantity * 20 END, 800) >= 480) AS image FROM lineitem GROUP BY l_orderkey""")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first image wide enough of each order's lines."""
    media = F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "video").otherwise("image").alias("kind"), F.col("l_partkey").alias("url"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity") * 20).alias("width"))
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(media)).alias("m"))
    return each.select("l_orderkey", rules.first_image(F.col("m"))["url"].alias("image"))


@query("""SELECT page_id, min(page_id) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)) AS first FROM pages""")
def same_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's earliest page of the same path."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("key"))
    return sf.earliest_same(p, "key", "page_id").select("page_id", "first")


@query("""WITH r AS (SELECT CAST(o_custkey % 20 AS VARCHAR) || '::' || o_orderstatus AS card, max(o_totalprice) AS rate FROM orders WHERE o_custkey % 20 < 15 GROUP BY 1) SELECT o_orderkey, rate FROM orders LEFT JOIN r ON card = CAST(o_custkey % 20 AS VARCHAR) || '::' || o_orderstatus""")
def rate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("card", F.concat_ws("::", (F.col("o_custkey") % 20).cast("string"), "o_orderstatus"))
    rates = o.filter("o_custkey % 20 < 15").groupBy("card").agg(F.max("o_totalprice").alias("rate"))
    return o.join(rates, "card", "left").select("o_orderkey", "rate")


@query("""SELECT user_id % 10 AS service, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1""")
def latency_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of sums and counts by hour, which merge; an average of averages would not."""
    hourly = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("service"), F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return hourly.groupBy("service").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@query("""WITH r AS (SELECT user_id % 10 AS service, event_type, ts, value, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' AND ts > TIMESTAMP '2024-01-30 06:00:00')
    SELECT * FROM (SELECT service, event_type, count(*) FILTER (place <= 2) = 2 AND count(*) FILTER (place <= 2 AND value < 30) = 2 AND max(ts) > TIMESTAMP '2024-01-30 11:00:00' AS connect_failed FROM r WHERE place <= 6 GROUP BY ALL
        HAVING (count(*) FILTER (place = 1 AND value > 60) = 1 AND max(ts) > TIMESTAMP '2024-01-30 10:00:00') OR (count(*) FILTER (place <= 2) = 2 AND count(*) FILTER (place <= 2 AND value < 30) = 2 AND max(ts) > TIMESTAMP '2024-01-30 11:00:00'))""")
def newest_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("service", F.col("user_id") % 10)
    return sf.newest_refusals(e, ["service", "event_type"], "ts", "event_id", F.col("value") > 60, F.col("value") < 30, NOON, 7200, 3600)


@query("""SELECT s_suppkey FROM supplier QUALIFY row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) > 6""")
def over_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sf.over_capacity(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey")], 6).select("s_suppkey")


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_orderkey, l_linenumber) = 1""")
def report_of_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report an article, the primary role first."""
    return first_of(table(spark, sf_dir, "lineitem"), ["l_partkey"], [(F.col("l_returnflag") == "R").desc(), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query(f"""SELECT doc_id FROM documents WHERE (contains(lower({_TITLE}), 'et') OR contains(lower(text), 'et')) AND (contains(lower({_TITLE}), 'que') OR contains(lower(text), 'que')) ORDER BY doc_id DESC LIMIT 40""")
def public_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term in the title or the body, newest first, one page."""
    d = _documents(spark, sf_dir)
    for term in ("et", "que"):
        d = d.filter(F.lower("title").contains(term) | F.lower("text").contains(term))
    return d.orderBy(F.col("doc_id").desc()).limit(40).select("doc_id")


@query("""WITH p AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS story, user_id, max(ts) AS seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY (user_id % 4 = 0) DESC, user_id % 3, seen DESC, user_id) AS place FROM p)
    SELECT story, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY place) AS faces FROM r WHERE place <= 40 GROUP BY story""")
def story_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("story"), "user_id", "ts").groupBy("story", "user_id").agg(F.max("ts").alias("at"))
    e = e.withColumn("editorial", F.col("user_id") % 4 == 0).withColumn("tier", F.col("user_id") % 3)
    return sf.faces(e, "story", "user_id", "editorial", "tier", "at").select("story", F.array_join(F.col("faces").cast("array<string>"), ",").alias("faces"))


@query("""WITH d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '今天发布' WHEN 1 THEN '2024年发布' WHEN 2 THEN '这一年' ELSE '' END AS t FROM documents) SELECT doc_id, regexp_matches(t, '本周|本月|今日|今天|昨天|上周|上月|今年|这一年') AS deictic FROM d""")
def deictic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    t = F.concat("text", F.when(k == 0, "今天发布").when(k == 1, "2024年发布").when(k == 2, "这一年").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", rules.deictic(t).alias("deictic"))


@query(f"""SELECT doc_id, md5({_TITLE} || '。' || substr(text, 1, 300)) AS report FROM documents""")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(rules.report_text(F.col("title"), F.col("text"))).alias("report"))


@query("""SELECT p_partkey, array_to_string(list_filter([lower(p_brand), 'entity:' || p_name, p_type], lambda x: NOT starts_with(x, 'entity:')), '|') AS tags FROM part""")
def shown_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.lower("p_brand"), F.concat(F.lit("entity:"), "p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rules.display_tags(tags), "|").alias("tags"))


@query(r"""WITH p AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '#top' WHEN 1 THEN '///' ELSE '' END AS u, CASE page_id % 4 WHEN 0 THEN 'Deep  Sea' WHEN 1 THEN '' END AS topic FROM pages),
    c AS (SELECT page_id, topic, regexp_replace(regexp_replace(regexp_replace(split_part(u, '#', 1), '([?&])utm_[^&]*', '\1', 'g'), '&&', '?'), '/+$', '') AS u FROM p)
    SELECT page_id, u || CASE WHEN coalesce(topic, '') <> '' THEN '#' || lower(regexp_replace(topic, '\s+', '-', 'g')) ELSE '' END AS canonical FROM c""")
def canonical_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("page_id") % 3, F.col("page_id") % 4
    url = F.concat("url", F.when(k == 0, "#top").when(k == 1, "///").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", rules.canonical_source(url, F.when(t == 0, "Deep  Sea").when(t == 1, "")).alias("canonical"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'noaa.gov' WHEN 1 THEN 'agu.org' WHEN 2 THEN 'bbc.com' WHEN 3 THEN 'm.weibo.com' WHEN 4 THEN '' ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS host FROM pages),
    h AS (SELECT host, count(DISTINCT page_id % 5) AS engines, min(page_id % 23 + 1) AS best, bool_or(page_id % 3 = 0) AS feed FROM p GROUP BY host),
    k AS (SELECT *, CASE WHEN host = '' THEN 'invalid' WHEN host = 'm.weibo.com' THEN 'blocked' WHEN host = 'noaa.gov' THEN 'official' WHEN host = 'agu.org' THEN 'research' WHEN host = 'bbc.com' THEN 'news' WHEN ends_with(host, '.org') THEN 'organization' ELSE 'other' END AS kind FROM h),
    b AS (SELECT *, CASE kind WHEN 'invalid' THEN -1 WHEN 'blocked' THEN -1 WHEN 'official' THEN 4 WHEN 'research' THEN 3 WHEN 'organization' THEN 2 WHEN 'news' THEN 1 ELSE 0 END AS base FROM k),
    q AS (SELECT *, CAST(greatest(0, least(10, base + least(engines, 3) + CASE WHEN best <= 3 THEN 2 WHEN best <= 10 THEN 1 ELSE 0 END + CASE WHEN feed THEN 2 ELSE 0 END)) AS INTEGER) AS quality FROM b)
    SELECT host, kind, quality, feed AND kind NOT IN ('invalid', 'blocked') AND (engines >= 2 OR base >= 3 OR quality >= 6) AS eligible FROM q""")
def host_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that several engines found, scored."""
    k = F.col("page_id") % 8
    host = F.when(k == 0, "noaa.gov").when(k == 1, "agu.org").when(k == 2, "bbc.com").when(k == 3, "m.weibo.com").when(k == 4, "").otherwise(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    h = table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count_distinct(F.col("page_id") % 5).alias("engines"), F.min(F.col("page_id") % 23 + 1).alias("best"), F.bool_or(F.col("page_id") % 3 == 0).alias("feed"))
    h = h.withColumn("kind", rules.host_kind(F.col("host")))
    return h.select("host", "kind", F.inline(F.array(rules.host_score(F.col("kind"), F.col("engines"), F.col("best"), F.col("feed")))))


@query("""WITH f AS (SELECT user_id, count(*) AS items, max(CASE WHEN user_id % 5 <> 1 THEN ts END) AS latest, CASE WHEN user_id % 11 = 0 THEN 404 WHEN user_id % 11 = 1 THEN 200 END AS status FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT user_id, CASE WHEN status IS NOT NULL AND (status < 200 OR status > 299) THEN 'http' WHEN items < 5 THEN 'too-few-items' WHEN latest IS NULL THEN 'no-dated-items' WHEN round((epoch_us(TIMESTAMP '2024-02-28 00:00:00') - epoch_us(latest)) / 86400000000, 1) > 30 THEN 'stale' ELSE 'ok' END AS verdict FROM f""")
def feed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    f = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.max(F.when(u % 5 != 1, F.col("ts"))).alias("latest"))
    status = F.when(u % 11 == 0, 404).when(u % 11 == 1, 200)
    return f.select("user_id", rules.feed_verdict(status, F.col("items"), F.col("latest"), F.lit(datetime(2024, 2, 28))).alias("verdict"))


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last FROM orders""")
def month_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return months.select("month", F.inline(F.array(rules.month_span(F.col("month")))))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey % 7 = 0 AS running, CASE WHEN o_custkey % 5 <> 0 THEN o_orderdate END AS through FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN running THEN 'in_progress' WHEN through IS NULL OR TIMESTAMP '1998-01-01 03:00:00' < through THEN 'announced' WHEN TIMESTAMP '1998-01-01 03:00:00' >= through + INTERVAL 6 HOUR THEN 'likely_completed' ELSE 'expired_unconfirmed' END AS shown FROM o""")
def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    through = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("announced")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.presentation(status, F.col("o_custkey") % 7 == 0, through, F.lit(datetime(1998, 1, 1, 3))).alias("shown"))


@query("""WITH s AS (SELECT user_id % 3 AS purpose, user_id, count(*) AS total, count(*) FILTER (value < 60) AS accepted, max(value) * 40 AS ms, count(*) FILTER (value > 150) AS pending FROM events GROUP BY ALL),
    m AS (SELECT *, accepted >= 6 AND ms >= 1000 AND accepted / total >= 0.8 AS ok FROM s), w AS (SELECT *, min(CASE WHEN ok THEN ms END) OVER (PARTITION BY purpose) AS fastest, count(*) FILTER (ok) OVER (PARTITION BY purpose) AS n FROM m)
    SELECT user_id, CAST(CASE WHEN ok AND n >= 2 THEN greatest(1, least(4, floor(4 * fastest / greatest(1000, ms) * (accepted / total) * (accepted / total) / (1 + pending) + 0.5))) ELSE 1 END AS INTEGER) AS weight FROM w""")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("purpose"), "user_id")
    s = e.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 60).alias("accepted"), (F.max("value") * 40).alias("median_ms"), F.count_if(F.col("value") > 150).alias("pending"))
    return sf.routing_weights(s, "purpose").select("user_id", "weight")


@query("""SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda h, c: xor(h, c) * 16777619 % 4294967296) % 16 AS BIGINT) AS shard FROM customer""")
def budget_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", rules.shard_of(F.col("c_name"), 16).alias("shard"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'LOW' WHEN coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END, 0) >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM supplier""")
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10000)
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.confidence(F.col("s_nationkey") < 5, coverage).alias("confidence"))


@query("""SELECT c_custkey AS i, 'c.' || rtrim(translate(to_base64(encode('{"a":"' || c_name || '","i":' || c_custkey || '}')), '+/', '-_'), '=') AS cursor, c_name AS a FROM customer""")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors and what is read from them."""
    c = table(spark, sf_dir, "customer").select(rules.cursor("c", F.struct(F.col("c_name").alias("a"), F.col("c_custkey").alias("i"))).alias("cursor"))
    return c.withColumn("x", rules.read_cursor("c", F.col("cursor"), "a string, i bigint")).select("x.i", "cursor", "x.a")


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 1 THEN 123456789012345678 END AS tokens FROM events""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 4
    raw = F.when(k == 0, F.get_json_object("props", "$.k")).when(k == 1, "123456789012345678").when(k == 2, "-5").otherwise("12345678901234567890")
    return table(spark, sf_dir, "events").select("event_id", rules.token_count(raw).alias("tokens"))


@query("""WITH n AS (SELECT user_id % 10 AS source, CAST(ts AS DATE) AS day, count(*) FILTER (value > 60) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY day) AS last FROM n)
    SELECT source, day, n, CASE WHEN n = 0 THEN 'no rows' WHEN n < last / 2 THEN 'only ' || n || ' of ' || last END AS held FROM l""")
def held_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("source"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") > 60).alias("n"))
    return sf.plausible(n, ["source"], "day", "n")


REFUSALS = ((401, "no key"), (402, "insufficient balance"), (402, "pay"), (404, "model is switched off in Magpie"), (400, "bad request"), (429, "Exceeded your current quota"), (429, "too many requests"), (502, "code=100003"), (500, "Request Illegal"), (503, "busy"))
CATEGORIES = ("auth", "quota_day", "auth", "config", "auth", "quota_day", None, "auth", "config", None)


@query("WITH c AS (SELECT event_id, floor(epoch(ts)) AS now, [" + ", ".join("NULL" if c is None else f"'{c}'" for c in CATEGORIES) + """][event_id % 10 + 1] AS category, CASE WHEN user_id % 2 = 0 THEN floor(epoch(ts)) + user_id * 600 END AS reset FROM events)
    SELECT event_id, category, CAST(CASE WHEN category = 'quota_day' THEN CASE WHEN reset > now THEN least(reset, now + 36000) ELSE now + 3600 END WHEN category IS NOT NULL THEN now + 3600 END - now AS BIGINT) AS rest FROM c""")
def cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(m).alias("message")) for s, m in REFUSALS])
    e = table(spark, sf_dir, "events").select("event_id", F.unix_seconds("ts").alias("now"), F.element_at(cases, (F.col("event_id") % 10 + 1).cast("int")).alias("r"), F.when(F.col("user_id") % 2 == 0, F.unix_seconds("ts") + F.col("user_id") * 600).alias("reset"))
    e = e.withColumn("category", rules.cooldown(F.col("r.status"), F.col("r.message")))
    return e.select("event_id", "category", (rules.rest_until(F.col("category"), F.col("reset"), F.col("now"), 36000) - F.col("now")).alias("rest"))


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR o_custkey % 9 = 0) AND (o_custkey % 4 <> 0 OR o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-08-01') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one of three flags whose lock is absent or over, the newest of them."""
    o = table(spark, sf_dir, "orders").withColumn("locked", F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderdate") + F.expr("interval 30 days")))
    flags = (F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_custkey") % 9 == 0)
    free = F.col("locked").isNull() | (F.col("locked") < F.lit(datetime(1998, 8, 1)))
    return o.filter(flags & free).orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey")


@query("""WITH i AS (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS kind, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT kind, d, CASE kind WHEN 'daily' THEN CAST(d AS TIMESTAMP) WHEN 'weekly' THEN CAST(date_trunc('week', d) AS TIMESTAMP) + INTERVAL 7 DAY ELSE CAST(last_day(d) AS TIMESTAMP) + INTERVAL 1 DAY END <= TIMESTAMP '1997-06-15 00:00:00' AS due FROM i""")
def issues_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 o'clock in UTC+8 is midnight in UTC."""
    k = F.col("o_custkey") % 3
    i = table(spark, sf_dir, "orders").select(F.when(k == 0, "daily").when(k == 1, "weekly").otherwise("monthly").alias("kind"), F.to_date("o_orderdate").alias("d")).distinct()
    last = F.when(F.col("kind") == "weekly", F.date_add(F.to_date(F.date_trunc("week", "d")), 6)).otherwise(F.last_day("d"))
    return i.select("kind", "d", rules.issue_due(F.col("kind"), F.col("d"), last, F.lit(datetime(1997, 6, 15))).alias("due"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN repeat('自然资源', 30) WHEN 1 THEN '日本のニュース' WHEN 2 THEN '한국 新闻' ELSE '' END || text AS t FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS han, length(t) AS size, length(regexp_replace(t, '\s+', '', 'g')) AS dense FROM d)
    SELECT doc_id, han > 0 AND NOT regexp_matches(t, '[\x{3040}-\x{30ff}]') AND NOT regexp_matches(t, '[\x{ac00}-\x{d7af}]') AS chinese, size > 0 AND size < CASE WHEN han > size * 0.3 THEN 100 ELSE 500 END AS short, CASE WHEN dense = 0 THEN 0 ELSE round(han / dense, 9) END AS density FROM n""")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with starts of their own, in several scripts."""
    k = F.col("doc_id") % 5
    t = F.concat(F.when(k == 0, "自然资源" * 30).when(k == 1, "日本のニュース").when(k == 2, "한국 新闻").otherwise(""), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", rules.looks_chinese(F.col("t")).alias("chinese"), rules.short_post(F.col("t")).alias("short"), F.round(rules.chinese_density(F.col("t")), 9).alias("density"))


RUNS = (
    ("", "source_default:default", "来源默认配置", 400, False),
    ("High Effort", "first_party:high-effort", "High 推理", 500, False),
    ("Adaptive Reasoning, High Effort", "first_party:adaptive-reasoning+high+high-effort", "High 推理 · 自适应", 502, False),
    ("adaptive reasoning, low effort", "first_party:adaptive-reasoning+low+low-effort", "自适应推理", 452, False),
    ("Non-Reasoning", "first_party:non-reasoning", "非推理配置", 50, False),
    ("thinking-minimal", "first_party:minimal+thinking-minimal", "Minimal 推理", 100, False),
    ("xhigh, default-fallback", "first_party:default-fallback+xhigh", "xHigh 推理 · 含来源回退", 549, True),
    ("thinking-64k", "first_party:thinking-64k", "来源默认配置 · 64k", 400, False),
    ("0902", "source_default:default", "来源默认配置", 400, False),
    ("max, beta", "first_party:max", "Max 推理", 600, False),
)


@query("WITH r(k, key, label, rank, ineligible) AS (VALUES " + ", ".join(f"({k}, '{r[1]}', '{r[2]}', CAST({r[3]} AS INTEGER), {str(r[4]).lower()})" for k, r in enumerate(RUNS)) + ") SELECT event_id, key, label, rank, ineligible FROM events JOIN r ON k = event_id % 10")
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run descriptors and what is read from them; the SQL has the results as worked out by hand."""
    text = F.element_at(F.array(*[F.lit(r[0]) for r in RUNS]), (F.col("event_id") % 10 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", rules.configuration(F.array(text)).alias("c")).select("event_id", "c.*")
    return e.withColumn("ineligible", F.col("ineligible").isNotNull())


@query("""SELECT n_regionkey, '[' || string_agg('{"k":' || n_nationkey || ',"n":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS payload FROM nation GROUP BY 1""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sf.as_json(table(spark, sf_dir, "nation"), "n_regionkey", {"k": F.col("n_nationkey"), "n": F.col("n_name")})


@query("SELECT n_regionkey, CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records read back as rows."""
    return sf.recordset(json_records(spark, sf_dir), "payload", ["n_regionkey"], "k bigint, n string")


@query("""SELECT o_custkey, count(*) AS items FROM orders WHERE CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus = 'F' ELSE o_orderstatus <> 'F' END AND o_orderpriority LIKE '%E%' GROUP BY o_custkey""")
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of nested documents: even customers keep them in one array, odd ones in the other."""
    o = table(spark, sf_dir, "orders")
    keep = lambda cond: F.collect_list(F.when(cond, F.struct(F.col("o_orderpriority").alias("title"))))
    docs = o.groupBy("o_custkey").agg(keep(F.col("o_orderstatus") == "F").alias("items"), keep(F.col("o_orderstatus") != "F").alias("refs"))
    each = docs.select("o_custkey", F.explode(F.when(F.col("o_custkey") % 2 == 0, F.col("items")).otherwise(F.col("refs"))).alias("it"))
    return each.filter(F.col("it.title").rlike("E")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("items"))


@query("""WITH d AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY ALL) SELECT c_nationkey, count(*) FILTER (n = 0) AS blank, CAST(sum(n) AS BIGINT) AS items FROM d GROUP BY 1""")
def blank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an empty array, and the lengths of all arrays together."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("items"))
    d = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").withColumn("n", F.coalesce(F.size("items"), F.lit(0)))
    d = d.withColumn("n", F.when(F.col("items").isNull(), 0).otherwise(F.col("n")))
    return d.groupBy("c_nationkey").agg(F.count_if(F.col("n") == 0).alias("blank"), F.sum("n").cast("bigint").alias("items"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, min_by(event_type, place) AS icon, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS recent FROM r WHERE place <= 5 GROUP BY user_id""")
def source_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's latest icon and its five newest addresses."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    few = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w)).filter("place <= 5")
    each = few.groupBy("user_id").agg(F.min_by("event_type", "place").alias("icon"), F.array_sort(F.collect_list(F.struct("place", F.col("event_id").cast("string").alias("e")))).alias("r"))
    return each.select("user_id", "icon", F.array_join(F.transform("r", lambda x: x["e"]), ",").alias("recent"))
