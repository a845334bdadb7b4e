"""Readers, addresses, dates and texts of incoming material, over the driver's tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions import text as tx
from ..operators import editorial
from ..operators.graph import shared_dir
from ..operators.similarity import cosine
from ..sources import feeds as feeds_
from ..sources import readers, snapshots
from ..sources.tables import table
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(items: DataFrame, head: str, tail: str, path: str) -> None:
    """items: (feed, line). One file a feed: head, lines, tail."""
    feeds = items.select("feed").distinct()
    ends = feeds.select("feed", F.lit(0).alias("kind"), F.lit(head).alias("line")).unionByName(feeds.select("feed", F.lit(2).alias("kind"), F.lit(tail).alias("line")))
    lines = items.select("feed", F.lit(1).alias("kind"), "line").unionByName(ends)
    lines.repartition("feed").sortWithinPartitions("feed", "kind").select("feed", "line").write.partitionBy("feed").text(path)


_WORDS = "repeat('word ', CAST(p_size AS INTEGER) * 3)"


@query(f"""SELECT 'Part ' || p_name AS title, 'https://e.com/a/' || p_partkey AS url, CASE WHEN length(trim({_WORDS})) > 280 THEN trim({_WORDS}) END AS body, CASE WHEN length(trim({_WORDS})) <= 280 THEN trim({_WORDS}) END AS excerpt, 1704103200000000 AS published_us FROM part""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds written and read: whole texts are bodies, short ones excerpts."""
    path = _folder(spark, "feed")
    p = table(spark, sf_dir, "part")
    link = F.concat(F.lit("<link>http://www.e.com/a/"), "p_partkey", F.lit("/?utm_source=x</link><pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate>"))
    text = F.concat(F.lit("<description>&lt;p&gt;"), F.expr("repeat('word ', p_size * 3)"), F.lit("&lt;/p&gt;</description>"))
    item = F.concat(F.lit("<item><title>Part  "), "p_name", F.lit("</title>"), link, text, F.lit("</item>"))
    _written(p.select((F.col("p_partkey") % 16).alias("feed"), item.alias("line")), '<rss version="2.0"><channel><title>feed</title>', "</channel></rss>", path)
    return readers.feed_items(spark, path).select("title", "url", "body", "excerpt", F.unix_micros("published").alias("published_us"))


@query("""SELECT s_name AS title, 'https://e.com/s/' || s_suppkey AS url, 1704103200000000 AS published_us FROM supplier""")
def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "atom")
    s = table(spark, sf_dir, "supplier")
    links = F.concat(F.lit('<link rel="self" href="https://e.com/feed"/><link href="https://e.com/s/'), "s_suppkey", F.lit('"/>'))
    entry = F.concat(F.lit("<entry><title>"), "s_name", F.lit("</title>"), links, F.lit("<updated>2024-01-01T10:00:00Z</updated><summary>short</summary></entry>"))
    _written(s.select((F.col("s_suppkey") % 4).alias("feed"), entry.alias("line")), '<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>', "</feed>", path)
    return readers.atom_entries(spark, path).select("title", "url", F.unix_micros("published").alias("published_us"))


@query("""SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' || chr(10) || 'x' AS c_name FROM customer""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commas, quotes and line ends inside fields survive."""
    path = _folder(spark, "csv")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx')).alias("c_name"))
    c.write.option("header", True).option("escape", '"').csv(path)
    return readers.csv_rows(spark, path, "c_custkey bigint, c_name string")


@query("""SELECT n_nationkey AS k, n_name AS name FROM nation""")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of comments and blank lines between documents."""
    path = _folder(spark, "jsonl")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    n.select(F.explode(F.array(F.lit("// a comment"), F.lit(""), F.to_json(F.struct("k", "name"))))).write.text(path)
    return readers.jsonl_rows(spark, path, "k int, name string")


@query("""SELECT 'http://e.com/' || o_orderkey AS url, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_custkey % 6 <> 0""")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of nested documents: a flag is required, a number has a least value, and rows without an address go."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.when(F.col("o_custkey") % 6 != 0, F.concat(F.lit("http://e.com/"), "o_orderkey")).otherwise(" ").alias("href"), F.struct(F.col("o_orderpriority").alias("name")).alias("meta"), (F.col("o_orderstatus") == "F").alias("open"), F.col("o_totalprice").alias("price"))
    docs = o.groupBy("o_custkey").agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct(F.struct("items").alias("data"))).alias("doc"))
    return readers.json_list(docs, "doc", "data.items", {"url": "href", "title": "meta.name"}, "open", ("price", 100000.0))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('minute', ts)) WHEN 3 THEN epoch_us(date_trunc('day', ts)) - 28800000000 WHEN 4 THEN epoch_us(date_trunc('day', ts)) WHEN 5 THEN epoch_us(date_trunc('minute', ts)) - 28800000000 END AS at_us FROM events""")
def published_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments written in seven ways, one of which says nothing, read again."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 7
    there = F.timestamp_micros(F.unix_micros(ts) + 8 * 3_600_000_000)
    shown = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(there, "EEE, d MMM yyyy HH:mm:ss '+0800'")).when(k == 2, F.date_format(there, "yyyy年M月d日 星期二 H:mm")).when(k == 3, F.date_format(ts, "MMM d'th', yyyy"))
    shown = shown.when(k == 4, F.date_format(ts, "yyyy-MM-dd")).when(k == 5, F.date_format(ts, "dd/MM/yyyy - HH:mm")).otherwise(F.date_format(ts, "'between' yyyy 'and 2031'"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(dates.published_at(shown, date_order="dmy")).alias("at_us"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders)
    SELECT o_custkey, CAST(position AS INTEGER) AS position, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'https://e.com/x%20y/' || o_orderkey ELSE 'https://e.com/by/P ' || o_orderkey END AS url, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'T ' || o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Someone' END AS author, 1704103200000000 AS published_us, 'A sum ' || o_orderkey AS excerpt
    FROM o WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND (o_orderkey % 4 <> 0 OR o_orderkey % 7 <> 0)""")
def json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of nested documents by a source's settings: templates with a fallback, first texts, flags, least numbers."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    item = F.struct(
        k.alias("k"), F.when(k % 3 == 0, "x y").alias("slug"), F.concat(F.lit("P "), k).alias("name"), F.when(k % 4 != 0, F.concat(F.lit("<b>T</b>  "), "o_orderpriority")).alias("head"), F.when(k % 7 != 0, k).alias("id"), F.array(F.struct(F.when(k % 2 == 0, "Someone").alias("n"))).alias("by"),
        F.lit("2024-01-01T10:00:00Z").alias("at"), F.concat(F.lit("<p>A sum "), k, F.lit("</p>")).alias("sum"), (F.col("o_orderstatus") == "F").alias("open"), F.col("o_totalprice").alias("price"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("o"), item.alias("i")))), lambda x: x["i"])
    docs = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(listed.alias("items")).alias("data"))).alias("doc"))
    settings = {"items_path": "data.items", "require": ("open", True), "at_least": ("price", 100000.0), "url_template": "https://e.com/{slug}/{id}", "url_fallback": "https://e.com/by/{raw:name}", "titles": ["head", "id"], "summaries": ["none", "sum"], "authors": ["by.0.n"], "published": "at", "external_id": "k"}
    found = readers.json_candidates(docs, "doc", settings, "o_custkey")
    return found.select("o_custkey", "position", "url", "title", "author", F.unix_micros("published").alias("published_us"), "excerpt")


@query(r"""WITH p AS (SELECT page_id // 60 AS batch, page_id % 60 + 1 AS position, CASE WHEN page_id % 9 = 0 THEN ' ' ELSE 'title' END AS title, 'https://e.com/p/' || page_id % 40 AS canonical, page_id FROM pages),
    n AS (SELECT *, row_number() OVER (PARTITION BY batch, canonical ORDER BY position) AS nth FROM p)
    SELECT page_id, CASE WHEN position > 50 THEN 'too-many' WHEN trim(title) = '' THEN 'no-title' WHEN nth > 1 THEN 'duplicate' END AS reason FROM n""")
def pushed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 60).alias("batch"), (F.col("page_id") % 60 + 1).alias("position"), F.when(F.col("page_id") % 9 == 0, " ").otherwise("title").alias("title"), F.concat(F.lit("http://www.e.com/p/"), F.col("page_id") % 40, F.lit("/?utm_source=q")).alias("url"))
    return readers.pushed_items(p).select("page_id", "reason")


@query(r"""SELECT page_id, (starts_with(url, 'http://') OR starts_with(url, 'https://t')) AND NOT starts_with(url, 'http://th') AND NOT regexp_matches(url || CASE WHEN page_id % 7 = 0 THEN '.PDF?x' ELSE '' END, '(?i)\.(?:pdf|zip|jpg|png|mp4)(?:\?|$)') AS allowed FROM pages""")
def allowed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 7 == 0, ".PDF?x").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", readers.allowed(url, ["http://", "https://t"], ["http://th"]).alias("allowed"))


ROBOTS = "User-agent: other\\nDisallow: /\\n\\nUser-agent: *\\nDisallow: /en/ # all of it\\nAllow: /en/7\\nDisallow:\\nDisallow: /de/8\\nAllow: /de/8\\nUser-agent: PressWarp-bot\\nDisallow: /fr/1"


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), r(prefix, allow, position) AS (VALUES ('/en/', false, 4), ('/en/7', true, 5), ('/de/8', false, 7), ('/de/8', true, 8), ('/fr/1', false, 10))
    SELECT page_id, coalesce((SELECT arg_max(allow, length(prefix) * 100 - position) FROM r WHERE starts_with(path, prefix)), true) AS allowed FROM p""")
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of files, of the groups that concern us, and what they say of pages."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    files = p.select("host").distinct().withColumn("text", F.lit(ROBOTS.replace("\\n", "\n")))
    return readers.robots_allowed(p, readers.robots_rules(files, "presswarp")).select("page_id", "allowed")


@query("""WITH u AS (SELECT o_custkey % 50 AS page, o_orderkey AS position, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END AS level, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders),
    s AS (SELECT *, sum(CASE WHEN level = 2 AND date IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY position) AS part FROM u)
    SELECT position, strftime(last_value(date IGNORE NULLS) OVER (PARTITION BY page, part ORDER BY position ROWS UNBOUNDED PRECEDING), '%Y-%m-%d') AS dated FROM s""")
def heading_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    u = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page"), k.alias("position"), F.when(k % 5 == 0, 2).otherwise(3).alias("level"), F.when(k % 4 == 0, F.to_date("o_orderdate")).alias("date"))
    return readers.heading_dates(u).select("position", F.date_format("dated", "yyyy-MM-dd").alias("dated"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return readers.absent_only(table(spark, sf_dir, "orders"), have, "o_custkey").select("o_orderkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey >= 1000000 THEN 'came' WHEN s_suppkey % 17 = 0 THEN 'went' ELSE 'changed' END AS change, 'changed,unchanged,changed' AS rounds
    FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey % 17 = 0 OR s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 19 = 0)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of a table: stored, found unchanged in another order with a column that does not matter, stored anew; and the keys that differ."""
    place = snapshots.Snapshots(spark, _folder(spark, "snapshots"))
    s = table(spark, sf_dir, "supplier").withColumn("fetched", F.lit(1))
    more = s.filter("s_suppkey % 19 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    then = s.filter("s_suppkey % 17 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))).unionByName(more)
    rounds = [place.store(rows, datetime(2024, 1, k + 1), ("fetched",))[1] for k, rows in enumerate((s, s.withColumn("fetched", F.lit(2)).repartition(3, "s_name"), then))]
    first, last = (place.read(e["id"]).drop("fetched") for e in place.all())
    found = snapshots.changed_rows(first, last, ["s_suppkey"])
    return found.withColumn("rounds", F.lit(",".join("changed" if c else "unchanged" for c in rounds)))


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey <= 10 OR s_suppkey BETWEEN 31 AND 45""")
def resume_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a listing and the stretch after the entry remembered."""
    s = table(spark, sf_dir, "supplier")
    key = s.filter("s_suppkey = 30").first()
    return readers.resume_window(s, "s_suppkey", "s_name", key.s_name if key else None, 10, 15).select("s_suppkey")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'x:' || page_id WHEN 1 THEN 'url:https://e.com/a/' || page_id ELSE 'x:1' || page_id END AS key FROM pages""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://x.com/user/status/"), "page_id", F.lit("?s=20"))).when(k == 1, F.concat(F.lit("HTTP://www.E.com/a/"), "page_id", F.lit("/#top"))).otherwise(F.concat(F.lit("https://twitter.com/u/statuses/1"), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", urls.identity_key(url).alias("key"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.1234/ab.' || page_id WHEN 1 THEN '10.55555/x(' || page_id END AS doi FROM pages""")
def dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    text = F.when(k == 0, F.concat(F.lit("see https://doi.org/10.1234/AB."), "page_id", F.lit(".)"))).when(k == 1, F.concat(F.lit("doi:10.55555/X("), "page_id", F.lit(") and more"))).otherwise("no 10.1 here")
    return table(spark, sf_dir, "pages").select("page_id", urls.doi(text).alias("doi"))


#: Addresses, whether they are internal, and whether they are blocked.
ADDRESSES = (
    ("10.1.2.3", 1, 1), ("8.8.8.8", 0, 0), ("127.0.0.1", 1, 1), ("172.16.0.1", 1, 1), ("172.32.0.1", 0, 0), ("192.168.1.1", 1, 1), ("169.254.1.1", 1, 1), ("100.64.0.1", 1, 1), ("100.128.0.1", 0, 0), ("224.0.0.1", 0, 1), ("198.18.0.1", 0, 0), ("192.0.2.9", 0, 1), ("1.1.1", 1, 1), ("256.1.1.1", 1, 1),
    ("::1", 1, 1), ("::", 1, 1), ("fd00::1", 1, 1), ("fe80::1%eth0", 1, 1), ("ff02::1", 0, 1), ("2001:db8::1", 0, 1), ("::ffff:127.0.0.1", 1, 1), ("::FFFF:7f00:1", 1, 1), ("::7f00:1", 1, 1), ("64:ff9b::7f00:1", 1, 1), ("64:ff9b:1::1", 1, 1), ("2002:7f00:1::1", 1, 1), ("2001:0:4136:e378::1", 0, 1), ("100::1", 0, 1),
    ("2606:4700:4700::1111", 0, 0), ("::ffff:8.8.8.8", 0, 0), ("64:ff9b::808:808", 0, 0), ("2002:808:808::1", 0, 0), ("1:2:3:4:5:6:7:8", 0, 0), ("1:2:3:4:5:6:7:8:9", 1, 1), ("1::2::3", 1, 1), ("12345::", 1, 1), ("::ffff:300.1.1.1", 1, 1), ("not-an-ip", 1, 1),
)


@query("WITH a(k, internal, blocked) AS (VALUES " + ", ".join(f"({k}, {v} = 1, {w} = 1)" for k, (_, v, w) in enumerate(ADDRESSES)) + f") SELECT event_id, internal, blocked FROM events JOIN a ON k = event_id % {len(ADDRESSES)}")
def internal_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both kinds, in many spellings."""
    address = F.element_at(F.array(*[F.lit(a) for a, *_ in ADDRESSES]), (F.col("event_id") % len(ADDRESSES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", urls.internal_address(address).alias("internal"), urls.blocked_address(address).alias("blocked"))


_LONG = "repeat('Words of a whole text, ' || n_name || '. ', 20)"


@query(f"""WITH n AS (SELECT n_nationkey AS k, n_name, n_regionkey, n_nationkey % 3 AS kind FROM nation)
    SELECT k, 'Title & ' || n_name AS title, 'https://e.com/f/' || k AS url, 1704103200000000 + k * 1000000 AS published_us, CASE WHEN kind <> 2 THEN 'Someone' END AS author, CASE WHEN kind <> 1 THEN trim({_LONG}) END AS body, CASE kind WHEN 0 THEN 'Short ' || k WHEN 1 THEN 'The longer summary of ' || n_name ELSE 'Said of a video' END AS excerpt,
        CASE kind WHEN 0 THEN 'image https://e.com/i/' || k || '.png' WHEN 1 THEN 'image https://e.com/enclosed/' || k ELSE 'image https://e.com/w/' || k END AS media, CASE kind WHEN 0 THEN 'a,b' WHEN 2 THEN 't' ELSE '' END AS categories FROM n""")
def feed_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS with whole texts, RDF with enclosures and two summaries, and Atom with media: written, read by one reader."""
    path = _folder(spark, "feeds")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    k, kind = F.col("k"), F.col("k") % 3
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    title, long = F.concat(F.lit("Title &amp;amp; "), "n_name"), F.expr(_LONG)
    moment = F.timestamp_seconds(F.lit(1704103200) + k)
    rfc, iso = F.date_format(moment, "d MMM yyyy HH:mm:ss 'GMT'"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(tag("title", title), F.lit("<link>/f/"), k, F.lit("</link><dc:creator>Someone</dc:creator>"), tag("pubdate", rfc), tag("description", F.concat(F.lit("Short "), k)), F.lit("<category>a</category><category><![CDATA[b]]></category><content:encoded><![CDATA[<p>"), long, F.lit("</p><img src='/i/"), k, F.lit(".png'>]]></content:encoded>"))
    rdf = F.concat(tag("title", title), F.lit("<guid>https://e.com/f/"), k, F.lit("</guid><author>Someone</author>"), tag("dc:date", iso), F.lit("<description>Vol. 1</description>"), tag("dc:description", F.concat(F.lit("The longer summary of "), "n_name")), F.lit('<enclosure type="audio/x" url="/a"/><enclosure type="image/png" url="/enclosed/'), k, F.lit('"/>'))
    atom = F.concat(tag("title", title), F.lit('<link rel="self" href="/no"/><link href="'), k, F.lit('"/>'), tag("updated", iso), F.lit("<category term='t'/><summary>Said of a video</summary><content type='html'>&lt;div&gt;"), long, F.lit("&lt;img src='/w/"), k, F.lit("'&gt;&lt;/div&gt;</content><media:group><media:thumbnail url='/no.png' width='9'/></media:group>"))
    item = F.when(kind == 0, tag("item", rss)).when(kind == 1, tag("item", rdf)).otherwise(tag("entry", atom))
    feeds = n.select(kind.alias("kind"), item.alias("item"), "k").groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), "").alias("items"))
    text = F.when(F.col("kind") == 0, F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>feed</title><link>https://e.com</link>"), "items", F.lit("</channel></rss>")))
    text = text.when(F.col("kind") == 1, F.concat(F.lit("<rdf:RDF><channel rdf:about='x'><title>feed</title></channel>"), "items", F.lit("</rdf:RDF>"))).otherwise(F.concat(F.lit("<feed xml:base='https://e.com/f/'><title>feed</title>"), "items", F.lit("</feed>")))
    feeds.select("kind", text.alias("value")).write.partitionBy("kind").text(path)
    read = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text"), F.lit("https://e.com/feed.xml").alias("url"))
    rows = feeds_.entry_rows(feeds_.entries(read))
    first = F.get("media", F.lit(0))
    return rows.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("int").alias("k"), "title", "url", F.unix_micros("published").alias("published_us"), "author", "body", "excerpt", F.concat_ws(" ", first["kind"], first["url"]).alias("media"), F.array_join("categories", ",").alias("categories"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'read' WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'failed' WHEN c_custkey % 11 = 0 THEN 'again' ELSE 'unchanged' END AS outcome,
    CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN NULL ELSE 'e' || c_custkey END AS etag FROM customer""")
def feed_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a read says after one with validators: changed settings drop them, answers of other addresses don't count."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sources = c.select(k.alias("source_id"), F.concat(F.lit('{"v":'), (k % 3 == 0).cast("int"), F.lit("}")).alias("config"), F.concat(F.lit("https://e.com/"), k).alias("url"))
    before = c.select(k.alias("source_id"), F.sha2(F.lit('{"v":0}'), 256).alias("config_hash"), F.concat(F.lit("https://e.com/"), k).alias("response_url"), F.concat(F.lit("e"), k).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    s = F.col("source_id")
    status = F.when(s % 5 == 0, 200).when(s % 7 == 0, 500).otherwise(304)
    fetched = feeds_.conditional(sources, before).withColumns({"status": status, "response_url": F.when(s % 11 == 0, "https://other.com/").otherwise(F.col("url")), "response_etag": F.when(s % 5 == 0, "new"), "response_last_modified": F.lit(None).cast("string")})
    return feeds_.outcomes(fetched).select(s.alias("c_custkey"), "outcome", "etag")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'group:' || s_nationkey ELSE 'source:' || s_name END AS participant FROM supplier""")
def participant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("s_nationkey") % 3 == 0, F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", urls.participant_key(group, F.col("s_name")).alias("participant"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, epoch_us(date_trunc('day', ts) - INTERVAL 1 DAY) AS start_us, epoch_us(date_trunc('day', ts)) AS stop_us, strftime(ts + INTERVAL 8 HOUR, '%a, %d %b %Y %H:%M:%S') || ' +0800' AS stamp,
    CASE WHEN floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(ts)) < 86400 THEN 'active' WHEN floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(ts)) < 259200 THEN 'watching' ELSE 'settled' END AS status FROM events""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local days, an edition's window, the feeds' time stamp and a story's status."""
    ts = F.col("ts")
    w = dates.daily_window(F.to_date(ts))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(dates.local_date(ts), "yyyy-MM-dd").alias("day"), F.unix_micros(w["start"]).alias("start_us"), F.unix_micros(w["stop"]).alias("stop_us"), dates.rfc822(ts).alias("stamp"), dates.story_status(ts, F.lit(datetime(2024, 1, 30, 12))).alias("status"))


WRITTEN = (("2024-02-29T10:00:00Z", 1709200800), ("2024-02-29T10:00:00+02:00", 1709193600), ("Thu, 29 Feb 2024 10:00:00 GMT", 1709200800), ("29 Feb 2024 10:00:00 +0100", 1709197200), ("2024-02-29 18:00", 1709200800), ("2024/02/29", 1709136000), ("February 29, 2024", 1709136000), ("20240229", 1709136000), ("2023-02-29", None), ("soon", None))


@query("WITH w(k, s) AS (VALUES " + ", ".join(f"({k}, {'NULL' if s is None else s})" for k, (_, s) in enumerate(WRITTEN)) + ") SELECT event_id, CAST(s AS BIGINT) AS published, k IN (8) AS no_day FROM events JOIN w ON k = event_id % 10")
def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as they are written; a day that no calendar has is none."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in WRITTEN]), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(dates.parse_published(text)).alias("published"), (text.rlike(r"^\d{4}-\d\d-\d\d$") & ~dates.is_day(text)).alias("no_day"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '标题 ' || doc_id WHEN 1 THEN '**title_zh**:' WHEN 2 THEN '' ELSE 'Plain' END AS title, doc_id % 3 = 0 AS passes, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 5 = 1 THEN 'zh' END AS lang FROM documents)
    SELECT doc_id, doc_id % 4 = 0 AS listed, passes AND doc_id % 4 IN (0, 3) AS eligible, lang IS NOT DISTINCT FROM 'zh' OR (doc_id % 4 = 0 AND lang IS DISTINCT FROM 'en') AS chinese FROM d""")
def copy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese copy that is no bare label, eligible rows, and bodies that are Chinese by declaration or by sight."""
    k = F.col("doc_id")
    title = F.when(k % 4 == 0, F.concat(F.lit("标题 "), "doc_id")).when(k % 4 == 1, "**title_zh**:").when(k % 4 == 2, "").otherwise("Plain")
    lang = F.when(k % 5 == 0, "en").when(k % 5 == 1, "zh")
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), lang.alias("l"))
    return d.select("doc_id", editorial.listed(F.col("title")).alias("listed"), editorial.eligible(F.lit("editorial"), k % 3 == 0, F.col("title"), F.lit("summary")).alias("eligible"), tx.body_is_chinese(F.col("l"), F.col("title")).alias("chinese"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, c_mktsegment) AS title FROM customer""")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editor's value, unless blank, before the analysis."""
    editor = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "  ")
    return table(spark, sf_dir, "customer").select("c_custkey", editorial.override(editor, F.col("c_mktsegment")).alias("title"))


@query("""WITH v AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 10) SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY place) AS videos FROM v WHERE place <= 3 GROUP BY l_orderkey""")
def card_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three videos with a poster of each card."""
    m = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "R", "video").otherwise("image").alias("kind"), F.when(F.col("l_quantity") >= 10, F.lit("p")).alias("poster"))
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(m)).alias("media"))
    videos = F.transform(editorial.bounded_media(F.col("media")), lambda x: x["l_partkey"].cast("string"))
    return each.select("l_orderkey", F.array_join(videos, ",").alias("videos")).filter("videos <> ''")


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')) AS escaped FROM documents""")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.escape_xml(F.col("text"))).alias("escaped"))


@query("""WITH t AS (SELECT p_partkey, lower(p_brand) AS brand, list_transform(string_split(lower(p_type), ' '), lambda x: CASE x WHEN 'tin' THEN 'metal' WHEN 'steel' THEN 'metal' ELSE x END) AS w FROM part), k AS (SELECT p_partkey, list_concat(['news'], list_filter(w, lambda x: x IN ('metal', 'promo', 'small', 'large'))) AS w FROM t)
    SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS tags FROM k""")
def normalised_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms, allowed tags only, the category first, each once."""
    tags = tx.normalised_tags(F.split("p_type", " "), {"tin": "metal", "steel": "metal"}, ["metal", "promo", "small", "large"], F.lit("news"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS score FROM embeddings""")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score"))


@query("""SELECT page_id, 'A long title ' || page_id AS title, 'https://e.com/' || page_id AS url FROM pages""")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a listing: no images, no titles under six characters."""
    text = F.concat(F.lit("![pic of it](/a.png) [A *long* title "), "page_id", F.lit("](https://e.com/"), "page_id", F.lit(" 'x') [tiny](/y)"))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(tx.markdown_links(text)))
