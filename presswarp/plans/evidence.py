"""Queries of evidence: lost characters, lead items, prices beside names, words beyond a headline, readiness, payloads and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources.tables import table
from .registry import query


@query(r"""WITH d AS (SELECT doc_id, text AS a, CASE doc_id % 4 WHEN 0 THEN replace(text, 'q', chr(65533)) WHEN 1 THEN replace(text, 'e', chr(65533)) WHEN 2 THEN replace(text, ' ', '  ') ELSE replace(text, 'the', 'tha') END AS b FROM documents),
    c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(a, chr(65533) || '+', chr(65533), 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(b, chr(65533) || '+', chr(65533), 'g'), '\s+', ' ', 'g')) AS b FROM d)
    SELECT doc_id, length(a) = length(b) AND len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] <> p[2] AND p[1] <> chr(65533) AND p[2] <> chr(65533))) = 0 AS same FROM c""")
def barring_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against copies with characters lost, blanks added or words changed."""
    k, t = F.col("doc_id") % 4, F.col("text")
    other = F.when(k == 0, F.replace(t, F.lit("q"), F.lit(ev.LOST))).when(k == 1, F.replace(t, F.lit("e"), F.lit(ev.LOST))).when(k == 2, F.replace(t, F.lit(" "), F.lit("  "))).otherwise(F.replace(t, F.lit("the"), F.lit("tha")))
    return table(spark, sf_dir, "documents").select("doc_id", ev.same_barring_loss(t, other).alias("same"))


@query(r"""WITH p AS (SELECT page_id // 8 AS edition, page_id % 8 AS k, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
    e AS (SELECT edition, CASE edition % 3 WHEN 1 THEN (SELECT substr(title, 1, 40) || '!' FROM p q WHERE q.edition = p.edition AND q.k = 2) WHEN 2 THEN 'qqq zzz' ELSE '' END AS lead FROM (SELECT DISTINCT edition FROM p) p),
    w AS (SELECT edition, lead, regexp_replace(lower(lead), '[\s\pP]', '', 'g') AS bare FROM e), i AS (SELECT *, regexp_replace(lower(title), '[\s\pP]', '', 'g') AS bare FROM p),
    s AS (SELECT w.edition, lead, page_id, k, len(list_intersect(list_distinct(list_transform(range(1, length(w.bare)), lambda x: w.bare[x] || w.bare[x + 1])), list_distinct(list_transform(range(1, length(i.bare)), lambda x: i.bare[x] || i.bare[x + 1])))) / nullif(len(list_distinct(list_transform(range(1, length(w.bare)), lambda x: w.bare[x] || w.bare[x + 1]))), 0) AS share FROM w JOIN i USING (edition)),
    b AS (SELECT edition, any_value(lead) AS lead, arg_max(page_id, share * 1000 - k / 10.0) AS best, max(share) AS share, arg_min(page_id, k) FILTER (k > 0) AS first FROM s GROUP BY 1)
    SELECT edition, CASE WHEN coalesce(lead, '') = '' THEN first WHEN share >= 0.5 THEN best END AS page_id FROM b""")
def lead_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item each edition leads with: of a lead that one item's title begins with, that nothing is like, and of none. An edition has eight items."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 8).alias("edition"), (F.col("page_id") % 8).alias("k"), "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    e = p.groupBy("edition").agg(F.array_sort(F.collect_list(F.struct("k", "page_id", "title"))).alias("items"))
    third = F.get(F.filter("items", lambda i: i["k"] == 2), F.lit(0))["title"]
    lead = F.when(F.col("edition") % 3 == 1, F.concat(F.substring(third, 1, 40), F.lit("!"))).when(F.col("edition") % 3 == 2, "qqq zzz").otherwise("")
    best = ev.lead_item(lead, F.filter("items", lambda i: i["k"] > 0), F.col("items"))
    return e.select("edition", best["page_id"].alias("page_id"))


@query(r"""WITH p AS (SELECT p_partkey, 'Model-' || p_partkey AS name, p_retailprice AS price, CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 780 WHEN 2 THEN 900 ELSE 10 END AS gap FROM part),
    b AS (SELECT *, 'Old Model prices: 1.5. ' || name || ' ' || repeat('y', gap) || ' costs ' || CASE WHEN p_partkey % 4 = 3 THEN '1' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN printf('%.4f', price) ELSE CAST(CAST(price AS DECIMAL(20, 2)) AS VARCHAR) END || ' and 0.60 more' AS body FROM p),
    s AS (SELECT *, substr(body, greatest(1, instr(body, name) - 800), least(800, instr(body, name) - 1) + length(name) + 800) AS near FROM b)
    SELECT p_partkey, regexp_matches(near, '(^|[^0-9.])(' || replace(printf('%.2f', price), '.', '\.') || '|' || replace(printf('%.4f', price), '.', '\.') || '|' || replace(regexp_replace(regexp_replace(printf('%.6f', price), '(\.\d*?)0+$', '\1'), '\.$', ''), '.', '\.') || ')([^0-9]|$)') AND regexp_matches(near, '(^|[^0-9.])0\.60?(00)?([^0-9]|$)') AS priced FROM s""")
def prices_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices beside a model's name: near, too far, or only as a part of another number."""
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(20,6)")
    gap = F.when(k % 4 == 1, 780).when(k % 4 == 2, 900).otherwise(10)
    name = F.concat(F.lit("Model-"), k)
    shown = F.when(k % 3 == 0, price.cast("decimal(20,4)").cast("string")).otherwise(price.cast("decimal(20,2)").cast("string"))
    body = F.concat(F.lit("Old Model  prices: 1.5.\n"), name, F.lit(" "), F.repeat(F.lit("y"), gap), F.lit(" costs "), F.when(k % 4 == 3, "1").otherwise(""), shown, F.lit(" and 0.60 more"))
    return table(spark, sf_dir, "part").select("p_partkey", ev.priced_near(body, F.array(F.lit(" "), name), [price, F.lit(0.6).cast("decimal(20,6)"), F.lit(None).cast("decimal(20,6)")]).alias("priced"))


_BARE = r"regexp_replace(regexp_replace(lower({0}), 'read\s+more', '', 'g'), '[\pP\pS\s]', '', 'g')"


@query(rf"""WITH p AS (SELECT page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&quot;', '"') AS t FROM pages),
    e AS (SELECT page_id, t, CASE page_id % 4 WHEN 0 THEN t || ' Read more' WHEN 1 THEN substr(t, 1, 20) WHEN 2 THEN t || ' and more words' ELSE '!!! 123' END AS x, CASE page_id % 5 WHEN 0 THEN 'new words of a body' ELSE '' END AS b, page_id % 2 = 0 AS ok, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 11 = 0 THEN 'quoted' ELSE '' END AS q FROM p),
    c AS (SELECT page_id, ok, {_BARE.format("t")} AS h, {_BARE.format("x")} AS x, {_BARE.format("b")} AS b, {_BARE.format("q")} AS q FROM e)
    SELECT page_id, (regexp_matches(x, '\pL') AND NOT (h <> '' AND contains(h, x)) AND regexp_matches(CASE WHEN h <> '' THEN replace(x, h, '') ELSE x END, '\pL')) OR (ok AND regexp_matches(b, '\pL') AND NOT (h <> '' AND contains(h, b)) AND regexp_matches(CASE WHEN h <> '' THEN replace(b, h, '') ELSE b END, '\pL')) OR regexp_matches(q, '\pL') AS evidence FROM c""")
def selection_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials whose excerpts repeat the headline, shorten it or go on, with bodies, posts of an address only and quotes."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    p = p.withColumn("plain", F.replace(F.replace("title", F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"')))
    short = F.replace(F.substring("plain", 1, 20), F.lit("&"), F.lit("&amp;"))
    excerpt = F.when(k % 4 == 0, F.concat(F.lit("<p>"), "title", F.lit(" <b>Read  more</b><script>var x</script></p>"))).when(k % 4 == 1, short).when(k % 4 == 2, F.concat("title", F.lit(" and more words"))).otherwise("!!! 123")
    p = p.select("page_id", "title", excerpt.alias("excerpt"), F.when(k % 5 == 0, "<div>new words of a body</div>").alias("body"), F.when(k % 2 == 0, "ok").otherwise("pending").alias("status"), F.when(k % 7 == 0, "https://t.co/abc @someone").alias("post"), F.when((k % 11 == 0) & (k % 7 != 0), "quoted").alias("quote"))
    return ev.with_evidence(p, "title", "excerpt", "body", "status", "post", "quote").select("page_id", "evidence")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'livebench-x' ELSE 'other' END || ':registered-v13:' || CASE event_id % 6 WHEN 0 THEN 'intelligenceIndexVersion=' || user_id WHEN 1 THEN 'editionId=e' || user_id || ';datasetVersion=2' WHEN 2 THEN 'editionId=e' || user_id
    WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'release=r1' ELSE 'benchmarkVersion=3' END WHEN 4 THEN 'release=r1' ELSE 'published-schema' END AS protocol FROM events""")
def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 6, F.col("user_id")
    json = lambda **x: F.to_json(F.struct(*[c.alias(n) for n, c in x.items()]))
    edition = F.concat(F.lit("e"), u)
    meta = F.when(k == 0, json(intelligenceIndexVersion=u, release=F.lit("r1"))).when(k == 1, json(editionId=edition, datasetVersion=F.lit(2))).when(k == 2, json(editionId=edition, benchmarkVersion=F.lit(3)))
    meta = meta.when(k == 3, json(release=F.lit("r1"), benchmarkVersion=F.lit(3))).when(k == 4, json(release=F.lit("r1"))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", ev.protocol(F.when(F.col("event_id") % 2 == 0, "livebench-x").otherwise("other"), meta).alias("protocol"))


@query("""SELECT o_orderkey AS analysis_id FROM orders JOIN customer c ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AND n_nationkey % 4 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AND c_custkey % 6 <> 0 AND c_custkey % 13 <> 0
      AND (c_custkey % 4 = 0 OR (o_orderkey % 2 = 0 AND c_custkey % 4 IN (2, 3)) OR (c_custkey % 4 = 1 AND c_custkey % 3 <> 0 AND c_custkey % 10 <> 1))""")
def workflow_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications that readers may see whole: Chinese, short posts and translated ones."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, k = F.col("o_orderkey"), F.col("c_custkey")
    publications = o.select(F.col("o_custkey").alias("article_id"), key.alias("analysis_id"), F.when(key % 7 == 0, " ").otherwise("t").alias("title"), F.lit("s").alias("summary"), F.when(F.col("o_orderstatus") == "P", "hidden").otherwise("public").alias("visibility"), F.when(key % 5 == 0, "summary").otherwise("full").alias("body_mode"), F.when(key % 2 == 0, "x").otherwise("news").alias("channel"))
    text = F.when(k % 4 == 0, "中文正文").when(k % 4 == 1, "english text " * 9).when(k % 4 == 2, "a short post").otherwise("https://x.y/" + "z" * 90 + " hi")
    articles = c.select(k.alias("article_id"), F.col("c_nationkey").alias("source_id"), (k % 3).alias("revision"), F.when(k % 6 == 0, "pending").otherwise("ok").alias("body_status"), text.alias("body_text"), F.when(k % 4 != 0, "en").alias("language"), F.lit(None).cast("string").alias("post_text"))
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), (F.col("n_nationkey") % 4 != 0).alias("site_fulltext"))
    analyses = o.select(key.alias("analysis_id"), F.col("o_custkey").alias("article_id"), F.when(key % 9 == 0, 99).otherwise(F.col("o_custkey") % 3).alias("input_revision"), F.when(key % 8 == 0, "block").otherwise("pass").alias("relevance"))
    translations = c.filter("c_custkey % 4 = 1 and c_custkey % 3 <> 0").select(k.alias("article_id"), F.lit("zh").alias("lang"), (k % 3).alias("revision"), (k % 10 != 1).alias("complete"), F.lit("<p>译文</p>").alias("body_html"), F.lit("译文").alias("body_text"))
    media = c.filter("c_custkey % 13 <> 0").select(k.alias("article_id"), (k % 3).alias("revision"))
    return ev.workflow_ready(publications, articles, sources, analyses, translations, media).select("analysis_id")


@query("""SELECT o_orderkey, '{"id":' || o_orderkey || ',"links":{"page":"/p/' || o_custkey || '"},"tags":["' || o_orderpriority || '"]}' AS payload FROM orders""")
def pruned_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    links = F.struct(F.concat(F.lit("/p/"), "o_custkey").alias("page"), F.lit("https://e.com").alias("original"))
    payload = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit("long").alias("summary"), links.alias("links"), F.array("o_orderpriority").alias("tags"), F.lit(None).cast("string").alias("reason")), {"ignoreNullFields": "false"})
    return o.select("o_orderkey", ev.pruned(payload, "id bigint, summary string, links struct<page: string, original: string>, tags array<string>, reason string", ["summary", "reason", "links.original"]).alias("payload"))


@query("""WITH i AS (SELECT n_regionkey, n_nationkey % 2 AS part, n_nationkey, n_name FROM nation)
    SELECT n_regionkey AS edition, CAST(count(DISTINCT part) AS INTEGER) AS groups, string_agg('p' || part || ':' || n_nationkey || ':' || n_name || ':' || CASE WHEN n_nationkey % 3 = 0 THEN 'https://s/' || n_nationkey ELSE 'https://o/' || n_nationkey END, ',' ORDER BY part, n_nationkey) AS items FROM i GROUP BY 1""")
def report_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions' documents as index entries, dailies and others, with their groups' items."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    item = F.struct(k.cast("string").alias("itemId"), F.col("n_name").alias("title"), F.lit("long prose").alias("text"), F.when(k % 3 == 0, F.concat(F.lit("https://s/"), k)).alias("sourceUrl"), F.struct(F.concat(F.lit("https://o/"), k).alias("original")).alias("links"))
    parts = n.groupBy("n_regionkey", (k % 2).alias("part")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("i")))).alias("l"))
    parts = parts.select("n_regionkey", "part", F.transform("l", lambda x: x["i"]).alias("items"))
    whole = parts.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("part", "items"))).alias("l"))
    rows = None
    for kind, groups, label, items in (("daily", "sections", "label", "items"), ("weekly", "themes", "heading", "storyRefs")):
        own = whole.filter(F.col("n_regionkey") % 2 == (0 if kind == "daily" else 1))
        doc = F.to_json(F.struct(F.lit("lead").alias("lead"), F.transform("l", lambda g: F.struct(F.concat(F.lit("p"), g["part"]).alias(label), F.lit("prose").alias("text"), g["items"].alias(items))).alias(groups)))  # noqa: B023
        own = own.select("n_regionkey", ev.report_index(kind, doc).alias("index"))
        flat = F.flatten(F.transform(F.col(f"index.{groups}"), lambda g: F.transform(g[items], lambda i: F.concat_ws(":", g[label], i["itemId"], i["title"], i["sourceUrl"]))))  # noqa: B023
        own = own.select(F.col("n_regionkey").alias("edition"), F.size(f"index.{groups}").alias("groups"), F.array_join(flat, ",").alias("items"))
        rows = own if rows is None else rows.unionByName(own)
    return rows
