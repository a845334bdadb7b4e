"""Reading surfaces over ``orders`` (as publications), ``documents`` and ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reading
from ..sources.tables import table
from .registry import query


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("article"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 25).alias("story"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("fact"),
        F.substring("o_orderpriority", 1, 1).alias("source"), F.col("o_orderdate").alias("sort_at"), (F.col("o_orderstatus") == "F").alias("first_party"),
        F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
    )


PUB = "pub AS (SELECT o_orderkey AS article, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 25 END AS story, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS fact, substr(o_orderpriority, 1, 1) AS source, o_orderdate AS sort_at, o_orderstatus = 'F' AS first_party, o_totalprice AS score, o_orderdate AS seen_at, o_orderpriority AS category, o_orderstatus AS status FROM orders)"


@query(f"WITH {PUB} SELECT article, category FROM pub ORDER BY sort_at DESC, article DESC LIMIT 40 OFFSET 80")
def pool_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.offset_page(publications(spark, sf_dir), [F.col("sort_at").desc(), F.col("article").desc()], 3).select("article", "category")


@query(f"WITH {PUB}, c AS (SELECT sort_at AS t, article AS k FROM pub ORDER BY sort_at DESC, article DESC LIMIT 1 OFFSET 29) SELECT article FROM pub, c WHERE (sort_at, article) < (t, k) ORDER BY sort_at DESC, article DESC LIMIT 31")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = publications(spark, sf_dir)
    first = reading.keyset_page(p, "sort_at", "article", None, 29).collect()  # a page
    last = first[-1]
    return reading.keyset_page(p, "sort_at", "article", (last.sort_at, last.article), 30).select("article")


@query(f"WITH {PUB} SELECT count(*) AS n FROM (SELECT 1 FROM pub WHERE first_party LIMIT 2000)")
def capped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.capped_count(publications(spark, sf_dir).filter("first_party"))


@query(f"""WITH {PUB}, g AS (SELECT *, coalesce('s' || story, 'f' || fact, 'a' || article) AS grp FROM pub),
    f AS (SELECT grp, fact, min(seen_at) AS t, count(*) AS reports, count(DISTINCT source) AS n, max(sort_at) AS anchor FROM g GROUP BY grp, fact),
    m AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t, fact NULLS FIRST) AS early, row_number() OVER (PARTITION BY grp ORDER BY t DESC, fact DESC NULLS LAST) AS late FROM f),
    r AS (SELECT grp, fact, article FROM g QUALIFY row_number() OVER (PARTITION BY grp, fact ORDER BY first_party DESC, score DESC, seen_at, article) = 1)
    SELECT a.grp AS "group", strftime(a.anchor, '%Y-%m-%d') AS anchor, a.reports, a.developments, e.fact AS main_fact, r.article AS representative, CAST(greatest(0, e.n - 1) AS INTEGER) AS more_sources,
           CASE WHEN l.fact <> e.fact THEN l.fact END AS newest_development
    FROM (SELECT grp, max(anchor) AS anchor, CAST(sum(reports) AS BIGINT) AS reports, count(*) AS developments FROM f GROUP BY grp) a
    JOIN m e ON e.grp = a.grp AND e.early = 1 JOIN m l ON l.grp = a.grp AND l.late = 1 JOIN r ON r.grp = e.grp AND r.fact IS NOT DISTINCT FROM e.fact""")
def grouped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_groups(publications(spark, sf_dir)).withColumn("anchor", F.date_format("anchor", "yyyy-MM-dd"))


@query(f"WITH {PUB} SELECT fact, article, first_party FROM pub WHERE fact IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact ORDER BY first_party DESC, score DESC, seen_at, article) = 1")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("first_party").desc(), F.col("score").desc(), F.col("seen_at"), F.col("article")]
    return reading.first_of(publications(spark, sf_dir).filter("fact is not null"), ["fact"], order).select("fact", "article", "first_party")


@query(f"WITH {PUB} SELECT strftime(sort_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT coalesce('s' || story, 'f' || fact, 'a' || article)) AS groups FROM pub GROUP BY 1")
def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.timestamp_seconds(F.unix_seconds("sort_at") + 8 * 3600), "yyyy-MM-dd")
    group = F.coalesce(F.concat(F.lit("s"), "story"), F.concat(F.lit("f"), "fact"), F.concat(F.lit("a"), "article"))
    return publications(spark, sf_dir).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"))


SEARCHED = "d AS (SELECT doc_id, lower(substr(text, 1, 40)) AS title, lower(source || ' ' || lang || ' ' || substr(text, 1, 300)) AS direct, lower(text) AS body, n_chars FROM documents)"


@query(f"""WITH {SEARCHED}, s AS (SELECT doc_id, n_chars, (contains(direct, 'the') OR contains(body, 'the')) AND (contains(direct, 'tion') OR contains(body, 'tion')) AS fits,
        6 * contains(title, 'the')::INT + 3 * contains(direct, 'the')::INT + contains(body, 'the')::INT + 6 * contains(title, 'tion')::INT + 3 * contains(direct, 'tion')::INT + contains(body, 'tion')::INT AS score FROM d)
    SELECT doc_id, score FROM s WHERE fits ORDER BY score DESC, n_chars DESC, doc_id DESC LIMIT 40""")
def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    direct = F.concat_ws(" ", "source", "lang", F.substring("text", 1, 300))
    hits = reading.relevance(d, reading.search_terms("The tion"), F.substring("text", 1, 40), direct, F.col("text"))
    return reading.offset_page(hits, [F.col("score").desc(), F.col("n_chars").desc(), F.col("doc_id").desc()], 1).select("doc_id", "score")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'under') ORDER BY n_chars DESC, doc_id DESC LIMIT 40")
def search_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, fits = table(spark, sf_dir, "documents"), F.lit(True)
    for term in reading.search_terms("license UNDER"):
        fits = fits & F.contains(F.lower("text"), F.lit(term))
    return reading.offset_page(d.filter(fits), [F.col("n_chars").desc(), F.col("doc_id").desc()], 1).select("doc_id")


@query("""WITH a AS (SELECT doc_id, 3 AS s FROM documents WHERE contains(lower(substr(text, 1, 200)), 'the ')), b AS (SELECT doc_id, 1 AS s FROM documents WHERE contains(lower(text), 'ation'))
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.s, 0) + coalesce(b.s, 0) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def search_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two match sets joined in full: 3 for a direct hit, 1 for one in the body."""
    d = table(spark, sf_dir, "documents")
    a = d.filter(F.contains(F.lower(F.substring("text", 1, 200)), F.lit("the "))).select("doc_id", F.lit(3).alias("direct"))
    b = d.filter(F.contains(F.lower("text"), F.lit("ation"))).select("doc_id", F.lit(1).alias("body"))
    return a.join(b, "doc_id", "full").select("doc_id", (F.coalesce("direct", F.lit(0)) + F.coalesce("body", F.lit(0))).alias("score"))


TOPICS = [("steel", ["STEEL"], [], ["tin"]), ("small", [], ["1", "2", "3"], []), ("copper", ["COPPER"], ["9"], ["brass", "x"]), ("standard", ["STANDARD"], [], ["e"])]


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("tags"), F.col("p_size").cast("string").alias("category"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))


ASSIGNED = """r AS (SELECT p_partkey AS id, string_split(p_type, ' ') AS tags, CAST(p_size AS VARCHAR) AS category, lower(p_name || ' ' || p_type) AS text FROM part),
    t(slug, tags, categories, keywords) AS (VALUES ('steel', ['STEEL'], []::VARCHAR[], ['tin']), ('small', []::VARCHAR[], ['1', '2', '3'], []::VARCHAR[]), ('copper', ['COPPER'], ['9'], ['brass', 'x']), ('standard', ['STANDARD'], []::VARCHAR[], ['e'])),
    x AS (SELECT id, slug, CASE WHEN list_has_any(r.tags, t.tags) THEN 'tag' WHEN list_contains(t.categories, r.category) THEN 'category' WHEN len(list_filter(t.keywords, lambda k: length(k) >= 2 AND contains(r.text, k))) > 0 THEN 'keyword' END AS how FROM r, t),
    assigned AS (SELECT * FROM x WHERE how IS NOT NULL)"""


@query(f"WITH {ASSIGNED} SELECT * FROM assigned")
def topic_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = spark.createDataFrame(TOPICS, "slug string, tags array<string>, categories array<string>, keywords array<string>")
    return reading.assigned_topics(part_rows(spark, sf_dir), topics)


@query(f"""WITH {ASSIGNED}, n AS (SELECT slug, count(DISTINCT id) AS total, count(DISTINCT id) FILTER (id > (SELECT max(id) * 0.75 FROM r)) AS recent FROM assigned GROUP BY slug)
    SELECT *, total >= 50 OR (total >= 20 AND recent > 0) AS indexable, CASE WHEN recent = 0 THEN 'archive' WHEN recent >= 3 THEN 'live' ELSE 'keep' END AS state FROM n""")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_rows(spark, sf_dir)
    topics = spark.createDataFrame(TOPICS, "slug string, tags array<string>, categories array<string>, keywords array<string>")
    top = rows.agg((F.max("id") * 0.75).alias("edge"))
    found = reading.assigned_topics(rows, topics).crossJoin(F.broadcast(top))  # one row
    n = found.groupBy("slug").agg(F.count_distinct("id").alias("total"), F.count_distinct(F.when(F.col("id") > F.col("edge"), F.col("id"))).alias("recent"))
    return n.withColumn("indexable", (F.col("total") >= 50) | ((F.col("total") >= 20) & (F.col("recent") > 0))).withColumn("state", F.when(F.col("recent") == 0, "archive").when(F.col("recent") >= 3, "live").otherwise("keep"))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) WHERE tag NOT IN ('STEEL', 'COPPER', 'STANDARD', 'PLATED') GROUP BY tag HAVING count(*) >= 8 ORDER BY n DESC, tag LIMIT 50""")
def tag_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = part_rows(spark, sf_dir).select(F.explode("tags").alias("tag"))
    taken = spark.createDataFrame([(x,) for x in ("STEEL", "COPPER", "STANDARD", "PLATED")], "tag string")
    return tags.join(taken, "tag", "left_anti").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n >= 8").orderBy(F.col("n").desc(), "tag").limit(50)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), s AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS issues FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
    SELECT coalesce(d.day, s.day) AS day, coalesce(orders, 0) AS orders, coalesce(issues, 0) AS issues, orders IS NOT NULL AND issues IS NOT NULL AS marked FROM d FULL JOIN s ON d.day = s.day""")
def calendar_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    s = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("issues"))
    both = F.col("orders").isNotNull() & F.col("issues").isNotNull()
    return d.join(s, "day", "full").select("day", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("issues", F.lit(0)).alias("issues"), both.alias("marked"))


PRESENT = "present AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey % 7 = 0)"


@query(f"""WITH {PRESENT}, dense AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM present), missing AS (SELECT day FROM dense WHERE day NOT IN (SELECT day FROM present)),
    i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island, date_trunc('month', day) AS m FROM missing)
    SELECT min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY island, m""")
def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderpriority like '1%' and o_custkey % 7 = 0")
    return reading.islands(reading.missing_days(o.select(F.to_date("o_orderdate").alias("day")), "day"), [], "day")


@query("""WITH d AS (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events), u AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (value < 2) AS unsettled, count(*) AS n FROM events GROUP BY 1)
    SELECT d.day, coalesce(unsettled, 0) AS unsettled FROM d LEFT JOIN u USING (day) WHERE coalesce(unsettled, 0) <= 8 AND d.day NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE value > 480)""")
def settled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    dense = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    unsettled = e.groupBy("day").agg(F.count_if(F.col("value") < 2).alias("unsettled"))
    out = dense.join(unsettled, "day", "left").select("day", F.coalesce("unsettled", F.lit(0)).alias("unsettled")).filter("unsettled <= 8")
    return out.join(e.filter("value > 480").select("day").distinct(), "day", "left_anti")


CANDIDATES = "cand AS (SELECT * FROM pub WHERE fact IS NOT NULL AND sort_at >= TIMESTAMP '1997-01-01' AND sort_at < TIMESTAMP '1997-04-01' QUALIFY row_number() OVER (PARTITION BY fact ORDER BY first_party DESC, score DESC, article) = 1)"


def report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = publications(spark, sf_dir).filter("fact is not null and sort_at >= timestamp '1997-01-01' and sort_at < timestamp '1997-04-01'")
    return reading.first_of(p, ["fact"], [F.col("first_party").desc(), F.col("score").desc(), F.col("article")])


@query(f"WITH {PUB}, {CANDIDATES} SELECT article, fact FROM cand ORDER BY score DESC, sort_at, article LIMIT 40")
def report_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_candidates(spark, sf_dir).orderBy(F.col("score").desc(), "sort_at", "article").limit(40).select("article", "fact")


@query(f"""WITH {PUB}, {CANDIDATES}, s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, sort_at, article) AS place FROM cand),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, sort_at, article) AS flash FROM s WHERE place > 8)
    SELECT article, category AS section, place FROM s WHERE place <= 8 UNION ALL SELECT article, 'flash', flash FROM o WHERE flash <= 12""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows a section; the best twelve of the rest are flashes."""
    order = [F.col("score").desc(), F.col("sort_at"), F.col("article")]
    c = report_candidates(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order)).cast("bigint"))
    main = c.filter("place <= 8").select("article", F.col("category").alias("section"), "place")
    rest = c.filter("place > 8").orderBy(*order).limit(12).withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return main.union(rest.select("article", F.lit("flash"), "n"))


@query(f"""WITH {PUB}, {CANDIDATES} SELECT article, fact FROM cand WHERE fact NOT IN (SELECT fact FROM pub WHERE fact IS NOT NULL AND sort_at >= TIMESTAMP '1996-12-25' AND sort_at < TIMESTAMP '1997-01-01')""")
def report_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without the facts of the seven days before."""
    covered = publications(spark, sf_dir).filter("fact is not null and sort_at >= timestamp '1996-12-25' and sort_at < timestamp '1997-01-01'").select("fact").distinct()
    return report_candidates(spark, sf_dir).join(covered, "fact", "left_anti").select("article", "fact")


@query(f"WITH {PUB}, {CANDIDATES} SELECT count(*) AS events, count(DISTINCT source) AS sources, count(*) FILTER (first_party) AS first_party, count(*) FILTER (status = 'O') AS releases FROM cand")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_candidates(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("source").alias("sources"), F.count_if("first_party").alias("first_party"), F.count_if(F.col("status") == "O").alias("releases"))


@query("""WITH d AS (SELECT DISTINCT o_orderpriority AS kind, strftime(o_orderdate, '%Y-%m') AS key FROM orders WHERE o_totalprice > 300000) SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key) AS issue FROM d""")
def issue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions are numbered by kind; blank ones (no dear order) are not."""
    d = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_orderpriority").alias("kind"), F.date_format("o_orderdate", "yyyy-MM").alias("key")).distinct()
    return d.withColumn("issue", F.row_number().over(Window.partitionBy("kind").orderBy("key")).cast("bigint"))


@query("SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderdate + INTERVAL 1 DAY) DESC, o_orderkey DESC LIMIT 50")
def feed_latest50(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), F.timestamp_seconds(F.unix_seconds("o_orderdate") + 86400))
    return table(spark, sf_dir, "orders").orderBy(when.desc(), F.col("o_orderkey").desc()).limit(50).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '2024-01-15'), o_orderkey LIMIT 180")
def daily_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("2024-01-15"))), "o_orderkey").limit(180).select("o_orderkey")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log: seq = order, article = customer, removed where the status is P, visible an hour after the order's day begins."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("article"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("upsert").alias("op"), F.timestamp_seconds(F.unix_seconds("o_orderdate") + 3600).alias("visible_at"))


LEDGER = "ledger AS (SELECT o_orderkey AS seq, o_custkey AS article, CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'upsert' END AS op, o_orderdate + INTERVAL 1 HOUR AS visible_at FROM orders), w AS (SELECT coalesce(min(seq) FILTER (visible_at > TIMESTAMP '2000-06-01' AND visible_at <= TIMESTAMP '2000-06-02') - 1, max(seq)) AS w FROM ledger)"
NOW = datetime(2000, 6, 1)


@query(f"WITH {LEDGER} SELECT w AS watermark FROM w")
def ledger_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(reading.watermark(ledger(spark, sf_dir), NOW),)], "watermark bigint")


@query(f"WITH {LEDGER} SELECT article, seq FROM (SELECT * FROM ledger, w WHERE seq <= w QUALIFY row_number() OVER (PARTITION BY article ORDER BY seq DESC) = 1) WHERE op = 'upsert'")
def ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ledger(spark, sf_dir)
    return reading.snapshot(log, "article", reading.watermark(log, NOW)).select("article", "seq")


@query(f"""WITH {LEDGER}, live AS (SELECT article FROM (SELECT * FROM ledger, w WHERE seq <= w QUALIFY row_number() OVER (PARTITION BY article ORDER BY seq DESC) = 1) WHERE op = 'upsert')
    SELECT seq, article, CASE WHEN article IN (SELECT article FROM live) THEN op ELSE 'remove' END AS op FROM ledger, w WHERE seq > w * 0.9 AND seq <= w""")
def ledger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ledger(spark, sf_dir)
    w = reading.watermark(log, NOW)
    out = reading.changes(log, reading.snapshot(log, "article", w), "article", w * 0.9, w)
    return out.select("seq", "article", "op")


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' GROUP BY 1)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'remove' ELSE 'upsert' END AS op FROM o FULL JOIN n ON o.k = n.k WHERE o.p IS DISTINCT FROM n.p""")
def upsert_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = lambda cond: o.filter(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("p"))
    return reading.diff(state("o_orderdate < timestamp '1999-01-01'"), state("o_orderdate >= timestamp '1996-06-01'"), "k", ["p"])


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 200000) AS dear FROM orders GROUP BY 1""")
def month_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 200000).alias("dear"))


@query("""SELECT family, key FROM (SELECT 'article' AS family, o_orderkey AS key, o_orderdate AS t FROM orders UNION ALL SELECT 'fact', c_custkey, TIMESTAMP '1999-01-01' FROM customer UNION ALL SELECT 'source', s_suppkey, TIMESTAMP '1998-01-01' FROM supplier) ORDER BY t DESC, family, key LIMIT 4500""")
def sitemap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.lit("article").alias("family"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("t"))
    b = table(spark, sf_dir, "customer").select(F.lit("fact").alias("family"), F.col("c_custkey").alias("key"), F.expr("timestamp '1999-01-01'").alias("t"))
    c = table(spark, sf_dir, "supplier").select(F.lit("source").alias("family"), F.col("s_suppkey").alias("key"), F.expr("timestamp '1998-01-01'").alias("t"))
    return a.unionByName(b).unionByName(c).orderBy(F.col("t").desc(), "family", "key").limit(4500).select("family", "key")
