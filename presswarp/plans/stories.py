"""Cleaning of texts, verdicts and stories over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..operators import stories as st
from ..sources.tables import table
from .registry import query

NOON = datetime(2024, 1, 30, 12)


@query()
def boilerplate_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a footer and a line of a news page added, cleaned again. Bounds that look around have no SQL in DuckDB."""
    d = table(spark, sf_dir, "documents")
    dirty = F.concat(F.lit("2024年1月30日 12:00 来源：新华社 "), "text", F.lit(" PDF(12 KB) \n© 2024 All\n版权所有 news。end （完）"))
    clean = cl.once(cl.strip_consent_wall(cl.strip_reader_chrome(cl.strip_boilerplate(dirty))), lambda x: F.struct(F.char_length(x).alias("n"), F.md5(x).alias("digest")))
    return d.select("doc_id", clean.alias("x"), cl.boilerplate_hint(F.col("text")).alias("hint")).select("doc_id", "x.*", "hint")


@query(r"""WITH d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' ⟦G12⟧' WHEN 1 THEN ' ' || repeat(chr(92) || 'u00e9', 4) WHEN 2 THEN chr(65533) || chr(7) WHEN 3 THEN chr(7) ELSE '' END AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, chr(65533)) THEN 'replacement-character' WHEN regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'control-character' WHEN regexp_matches(t, '⟦G\d+⟧') THEN 'unrestored-protected-token'
        WHEN length(regexp_replace(t, '(?s)(?:\\u[0-9a-fA-F]{4}.*?){4}', '')) <> length(t) THEN 'literal-unicode-escapes' END AS defect FROM d""")
def copy_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    end = F.when(k == 0, " ⟦G12⟧").when(k == 1, " " + "\\u00e9" * 4).when(k == 2, "�\x07").when(k == 3, "\x07").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", cl.copy_defect(F.concat("text", end)).alias("defect"))


_CLOSED = r"""CASE WHEN t = '' OR regexp_matches(t, '[。！？…!?][”』」''")）]?$') THEN t
        WHEN regexp_matches(t, '[，、；：,;:]$') THEN regexp_replace(t, '[，、；：,;:\s]+$', '') || CASE WHEN regexp_matches(t, '[：:]$') OR regexp_matches(regexp_extract(regexp_replace(t, '[，、；：,;:\s]+$', ''), '([^。！？…]*)$', 1), '[：:]$|(?:^|[\s。；;，、(（])[0-9０-９]{1,2}(?:[、)]|\.(?:[^0-9％%]|$))') THEN '……' ELSE '。' END
        WHEN regexp_matches(t, '[。！？…]') THEN regexp_extract(t, '(?s)^(.*[。！？…])', 1)
        WHEN length(regexp_extract(t, '(?s)^(.*)[，、；：,;:]', 1)) >= 30 THEN regexp_extract(t, '(?s)^(.*)[，、；：,;:]', 1) || '。' ELSE t || '。' END"""


@query(rf"""WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN '；1、x，' WHEN 1 THEN '。y：' ELSE '' END AS s FROM documents), c AS (SELECT doc_id, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS t FROM d) SELECT doc_id, md5({_CLOSED}) AS closed FROM c""")
def closed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, some with an end that breaks off, end with whole sentences or clauses."""
    k = F.col("doc_id") % 4
    text = F.concat("text", F.when(k == 0, "；1、x，").when(k == 1, "。y：").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cl.close_sentence(text)).alias("closed"))


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '。'), '^\s+', ''), '\s+$', ''), '\s*\n\s*', ' ', 'g') AS t FROM documents),
    s AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?')) AS x, generate_subscripts(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?'), 1) AS k FROM d),
    c AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM s),
    a AS (SELECT doc_id, string_agg(x, '' ORDER BY k) FILTER (upto <= 190 AND upto - length(x) < 80) AS p FROM c GROUP BY 1),
    v AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '[^，；：、,;:]+[，；：、,;:]?')) AS x, generate_subscripts(regexp_extract_all(t, '[^，；：、,;:]+[，；：、,;:]?'), 1) AS k FROM d),
    w AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM v),
    b AS (SELECT doc_id, string_agg(x, '' ORDER BY k) FILTER (upto < 190 AND upto - length(x) < 80) AS p FROM w GROUP BY 1)
    SELECT doc_id, md5(CASE WHEN length(t) <= 190 THEN {_CLOSED} WHEN length(a.p) >= 50 THEN trim(a.p) WHEN length(b.p) >= 50 THEN regexp_replace(b.p, '[，；：、,;:]$', '') || '。' ELSE t END) AS summary FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def compact_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as summaries: short ones with a whole sentence at the end, long ones as whole sentences, else as whole clauses."""
    t = F.replace(F.col("text"), F.lit(". "), F.lit("。"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cl.compact_summary(t)).alias("summary"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) || ['Ada Lovelace, Charles Babbage, Mary Somerville, et al', 'Ada Lovelace, Charles Babbage, Mary Somerville, et al'] || CASE WHEN doc_id % 2 = 0 THEN ['Ada Lovelace, Charles Babbage, Mary Somerville, et al'] ELSE [] END AS b FROM documents),
    l AS (SELECT doc_id, unnest(b) AS t, generate_subscripts(b, 1) AS k FROM d), n AS (SELECT *, length(t) >= 40 AND contains(t, ',') AND NOT regexp_matches(t, '[.。!?！？]$') AS listed, count(*) OVER (PARTITION BY doc_id, t) AS n, min(k) OVER (PARTITION BY doc_id, t) AS first FROM l)
    SELECT doc_id, count(*) FILTER (NOT (listed AND n >= 3 AND k <> first)) AS blocks, sum(k) FILTER (NOT (listed AND n >= 3 AND k <> first)) AS places FROM n GROUP BY 1""")
def unrepeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lists of names that a page repeats three times or more the first stays."""
    names = "Ada Lovelace, Charles Babbage, Mary Somerville, et al"
    more = F.when(F.col("doc_id") % 2 == 0, F.array(*[F.lit(names)] * 3)).otherwise(F.array(*[F.lit(names)] * 2))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.concat(F.split("text", "\n", -1), more)).alias("k", "t"))
    kept = st.unrepeated_blocks(lines, "doc_id", "k", "t", cl.name_list(F.col("t")), cl.COPIES_OF_CHROME)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("k") + 1).alias("places"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) || CASE doc_id % 3 WHEN 0 THEN ['Topics', 'Subscribe for the news', 'Latest in AI'] WHEN 1 THEN ['Topics', 'Subscribe now.', 'Read next'] ELSE [] END AS b FROM documents),
    l AS (SELECT doc_id, len(b) AS n, list_transform(b, lambda t: regexp_matches(t, '(?i)^(topics|tags?|latest in [\\p{L}\\s&-]{1,30}|latest (news|stories)|most (popular|read)|related (articles|posts|stories|content|reading|coverage)|more (stories|articles|news)|keep reading|read next|up next|you (might|may) also like|recommended( for you)?|(subscribe|sign up)\\b.{0,80}|share (this|on)\\b.{0,40}|follow us\\b.{0,40}|advertisement)$') AND NOT regexp_matches(t, '[.。!！?？:：]$')) AS c FROM d)
    SELECT doc_id, greatest(1, CASE WHEN list_contains(c, false) THEN n - list_position(list_reverse(c), false) + 1 ELSE 1 END) AS blocks FROM l""")
def trimmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the calls to action at their end."""
    k = F.col("doc_id") % 3
    words = lambda *x: F.array(*map(F.lit, x))
    ends = F.when(k == 0, words("Topics", "Subscribe for the news", "Latest in AI")).when(k == 1, words("Topics", "Subscribe now.", "Read next")).otherwise(F.array().cast("array<string>"))
    blocks = F.transform(F.concat(F.split("text", "\n", -1), ends), lambda t: F.struct(t.alias("text"), F.lit(False).alias("media")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(cl.trim_blocks(blocks)).alias("blocks"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '2024-01-30T12:00:00Z' WHEN 1 THEN '2024-01-29' ELSE '2024-01-28' END AS published, CASE WHEN page_id % 2 = 0 THEN ['/feed.xml?a=1&b=2', 'https://e.com/atom'] ELSE [] END AS feeds,
        md5('<figure><img src="a"></figure><figure><img src="b"></figure>' || html) AS body FROM pages""")
def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a page came out, its feeds, and its body without figures that repeat."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 3
    meta = F.when(k == 0, '<meta property="article:published_time" content="2024-01-30T12:00:00Z">').otherwise("")
    ld = F.when(k < 2, '<script type="application/ld+json">{"datePublished" : "2024-01-29"}</script>').otherwise("")
    time = F.lit('<time datetime="2024-01-28">28 January</time>')
    feed = F.when(F.col("page_id") % 2 == 0, '<link rel="alternate" type="application/rss+xml" href="/feed.xml?a=1&amp;b=2"><LINK type="application/atom+xml" href="https://e.com/atom" REL="x alternate"/><link rel="stylesheet" type="text/css" href="/a.css">').otherwise("")
    head = F.concat(time, ld, meta, feed, "html")
    body = F.concat(F.lit('<figure><img src="a"></figure>\n<figure><img src="a"></figure><figure><img src="b"></figure>'), "html")
    return p.select("page_id", cl.page_published(head).alias("published"), cl.feed_links(head).alias("feeds"), F.md5(cl.single_figures(body)).alias("body"))


_VERDICT = "CASE {0} % 5 WHEN 0 THEN 'SAME_OCCURRENCE' WHEN 1 THEN 'SAME_STORY' WHEN 2 THEN 'ROUNDUP' WHEN 3 THEN 'UNRELATED' END"


def _verdict(key: str):
    k = F.col(key) % 5
    return F.when(k == 0, "SAME_OCCURRENCE").when(k == 1, "SAME_STORY").when(k == 2, "ROUNDUP").when(k == 3, "UNRELATED")


@query(f"""WITH c AS (SELECT DISTINCT l_orderkey AS post, l_partkey AS fact, l_partkey % 3 = 0 AS root, (l_partkey % 50) / 50.0 AS score FROM lineitem),
    v AS (SELECT post, fact, {_VERDICT.format("(post + fact)")} AS relation, CAST((fact % 11) / 10.0 AS DOUBLE) AS confidence FROM c), e AS (SELECT c.*, coalesce(relation, 'UNRELATED') AS relation, CASE WHEN relation IS NULL THEN 0.0 ELSE confidence END AS confidence FROM c JOIN v USING (post, fact)),
    a AS (SELECT post, first(fact ORDER BY confidence DESC, score DESC, fact) FILTER (relation = 'SAME_OCCURRENCE') AS same, first(fact ORDER BY score DESC, fact) FILTER (relation = 'SAME_STORY' AND root) AS joins, bool_and(relation = 'ROUNDUP') AS roundup,
        first(fact ORDER BY score DESC, fact) FILTER (relation = 'SAME_STORY' AND confidence >= 0.8) AS reaction FROM e GROUP BY 1)
    SELECT post, same, joins, roundup, coalesce(same, reaction) AS reacts FROM a""")
def post_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on candidates: what a post reports, whose story it joins, whether it is a roundup, what it reacts to."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post"), F.col("l_partkey").alias("fact"))
    tasks = st.tasks_for(spark, 3 * lines.count())
    lines = st.dealt(lines, tasks)
    c = lines.withColumn("root", F.col("fact") % 3 == 0).withColumn("score", F.col("fact") % 50 / 50)
    v = lines.withColumn("k", F.col("post") + F.col("fact")).select("post", "fact", "share", _verdict("k").alias("relation"), (F.col("fact") % 11 / 10).alias("confidence"))
    v = v.withColumn("at", F.when(F.col("relation").isNotNull(), 1))
    later = v.withColumn("relation", F.lit("SAME_OCCURRENCE")).withColumn("at", F.col("at") + 1)
    return st.judged(c, v.unionByName(later), tasks)


_ROOTS = """r AS (SELECT o_orderkey AS story, o_custkey AS grp, o_orderdate AS t_, o_orderstatus = 'P' AS roundup FROM orders), n AS (SELECT * FROM r WHERE NOT roundup),
    a AS (SELECT grp, first(story ORDER BY t_, story) AS into_ FROM n GROUP BY 1), p AS (SELECT story AS from_, into_ FROM n JOIN a USING (grp) WHERE story <> into_)"""


def _consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "story", "o_custkey": "grp", "o_orderdate": "at"}).withColumn("roundup", F.col("o_orderstatus") == "P")
    anchor = o.filter("not roundup").groupBy("grp").agg(F.min(F.struct("at", "story"))["story"].alias("into"))
    pairs = o.join(anchor, "grp").select(F.col("story").alias("from"), "into")
    first = pairs.select("from", "into", _verdict("from").alias("relation"), (F.col("from") % 11 / 10).alias("confidence"))
    second = pairs.select("from", "into", _verdict("into").alias("relation"), (F.col("into") % 21 / 20).alias("confidence"))
    return st.consolidations(o, first, second)


_MERGES = f"""{_ROOTS}, f AS (SELECT from_, into_, {_VERDICT.format("from_")} AS first, {_VERDICT.format("into_")} AS second FROM p),
    t AS (SELECT *, coalesce(first IN ('SAME_OCCURRENCE', 'SAME_STORY') AND (from_ % 11) / 10 >= 0.8, false) AS tied FROM f),
    m AS (SELECT from_, into_, tied AND coalesce(second IN ('SAME_OCCURRENCE', 'SAME_STORY') AND (into_ % 21) / 20 >= 0.75, false) AS merge, first, CASE WHEN tied THEN second END AS second FROM t)"""


@query(f'WITH {_MERGES} SELECT from_ AS "from", into_ AS "into", merge, first, second FROM m')
def story_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of a group against its earliest: two readings must tie them."""
    return _consolidated(spark, sf_dir)


_STORIES = "s AS (SELECT o_orderkey AS story, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 END AS merged_into, 1 AS version, o_orderdate AS first_at, o_orderdate + INTERVAL 3 DAY AS latest_at FROM orders)"
_USABLE = "u AS (SELECT from_, into_ FROM m JOIN s x ON x.story = from_ JOIN s y ON y.story = into_ WHERE merge AND x.merged_into IS NULL AND y.merged_into IS NULL)"


@query(f"""WITH {_MERGES}, {_STORIES}, {_USABLE}, e AS (SELECT into_, min(first_at) AS f, max(latest_at) AS l FROM u JOIN s ON story = from_ GROUP BY 1)
    SELECT s.story, coalesce(u.into_, merged_into) AS merged_into, version + CASE WHEN u.from_ IS NOT NULL OR e.into_ IS NOT NULL THEN 1 ELSE 0 END AS version, epoch_us(least(first_at, f)) AS first_us, epoch_us(greatest(latest_at, l)) AS latest_us FROM s LEFT JOIN u ON u.from_ = s.story LEFT JOIN e ON e.into_ = s.story""")
def story_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, merges = _stories_and_merges(spark, sf_dir)
    return st.merged_stories(s, merges).select("story", "merged_into", "version", F.unix_micros("first_at").alias("first_us"), F.unix_micros("latest_at").alias("latest_us"))


def _stories_and_merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    late = F.timestamp_micros(F.unix_micros("o_orderdate") + 3 * 86_400_000_000)
    s = o.select(F.col("o_orderkey").alias("story"), F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderkey") - 1).alias("merged_into"), F.lit(1).alias("version"), F.col("o_orderdate").alias("first_at"), late.alias("latest_at"))
    return s, st.usable_merges(_consolidated(spark, sf_dir).filter("merge"), s)


@query(f"""WITH {_MERGES}, {_STORIES}, {_USABLE}, g AS (SELECT l_orderkey AS story, l_partkey AS article, min(l_quantity) AS weight FROM lineitem GROUP BY ALL)
    SELECT coalesce(into_, story) AS story, article, first(weight ORDER BY into_ IS NOT NULL, story) AS weight FROM g LEFT JOIN u ON from_ = story GROUP BY 1, 2""")
def story_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of merged stories move with them."""
    _, merges = _stories_and_merges(spark, sf_dir)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story"), F.col("l_partkey").alias("article")).agg(F.min("l_quantity").alias("weight"))
    return st.moved_signals(g, merges, ["weight"])


@query("""WITH p AS (SELECT user_id AS story, event_id % 400 AS fact, event_id AS article, event_type = 'error' AS first_party, value AS score, ts AS t_ FROM events), s AS (SELECT * FROM p WHERE score >= 40),
    n AS (SELECT fact, count(DISTINCT article) AS n FROM p WHERE score >= 20 GROUP BY 1), f AS (SELECT story, fact, min(t_) AS first_at, first(article ORDER BY first_party DESC, score DESC, t_, article) AS representative FROM s GROUP BY ALL)
    SELECT story, fact, representative, n AS reports, row_number() OVER (PARTITION BY story ORDER BY first_at DESC, fact) AS place FROM f JOIN n USING (fact)""")
def story_developments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("story"), (F.col("event_id") % 400).alias("fact"), F.col("event_id").alias("article"), (F.col("event_type") == "error").alias("first_party"), F.col("value").alias("score"), F.col("ts").alias("at"))
    return st.developments(p.filter("score >= 40"), p.filter("score >= 20").select("fact", "article"))


@query("""WITH p AS (SELECT event_id AS article, event_type = 'click' AS selected, CASE WHEN user_id % 4 = 0 THEN ts END AS decided, CASE WHEN event_id % 6 = 0 THEN 'hidden' ELSE 'public' END AS visibility, CASE WHEN value < 60 THEN 'full' ELSE 'summary' END AS body_mode, ts, CASE WHEN event_id % 2 = 0 THEN ts END AS visible_after FROM events),
    x AS (SELECT * FROM p WHERE visibility = 'public' AND decided IS NULL AND ts >= TIMESTAMP '2024-01-29 00:00:00')
    SELECT article, true AS selected, epoch_us(coalesce(visible_after, TIMESTAMP '2024-01-30 12:00:00')) AS visible_us FROM x WHERE NOT selected AND body_mode = 'full' AND article % 5 <> 0 UNION ALL SELECT article, false, epoch_us(visible_after) FROM x WHERE selected AND body_mode <> 'full'""")
def selection_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes into and goes out of the selection of the last 36 hours."""
    e, even = table(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    rows = e.select(
        F.col("event_id").alias("article"), (F.col("event_type") == "click").alias("selected"), F.when(F.col("user_id") % 4 == 0, F.col("ts")).alias("selected_ready_at"), F.when(F.col("event_id") % 6 == 0, "hidden").otherwise("public").alias("visibility"),
        F.when(F.col("value") < 60, "full").otherwise("summary").alias("body_mode"), F.col("ts").alias("timeline_at"), F.when(even, F.col("ts")).alias("visible_after"),
    )
    ready = e.select(F.col("event_id").alias("article"), (F.col("event_id") % 5 != 0).alias("ready"))
    return st.selection_changes(rows, ready, NOON).select("article", "selected", F.unix_micros("visible_after").alias("visible_us"))


@query("""WITH i AS (SELECT l_orderkey AS report, l_linenumber * 1000000 + l_partkey AS place, l_partkey AS item, 'part ' || l_partkey AS title FROM lineitem), k AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = item AND p_size < 25)),
    f AS (SELECT report, min_by(title, place) AS title FROM k GROUP BY 1) SELECT o_orderkey AS report, coalesce(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, title) AS headline FROM orders LEFT JOIN f ON report = o_orderkey""")
def report_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's own headline, else that of its first item that was not withdrawn."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("").alias("headline"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"), F.col("l_partkey").alias("item"), F.concat(F.lit("part "), "l_partkey").alias("title"))
    return st.headlines(o, i, table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("item")))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(DISTINCT page_id % 3) AS engines, min(page_id) AS best_rank FROM pages GROUP BY 1 HAVING host <> ''""")
def discovered_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several engines by host."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), (F.col("page_id") % 3).alias("engine"), F.col("page_id").alias("rank"))
    return st.merged_hosts(p)
