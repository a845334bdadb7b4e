"""Text, URL and similarity queries over ``documents``, ``pages`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import text as tx
from ..functions import urls
from ..operators import similarity as sim
from ..sources.tables import table
from .registry import query


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean, CASE WHEN length(text) <= 50 THEN text ELSE rtrim(substr(text, 1, 49)) || '…' END AS short FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("clean"), tx.truncate(F.col("text"), 50).alias("short"))


STRIPPED = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<noscript.*?</noscript>', ' ', 'g'), '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|blockquote|pre|tr)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {STRIPPED} AS plain FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query(rf"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS html FROM pages) SELECT page_id, CAST(substr(html, 3, 1) AS INTEGER) AS level, {STRIPPED} AS text FROM h""")
def heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.inline(tx.headings(F.col("html"))))


@query(rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>')) AS html FROM pages) SELECT page_id, regexp_extract(html, '(?is)href=["'']([^"'']+)', 1) AS url, {STRIPPED} AS title FROM a""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.inline(tx.html_links(F.col("html"))))


@query(r"""WITH s AS (SELECT doc_id, substr(text, 1, 40) || chr(10) || substr(text, 1, 2000) AS t FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')) AS cjk, len(regexp_extract_all(t, '[A-Za-z\x{c0}-\x{24f}]')) AS latin FROM s)
    SELECT doc_id, CASE WHEN cjk + latin < 12 THEN NULL WHEN cjk / (cjk + latin) >= 0.5 THEN 'zh' WHEN cjk / (cjk + latin) <= 0.02 AND latin >= 25 THEN 'en' END AS script FROM n""")
def language_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.infer_language(F.substring("text", 1, 40), F.col("text")).alias("script"))


@query()
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 40).alias("title")), "title", "text")
    return d.select("doc_id", F.when(F.size("reasons") > 0, "defect").otherwise("ok").alias("status"), F.array_join("reasons", ",").alias("reasons"))


@query(r"""SELECT doc_id, regexp_matches(trim(text), '(?i)(?:…|\.{3})\s*This article was originally published on Mongabay\.?\s*$') OR length(trim(text)) < 1200 AND (regexp_matches(trim(text), '(?i)\bappeared first on\b') OR regexp_matches(trim(text), '(?i)\bread (?:the )?full (?:story|article)\b') OR regexp_matches(trim(text), '(?i)\bcontinue reading\b')
    OR regexp_matches(trim(text), '(?i)\bread more\b') OR regexp_matches(trim(text), '…\s*$') OR regexp_matches(trim(text), '\[\s*(?:…|\.\.\.)\s*\]\s*$')) AS teaser FROM documents""")
def teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_teaser(F.col("text")).alias("teaser"))


@query()
def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as models read them. What goes with the footers has no SQL in DuckDB."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cl.model_text(F.col("text"))).alias("clean"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '(?i)^https?://[^/?#:]+(?::\d*)?([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
    q AS (SELECT page_id, host, path, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_[a-z]+|ref|from|source)$'))), '&') AS query FROM p)
    SELECT page_id, CASE WHEN path IN ('', '/') THEN 'https://' || host || '/' || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE regexp_replace('https://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '/$', '') END AS canonical FROM q""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise(F.col("url")).alias("canonical"))


@query(r"SELECT regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH k AS (SELECT page_id, regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#:]+([^?#]*)', 1), '/$', '') AS key FROM pages) SELECT key, min(page_id) AS page_id, count(*) AS arrivals FROM k GROUP BY key""")
def identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the same path (whatever the host's alias) are one material; the first arrival stands for it."""
    k = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(urls.part(F.col("url"), 4), "/$", "").alias("key"))
    return sim.first_by_identity(k, "key", ["page_id"])


@query("""WITH r AS (SELECT user_id, event_type || CAST(floor(value / 25) AS BIGINT) AS content, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, content, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS revision FROM r""")
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.floor(F.col("value") / 25).cast("bigint").cast("string")).alias("content"))
    return sim.revisions(e, "user_id", ["event_id"], "content").select("user_id", "content", F.col("revision").cast("bigint").alias("revision"))


@query("""WITH a(alias, target) AS (SELECT DISTINCT 'seg:' || c_mktsegment, c_mktsegment FROM customer UNION SELECT DISTINCT 'nat:' || c_nationkey, CASE WHEN c_nationkey < 15 THEN 'BUILDING' ELSE 'MACHINERY' END FROM customer),
    h AS (SELECT c_custkey, target FROM customer JOIN a ON alias IN ('seg:' || c_mktsegment, 'nat:' || c_nationkey))
    SELECT c_custkey AS id, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, count(DISTINCT target) > 1 AS conflict FROM h GROUP BY c_custkey""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    seg, nat = F.concat(F.lit("seg:"), "c_mktsegment"), F.concat(F.lit("nat:"), "c_nationkey")
    aliases = c.select(seg.alias("alias"), F.col("c_mktsegment").alias("target")).unionByName(c.select(nat.alias("alias"), F.when(F.col("c_nationkey") < 15, "BUILDING").otherwise("MACHINERY").alias("target"))).distinct()
    return sim.resolve_aliases(c.select(F.col("c_custkey").alias("id"), F.array(seg, nat).alias("keys")), aliases)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS id, e.vec_id % 60 AS fact, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
    b AS (SELECT * FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query, fact ORDER BY score DESC, id) = 1)
    SELECT query, fact, id, round(score, 5) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, fact) <= 10""")
def cosine_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 60).alias("fact"))
    return sim.vector_recall(e.filter("id % 20 = 0"), e, 0.2).select("query", "fact", "id", F.round("score", 5).alias("score"))


@query("""SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.max(F.struct(F.get("embedding", F.lit(0)).alias("x"), (-F.col("vec_id")).alias("m"))).alias("b")).select("label", (-F.col("b.m")).alias("vec_id"))


@query(r"""WITH c AS (SELECT doc_id AS id, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS c FROM documents),
    g AS MATERIALIZED (SELECT id, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS g FROM c WHERE len(c) > 1),
    e AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS x FROM g), s AS (SELECT q.id AS a, r.id AS b, count(*) / least(any_value(q.n), any_value(r.n)) AS score FROM e q JOIN e r ON q.x = r.x AND q.id % 20 = 0 AND q.id <> r.id GROUP BY 1, 2)
    SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10""")
def bigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten texts that share most with each query text (ids divisible by 20), over whole texts and all rows."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("fact"))
    return sim.lexical_recall(t.filter("id % 20 = 0"), t).select(F.col("query").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') FROM benchmark),
    g AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)), z AS (SELECT id AS item, count(*) AS size FROM g WHERE kind = 'b' GROUP BY id)
    SELECT d.id, b.id AS item, count(*) AS shared, round(count(*) / any_value(size), 6) AS share FROM g d JOIN g b ON d.kind = 'd' AND b.kind = 'b' AND d.g = b.g JOIN z ON z.item = b.id GROUP BY d.id, b.id""")
def ngram_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sim.ngram_contamination(d, b).withColumn("share", F.round("share", 6))


SCORED = "s AS (SELECT CAST(least(100, n_chars // 40) AS INTEGER) AS score, quality AS truth FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {SCORED}, t AS (SELECT CAST(unnest(range(40, 91, 2)) AS INTEGER) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp, count(*) FILTER (score < threshold AND truth = 1) AS fn, count(*) FILTER (score < threshold AND truth = 0) AS tn FROM s, t GROUP BY threshold)
    SELECT threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = d.join(labels, "doc_id").select(F.least(F.lit(100), F.floor(F.col("n_chars") / 40)).cast("int").alias("score"), F.col("quality").alias("truth"))
    out = sim.thresholds(s, list(range(40, 91, 2)))
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(substr(text, 1, 20) || doc_id), '([a-z])([0-9])', '\1-\2', 'g'), '([0-9])([a-z])', '\1-\2', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
    sha256(concat_ws(chr(1), source, text, lang)) AS content, greatest(1, CAST(floor(length(text) / 450 + 0.5) AS INTEGER)) AS minutes FROM documents""")
def slugs_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.model_slug(F.concat(F.substring("text", 1, 20), "doc_id")).alias("slug"), tx.content_hash(F.col("source"), F.col("text"), F.col("lang")).alias("content"), tx.reading_minutes(F.col("text")).alias("minutes"))
