"""Queries over the HTML of ``pages``: readable parts, allowed tags, listings by selectors, JSON in scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import markup as mk
from ..sources.tables import table
from .registry import query
from .text import STRIPPED


def _plain(sql: str) -> str:
    return STRIPPED.replace("regexp_replace(html,", f"regexp_replace({sql},", 1)


@query(rf"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>|</p>|</h1>') AS parts FROM pages),
    t AS (SELECT page_id, trim(regexp_replace(regexp_replace({_plain("a")}, '(?i)Copyright[^。；;\n]{{0,120}}|All rights reserved', ' ', 'g'), '\s+', ' ', 'g')) AS body, len(list_filter(parts, lambda p: length(trim(regexp_replace(replace(replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '\s+', ' ', 'g'))) >= 25 AND NOT starts_with(p, '<h1>'))) AS paragraphs FROM a)
    SELECT page_id, CASE WHEN length(body) >= 120 AND paragraphs > 0 THEN md5(body) END AS body, CASE WHEN length(body) >= 120 AND paragraphs > 0 THEN 0 END AS images FROM t""")
def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each page: neither its navigation, promotions nor footer; none for stubs."""
    found = mk.readable(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.md5(tx.collapse(F.col("body_text"))).alias("body"), F.when(F.col("images").isNotNull(), F.size("images")).alias("images"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS site, regexp_replace(regexp_extract(html, '(?s)<body>(.*?)(?:</body>|$)', 1), '(?s)<!--.*?-->|</?nav>|</?article>', '', 'g') AS h FROM pages),
    c AS (SELECT page_id, site, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '<div class="ad">|<footer>', '<p>', 'g'), '</div>|</footer>', '</p>', 'g'), '<(/?)h1>', '<\1h2>', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS h FROM b)
    SELECT page_id, md5(replace(regexp_replace(regexp_replace(regexp_replace(h, '<p><b>([^<]*)<br>', '<p><b>\1<br></b></p>', 'g'), '</b></p>([^<]+)</p>', '</b>\1</p>', 'g'), '<p>\s*</p>', '', 'g'), 'href="/', 'href="' || site || '/')) AS clean FROM c""")
def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.sanitised(table(spark, sf_dir, "pages"), "html", "url").select("page_id", F.md5("clean").alias("clean"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS site, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS params, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles FROM pages),
    l AS (SELECT page_id, site, path, params, unnest(list_zip(hrefs, titles, range(len(hrefs)))) AS x FROM p),
    u AS (SELECT page_id, CAST(x[3] AS INTEGER) AS position, site || x[1] AS url, trim(x[2]) AS title, row_number() OVER (PARTITION BY page_id, x[1] ORDER BY x[3]) AS nth FROM l WHERE trim(x[2]) <> '' AND NOT (rtrim(x[1], '/') = rtrim(path, '/') AND params = ''))
    SELECT page_id, position, md5(url) AS url, title FROM u WHERE nth = 1 AND NOT regexp_matches(url, '(?i)^[a-z]+://[^/]*/(de|the)(/|$)')""")
def listed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the navigation of each page lists, by selectors; two addresses are denied."""
    found = mk.listing(table(spark, sf_dir, "pages"), "html", "url", item="nav > ul li", link="a[href]").select("page_id", F.inline("items"))
    kept = found.filter(~mk.is_taxonomy(F.col("url")) & ~F.col("url").rlike("(?i)^[a-z]+://[^/]*/(de|the)(/|$)"))
    return kept.select("page_id", "position", F.md5("url").alias("url"), "title")


@query(r"""SELECT page_id, page_id * 7 AS first, 'a ]} "' || page_id AS second, CASE WHEN page_id % 3 <> 2 THEN 2 END AS rows, CASE page_id % 3 WHEN 0 THEN 'k' || page_id WHEN 1 THEN 'k' || page_id END AS name FROM pages""")
def script_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable's object whose strings hold brackets and quotes, and the list of a key in a script: JSON itself, or pushed as a string."""
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit('a ]} "'), F.col("page_id"))
    state = F.to_json(F.struct((F.col("page_id") * 7).alias("n"), F.struct(text.alias("t")).alias("deep"), F.array(F.lit(1), F.lit(2)).alias("list")))
    tree = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("k"), "page_id").alias("name")), F.struct(F.lit("z").alias("name"))).alias("posts")).alias("c"))).alias("b")).alias("a")))
    pushed = F.substring(F.to_json(F.array(tree)), 2, 1 << 30)
    script = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script id="__DATA__" type="application/json">'), tree, F.lit("</script>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<script>self.push([1,"), pushed, F.lit(")</script>"))).otherwise("")
    page = F.concat(F.lit("<script>var x = 1; window.__STATE__ = "), state, F.lit("; go('}');</script>"), "html", script)
    found = mk.script_json(mk.script_json(p.select("page_id", page.alias("html")), variable="__STATE__", out="state"), key="posts", out="posts")
    items = F.from_json("posts", "array<struct<name string>>")
    return found.select("page_id", F.get_json_object("state", "$.n").cast("bigint").alias("first"), F.get_json_object("state", "$.deep.t").alias("second"), F.when(items.isNotNull(), F.size(items)).alias("rows"), F.get(items, F.lit(0))["name"].alias("name"))
