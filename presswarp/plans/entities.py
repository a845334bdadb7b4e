"""Queries of names in texts: a lexicon from ``benchmark``, looked for in all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as en
from ..sources.tables import table
from .registry import query

#: Names are two words of each item that follow one another; several items may give one name.
_LEXICON = r"""i AS (SELECT item_id, regexp_extract_all(text, '[^ \t-\r]+') AS w FROM benchmark),
    x AS (SELECT DISTINCT item_id % 25 AS entity, name FROM (SELECT item_id, unnest([w[1] || ' ' || w[2], w[3] || ' ' || w[4], w[6] || ' ' || w[7] || ' ' || w[8]]) AS name FROM i) WHERE regexp_matches(name, '^[A-Za-z]+[a-z]( [A-Za-z]*[a-z])+$'))"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0))
    at = lambda k: F.get(w, F.lit(k - 1))
    names = F.array(F.concat(at(1), F.lit(" "), at(2)), F.concat(at(3), F.lit(" "), at(4)), F.concat(at(6), F.lit(" "), at(7), F.lit(" "), at(8)))
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 25).alias("entity"), F.explode(names).alias("name"))
    return rows.filter(F.col("name").rlike("^[A-Za-z]+[a-z]( [A-Za-z]*[a-z])+$")).distinct()


@query(rf"""WITH {_LEXICON}, d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    m AS (SELECT DISTINCT doc_id, CAST(entity AS VARCHAR) AS entity FROM d JOIN x ON contains(t, name) AND regexp_matches(t, '(^|[^A-Za-z0-9])' || name || '([^A-Za-z0-9]|$)'))
    SELECT doc_id, coalesce(entities, '') AS entities FROM documents LEFT JOIN (SELECT doc_id, string_agg(entity, ',' ORDER BY entity) AS entities FROM m GROUP BY 1) USING (doc_id)""")
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that each whole text names."""
    found = en.named(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon(spark, sf_dir), {"entities": "text"})
    return found.select("doc_id", F.array_join("entities", ",").alias("entities"))


@query(rf"""WITH {_LEXICON}, e AS (SELECT CAST(entity AS VARCHAR) AS entity, min(name) AS name FROM x GROUP BY 1), pick AS (SELECT *, row_number() OVER (ORDER BY CAST(entity AS INTEGER)) - 1 AS k, count(*) OVER () AS n FROM e),
    d AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, doc_id % (SELECT max(n) FROM pick) AS k FROM documents),
    c AS (SELECT d.*, CASE WHEN doc_id % 3 = 0 THEN 'About ' || name || '.' ELSE 'About nothing.' END AS title, CASE WHEN doc_id % 4 = 0 THEN name || ' it was.' ELSE 'It was.' END AS summary FROM d JOIN pick USING (k)),
    hit(doc_id, part, entity) AS (SELECT doc_id, 'in', entity FROM (SELECT DISTINCT doc_id, CAST(entity AS VARCHAR) AS entity FROM d JOIN x ON contains(t, name) AND regexp_matches(t, '(^|[^A-Za-z0-9])' || name || '([^A-Za-z0-9]|$)'))
        UNION SELECT doc_id, 'title', CAST(entity AS VARCHAR) FROM c JOIN x ON regexp_matches(title, '(^|[^A-Za-z0-9])' || x.name || '([^A-Za-z0-9]|$)')
        UNION SELECT doc_id, 'summary', CAST(entity AS VARCHAR) FROM c JOIN x ON regexp_matches(summary, '(^|[^A-Za-z0-9])' || x.name || '([^A-Za-z0-9]|$)')),
    allowed AS (SELECT doc_id, entity FROM hit WHERE part = 'in' UNION SELECT doc_id, '3' FROM documents WHERE doc_id % 5 = 0 UNION SELECT doc_id, CAST(doc_id % 25 AS VARCHAR) FROM documents WHERE doc_id % 7 = 0),
    bad AS (SELECT doc_id, part, string_agg(entity, ',' ORDER BY entity) AS entities FROM hit WHERE part <> 'in' AND NOT EXISTS (FROM allowed a WHERE a.doc_id = hit.doc_id AND a.entity = hit.entity) GROUP BY 1, 2)
    SELECT c.doc_id, CASE WHEN b.entities IS NULL THEN title ELSE '' END AS guarded_title, CASE WHEN s.entities IS NULL THEN summary ELSE '' END AS guarded_summary, CASE WHEN coalesce(b.entities, s.entities) IS NULL THEN 'pass' ELSE 'fallback' END AS outcome, coalesce(b.entities, '') AS title_unsupported, coalesce(s.entities, '') AS summary_unsupported
    FROM c LEFT JOIN bad b ON b.doc_id = c.doc_id AND b.part = 'title' LEFT JOIN bad s ON s.doc_id = c.doc_id AND s.part = 'summary'""")
def identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that name what their texts, publishers and owners don't: titles and summaries give way."""
    names = lexicon(spark, sf_dir)
    entity = F.col("entity").cast("string")
    # a row an entity: at most 25
    listed = names.groupBy(entity.alias("entity")).agg(F.min("name").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("entity").cast("int").alias("k"), "name"))).alias("listed"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(listed))
    k = F.col("doc_id")
    name = F.get("listed", (k % F.size("listed")).cast("int"))["name"]
    d = d.withColumns({
        "title": F.when(k % 3 == 0, F.concat(F.lit("About "), name, F.lit("."))).otherwise("About nothing."), "summary": F.when(k % 4 == 0, F.concat(name, F.lit(" it was."))).otherwise("It was."),
        "url": F.when(k % 5 == 0, "https://www.news.example.org/a").otherwise("https://example.com/b"), "owner": F.when(k % 7 == 0, (k % 25).cast("string")), "original": F.lit("An original title"),
    }).drop("listed")
    found = en.guarded(d, names, ["text"], "title", "summary", "original", "url", "owner", {"example.org": "3"})
    return found.select("doc_id", "guarded_title", "guarded_summary", "outcome", F.array_join("title_unsupported", ",").alias("title_unsupported"), F.array_join("summary_unsupported", ",").alias("summary_unsupported"))
