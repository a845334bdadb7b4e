"""The developments of a story, and pages of them whose cursors hold for one query and one state of the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

REVISION, BINDING = 10, 12  # hex digits
PREFIX = "dv1"


def developments(members: DataFrame, counts: DataFrame, facts: DataFrame) -> DataFrame:
    """members: (story_id, fact_id, article_id, first_party, body_mode, score, timeline_at, sort_at) of the selected publications that match a reader's filters; counts: (fact_id,
    reports), public reports of a fact; facts: (fact_id, title, occurred_at). A row a development: the fact, its representative (first-party, full text, score, earliest, id), how
    many reports it has, and its place in the story: by its first report, the latest first, then by the fact's id. ``revision`` changes with the list.

    Members without a fact are in none. A story's facts meet in one task, as short lines of ids; articles never do.
    """
    at = F.coalesce("sort_at", "timeline_at")
    better = F.struct(~F.coalesce("first_party", F.lit(False)), F.coalesce("body_mode", F.lit("")) != "full", -F.coalesce("score", F.lit(-1.0)), F.col("timeline_at"), F.col("article_id"))
    each = members.filter("fact_id is not null").groupBy("story_id", "fact_id").agg(F.min(at).alias("first_at"), F.min_by("article_id", better).alias("representative"), F.count_distinct("article_id").alias("own"))
    rows = each.join(counts.select("fact_id", "reports"), "fact_id", "left").withColumn("reports", F.coalesce("reports", "own")).drop("own")
    order = Window.partitionBy("story_id").orderBy(F.col("first_at").desc(), F.col("fact_id").cast("string"))
    rows = rows.withColumn("place", F.row_number().over(order))
    line = F.struct("place", F.concat_ws(":", "fact_id", "representative", "reports").alias("line"))
    lists = rows.groupBy("story_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count(F.lit(1)).alias("size"))
    lists = lists.select("story_id", "size", F.substring(F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), ","), 256), 1, REVISION).alias("revision"))
    return rows.join(lists, "story_id").join(facts, "fact_id", "left")


def binding(*parts: Column) -> Column:
    """What a cursor is bound to: a digest of a query's parts, nulls told from empty ones."""
    return F.substring(F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256), 1, BINDING)


def cursor(offset: Column, revision: Column, bound: Column) -> Column:
    return rules.cursor(PREFIX, F.struct(offset.cast("bigint").alias("o"), revision.alias("r"), bound.alias("b")))


def read(text: Column, revision: Column, bound: Column) -> Column:
    """(outcome, offset): start without a cursor, ok, changed if the list is another than then, invalid if it is no cursor, of another query, or no offset."""
    c = rules.read_cursor(PREFIX, text, "o bigint, r string, b string")
    outcome = F.when(text.isNull(), "start").when(c.isNull() | ~c["b"].eqNullSafe(bound) | ~F.coalesce(c["o"] >= 0, F.lit(False)), "invalid").when(~c["r"].eqNullSafe(revision), "changed").otherwise("ok")
    return F.struct(outcome.alias("outcome"), F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(c["o"]).alias("offset"))


def page(rows: DataFrame, requests: DataFrame, take: int, *parts: str) -> DataFrame:
    """rows: ``developments``; requests: (request_id, story_id, cursor, parts...), one row a reader's question. A row for each development of the page, or one without any where the
    story has none (missing), or the cursor says changed or invalid; ``next`` is the cursor of the page after, null on the last."""
    stories = rows.select("story_id", "revision", "size").distinct()
    bound = binding(F.col("story_id"), *map(F.col, parts))
    asked = requests.join(stories, "story_id", "left").withColumn("_b", bound).withColumn("_c", read(F.col("cursor"), F.col("revision"), F.col("_b")))
    outcome = F.when(F.col("size").isNull(), "missing").otherwise(F.col("_c.outcome"))
    after = F.col("_c.offset") + take
    asked = asked.select("request_id", "story_id", "revision", outcome.alias("outcome"), F.col("_c.offset").alias("offset"), F.when(outcome.isin("start", "ok") & (after < F.col("size")), cursor(after, F.col("revision"), F.col("_b"))).alias("next"))
    shown = rows.select("story_id", "fact_id", "representative", "reports", "place")
    on = (asked["story_id"] == shown["story_id"]) & F.col("outcome").isin("start", "ok") & (F.col("place") > F.col("offset")) & (F.col("place") <= F.col("offset") + take)
    return asked.join(shown, on, "left").select("request_id", asked["story_id"], "revision", "outcome", "next", "place", "fact_id", "representative", "reports")
