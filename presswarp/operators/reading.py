"""Reading surfaces: pages, groups, search, topics, calendars, editions, and the change log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MOST_PAGES, MOST_TERMS, MOST_COUNTED = 40, 50, 6, 2000


def offset_page(rows: DataFrame, order: list[Column], page: int, size: int = PAGE) -> DataFrame:
    page = min(max(page, 1), MOST_PAGES)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def keyset_page(rows: DataFrame, time: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """Newest first, from below (time, key); one row more than the page tells whether there is a next one."""
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return rows.orderBy(F.col(time).desc(), F.col(key).desc()).limit(size + 1)


def capped_count(rows: DataFrame, most: int = MOST_COUNTED) -> DataFrame:
    return rows.limit(most).agg(F.count(F.lit(1)).alias("n"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str | None = None) -> DataFrame:
    """The first k rows of each key in a total order (Spark bounds the candidates before the shuffle)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn(name or "__place", place).filter(F.col(name or "__place") <= k)
    return out if name else out.drop("__place")


def search_terms(q: str) -> list[str]:
    return q.lower().split()[:MOST_TERMS]


def relevance(rows: DataFrame, terms: list[str], title: Column, direct: Column, body: Column) -> DataFrame:
    """Rows in which every term is found, with score = sum of 6 for the title, 3 for the direct text, 1 for the body."""
    score, fits = F.lit(0), F.lit(True)
    for term in terms:
        t, d, b = (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term)) for c in (title, direct, body))
        score = score + F.when(t, 6).otherwise(0) + F.when(d, 3).otherwise(0) + F.when(b, 1).otherwise(0)
        fits = fits & (d | b)
    return rows.filter(fits).withColumn("score", score)


def reading_groups(rows: DataFrame) -> DataFrame:
    """rows: (article, story, fact, source, sort_at, first_party, score, seen_at). One row for each reading group.

    The group is the story, else the fact, else the article. Its main fact has the earliest report; the representative is
    the main fact's first-party, best and earliest article; the newest development is the fact seen first the latest.
    """
    key = F.coalesce(F.concat(F.lit("s"), "story"), F.concat(F.lit("f"), "fact"), F.concat(F.lit("a"), "article"))
    rows = rows.withColumn("group", key)
    facts = rows.groupBy("group", "fact").agg(
        F.min(F.struct("seen_at", "article")).alias("first_seen"),
        F.max(F.struct("first_party", "score", (-F.unix_micros("seen_at")).alias("t"), (-F.col("article")).alias("a"))).alias("best"),
        F.collect_set("source").alias("sources"),
        F.count(F.lit(1)).alias("reports"),
        F.max("sort_at").alias("anchor"),
    )
    out = facts.groupBy("group").agg(
        F.max("anchor").alias("anchor"),
        F.sum("reports").alias("reports"),
        F.count(F.lit(1)).alias("developments"),
        F.min(F.struct(F.col("first_seen.seen_at").alias("t"), "fact", "best", F.size("sources").alias("n"))).alias("main"),
        F.max(F.struct(F.col("first_seen.seen_at").alias("t"), "fact")).alias("latest"),
    )
    return out.select(
        "group", "anchor", "reports", "developments", F.col("main.fact").alias("main_fact"), (-F.col("main.best.a")).alias("representative"),
        F.greatest(F.lit(0), F.col("main.n") - 1).alias("more_sources"), F.when(F.col("latest.fact") != F.col("main.fact"), F.col("latest.fact")).alias("newest_development"),
    )


def assigned_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """rows: (id, tags, category, text lower-cased); topics: (slug, tags, categories, keywords). One row for each (id, slug) that
    fits, with how: by tag before category before keyword. Keywords have two characters at least.

    Tags and categories are equi-joins; only keywords meet every row, and only as a list inside a row, so nothing is paired.
    """
    by_tag = rows.select("id", F.explode("tags").alias("tag")).join(topics.select("slug", F.explode("tags").alias("tag")), "tag").select("id", "slug", F.lit(1).alias("rank"))
    by_category = rows.select("id", "category").join(topics.select("slug", F.explode("categories").alias("category")), "category").select("id", "slug", F.lit(2).alias("rank"))
    words = [(r.slug, r.k) for r in topics.select("slug", F.explode("keywords").alias("k")).filter("length(k) >= 2").collect()]  # the topics' own list
    needles = F.array(*[F.struct(F.lit(s).alias("slug"), F.lit(k).alias("k")) for s, k in words])
    hits = F.transform(F.filter(needles, lambda n: F.contains(F.col("text"), n["k"])), lambda n: n["slug"])
    by_word = rows.select("id", F.explode(F.array_distinct(hits)).alias("slug"), F.lit(3).alias("rank")) if words else by_tag.limit(0)
    every = by_tag.unionByName(by_category).unionByName(by_word)
    how = F.element_at(F.array(F.lit("tag"), F.lit("category"), F.lit("keyword")), F.min("rank"))
    return every.groupBy("id", "slug").agg(how.alias("how"))


def islands(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days, cut at month ends: (keys, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    marked = days.withColumn("__i", island).withColumn("__m", F.trunc(day, "month"))
    return marked.groupBy(*keys, "__i", "__m").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")).drop("__i", "__m")


def missing_days(days: DataFrame, day: str) -> DataFrame:
    """Days inside the span of ``days`` that are not there. The span's days come from one row."""
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).filter("a is not null")
    dense = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return dense.join(days.select(day).distinct(), day, "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, op): upsert where a row is new or changed, remove where it is gone; unchanged rows are left out."""
    digest = lambda d: d.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    a, b = digest(old).withColumnRenamed("h", "old"), digest(new).withColumnRenamed("h", "new")
    both = a.join(b, key, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("new").isNull(), "remove").otherwise("upsert").alias("op"))


def watermark(log: DataFrame, now: datetime, horizon_hours: int = 24) -> int | None:
    """log: (seq, visible_at). One before the first entry still held back within the horizon, else the last entry."""
    at, end = F.lit(now).cast("timestamp"), F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) + horizon_hours * 3600)
    held = (F.col("visible_at") > at) & (F.col("visible_at") <= end)
    r = log.agg(F.min(F.when(held, F.col("seq"))).alias("held"), F.max("seq").alias("last")).first()
    return r["last"] if r.held is None else r.held - 1


def snapshot(log: DataFrame, key: str, upto: int) -> DataFrame:
    """Each key's latest entry up to the watermark, if it is an upsert. A mergeable aggregate, no window."""
    rest = [c for c in log.columns if c != key]
    last = log.filter(F.col("seq") <= upto).groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return last.select(key, "x.*").filter("op = 'upsert'")


def changes(log: DataFrame, live: DataFrame, key: str, cursor: int, upto: int) -> DataFrame:
    """Entries in (cursor, upto]; upserts of keys that are no longer live are given as removes."""
    part = log.filter((F.col("seq") > cursor) & (F.col("seq") <= upto))
    alive = live.select(key, F.lit(True).alias("__live"))
    out = part.join(alive, key, "left")
    return out.withColumn("op", F.when(F.col("__live").isNull(), "remove").otherwise(F.col("op"))).drop("__live")
