"""What stands for what: configurations of models, posts that others refer to, models that qualify, sources that are due, rules of publications."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import markup as mk

# The window of releases, how old a find must be to be history, how many addresses one answer gives, files that are no pages.
RELEASE_MONTHS = 18
STALE_SECONDS = 48 * 3600
MOST_ADDRESSES = 200
ASSET = re.compile(r"(?i)\.(?:png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|map|woff2?|ttf|eot|mp4|mp3|pdf)(?:[?#]|$)")
#: End of fixed values.


def representatives(rows: DataFrame) -> DataFrame:
    """rows: (model_id, metric_key, source_model_name, model_slug, rank, kind, ineligible). Adds selected and selection_reason. Of a model and metric the eligible row with the
    highest rank stands, first-party ones before others, then names in slug form, then the one named like the model, then the shorter, then the lesser name.
    Reasons: why it is not eligible, or scaffolded, first-party, default, or scaffolded-lower and lower-priority for those that another stands for. Of rows
    that agree in all this one stands."""
    name = F.col("source_model_name")
    order = [F.col("rank").desc_nulls_last(), (F.col("kind") == "FIRST_PARTY").desc(), name.rlike("^[a-z0-9-]+$").desc(), F.coalesce(tx.model_slug(name) == F.col("model_slug"), F.lit(False)).desc(), F.char_length(name), name, F.col("kind")]
    w = Window.partitionBy("model_id", "metric_key").orderBy(F.col("ineligible").isNotNull(), *order)
    selected = (F.row_number().over(w) == 1) & F.col("ineligible").isNull()
    scaffolded = F.col("kind") == "SCAFFOLDED"
    rows = rows.withColumn("selected", selected)
    reason = F.when(F.col("ineligible").isNotNull(), F.col("ineligible")).when(F.col("selected") & scaffolded, "scaffolded").when(F.col("selected") & (F.col("kind") == "FIRST_PARTY"), "first-party").when(F.col("selected"), "default").when(scaffolded, "scaffolded-lower").otherwise("lower-priority")
    return rows.withColumn("selection_reason", reason)


def related_facts(posts: DataFrame, members: DataFrame) -> DataFrame:
    """posts: (article_id, url, reply_to, quoted_url); members: (article_id, url, identity_key, fact_id, created_at, trusted) of facts that live. Adds same_url, the fact of the earliest other
    report of the page, and referenced, the facts of the posts that this one replies to or quotes, the earliest first, each once. Both are joins on a key; a
    page's earliest two members are found before, so a page that all report is no larger than another."""
    live = members.filter("trusted")
    entry = F.struct("created_at", "article_id", "fact_id")
    first = live.filter("url is not null").groupBy(F.col("url").alias("_url")).agg(F.min(entry).alias("_a"))
    second = live.alias("m").join(first.alias("f"), (F.col("m.url") == F.col("f._url")) & (F.col("m.article_id") != F.col("f._a.article_id"))).groupBy(F.col("_url").alias("_url2")).agg(F.min(F.struct("m.created_at", "m.article_id", "m.fact_id")).alias("_b"))
    rows = posts.join(first, F.col("url") == F.col("_url"), "left").join(second, F.col("url") == F.col("_url2"), "left")
    rows = rows.withColumn("same_url", F.when(F.col("_a.article_id") == F.col("article_id"), F.col("_b.fact_id")).otherwise(F.col("_a.fact_id"))).drop("_url", "_a", "_url2", "_b")
    ids = F.filter(F.array(F.col("reply_to"), F.nullif(F.regexp_extract("quoted_url", r"/status/(\d+)", 1), F.lit(""))), lambda x: x.isNotNull())
    asked = posts.select(F.col("article_id").alias("_asking"), F.explode(F.array_distinct(F.transform(ids, lambda x: F.concat(F.lit("x:"), x)))).alias("_key"))
    found = asked.join(live, (F.col("_key") == F.col("identity_key")) & (F.col("_asking") != F.col("article_id"))).groupBy("_asking").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["fact_id"])).alias("referenced"))
    rows = rows.join(found, F.col("article_id") == F.col("_asking"), "left").drop("_asking")
    return rows.withColumn("referenced", F.coalesce("referenced", F.array().cast(found.schema["referenced"].dataType)))


def qualified_models(signals: DataFrame, units: DataFrame, models: DataFrame, anchors: list[str], cutoff: datetime, sources: int = 3, families: int = 3, operators: int = 3, categories: int = 3, direct_anchors: int = 2) -> DataFrame:
    """(model): models with enough evidence. signals: (unit, model); units: (unit, weight, family, operator, budget); models: (model, released). Of the units with a weight
    that a model is in there must be so many, of so many families and operators, and of so many budgets other than broad and preference; they must
    hold so many of the anchors besides the model itself; and the model must not have come out before the cutoff (unknown dates stay)."""
    own = signals.select("unit", "model").distinct().join(F.broadcast(units.filter("weight > 0")), "unit")  # a row a unit
    special = F.when(~F.col("budget").isin("broad", "preference"), F.col("budget"))
    counts = own.groupBy("model").agg(F.count_distinct("unit").alias("s"), F.count_distinct("family").alias("f"), F.count_distinct("operator").alias("o"), F.count_distinct(special).alias("c"))
    beside = own.filter(F.col("model").isin(anchors)).groupBy("unit").agg(F.collect_set("model").alias("anchors"))
    met = own.join(beside, "unit", "left").groupBy("model").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("anchors", F.array().cast("array<string>"))))).alias("met"))
    others = F.size(F.filter("met", lambda a: a != F.col("model")))
    enough = (F.col("s") >= sources) & (F.col("f") >= families) & (F.col("o") >= operators) & (F.col("c") >= categories) & (others >= direct_anchors)
    recent = F.coalesce(F.col("released") >= F.lit(cutoff), F.lit(True))
    return counts.join(met, "model").join(models.select("model", "released"), "model", "left").filter(enough & recent).select("model")


def due_sources(sources: DataFrame, kinds: list[str], now: datetime, limit: int, skip: Column | None = None) -> DataFrame:
    """sources: (source_id, enabled, kind, next_fetch_at). Those to fetch now: enabled, of the kinds, not yet planned or past their time, unplanned and oldest first."""
    due = F.col("enabled") & F.col("kind").isin(kinds) & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= F.lit(now)))
    kept = sources.filter(due if skip is None else due & ~F.coalesce(skip, F.lit(False)))
    return kept.orderBy(F.col("next_fetch_at").asc_nulls_first(), "source_id").limit(limit)


def addresses_in(payload: str, limit: int = MOST_ADDRESSES) -> list[str]:
    """Http addresses among the strings of a JSON value, in its order, each once, but those of files."""
    try:
        stack = [json.loads(payload)]
    except (ValueError, RecursionError):
        return []
    out: dict[str, None] = {}
    while stack and len(out) < limit:
        node = stack.pop()
        if isinstance(node, str):
            if re.match("(?i)https?://", node) and not ASSET.search(node):
                out[node.strip()] = None
        elif isinstance(node, (dict, list)):
            stack += reversed(list(node.values() if isinstance(node, dict) else node))
    return list(out)


def harvested(df: DataFrame, payload: str, out: str = "addresses") -> DataFrame:
    """Adds the addresses of a column of JSON."""
    return mk.per_page(df, [payload], f"{out} array<string>", lambda text: (addresses_in(text),))


def publication_flags(rows: DataFrame) -> DataFrame:
    """rows: (participation_mode, relevance, title, summary, judged_selected, tier, site_fulltext, syndicate_fulltext, body_status, has_body, visibility, indexed_at, excluded_at). Adds
    eligible (for the pool), selectable, body_mode, redistributed and indexable. Nulls are no."""
    said = lambda c: F.coalesce((F.col(c) != "") & ~tx.label_only(F.col(c)), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    eligible = yes((F.col("participation_mode") == "editorial") & (F.col("relevance") == "pass")) & said("title") & said("summary")
    rows = rows.withColumn("eligible", eligible)
    rows = rows.withColumn("selectable", F.col("eligible") & yes(F.col("judged_selected")) & (F.coalesce("tier", F.lit("")) != "EXCLUDE_MP"))
    rows = rows.withColumn("body_mode", F.when(yes(F.col("site_fulltext") & (F.col("body_status") == "ok") & F.col("has_body")), "full").otherwise("summary"))
    rows = rows.withColumn("redistributed", yes(F.col("syndicate_fulltext")) & (F.col("body_mode") == "full"))
    shown = yes(F.col("visibility") == "public") & yes(F.col("summary") != "") & F.col("excluded_at").isNull()
    return rows.withColumn("indexable", shown & ((F.col("selectable") & yes(tx.has_chinese(F.col("title")))) | F.col("indexed_at").isNotNull()))


def historical(backfill: Column, published: Column, discovered: Column) -> Column:
    """A find of a backfill whose time is unknown or was long past when it was found: archived, but neither news nor heat."""
    late = F.unix_micros(discovered) - F.unix_micros(published) > STALE_SECONDS * 1_000_000
    return F.coalesce(backfill, F.lit(False)) & (published.isNull() | late)
