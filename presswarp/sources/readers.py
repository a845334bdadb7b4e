"""Readers and writers that the surfaces need beyond Parquet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_published
from ..functions.text import collapse, is_teaser, strip_tags
from ..functions.urls import normalise

BODY_ABOVE = 280  # characters of feed text that make a body
MOST_IN_BATCH = 50
MOST_EXCERPT = 2000


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def jsonl_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document a line; blank lines and lines of // comments are left out."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def feed_items(spark: SparkSession, path: str, row: str = "item") -> DataFrame:
    """(title, url, published, excerpt, body) of RSS items: the text is a body if it is long and no teaser."""
    schema = "title string, link string, pubDate string, description string, guid string"
    items = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return feed_text(items.select(collapse(F.col("title")).alias("title"), normalise(F.coalesce("link", "guid")).alias("url"), parse_published(F.col("pubDate")).alias("published"), strip_tags(F.col("description")).alias("text")))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, published, excerpt, body) of Atom entries: the first link that leads to the page itself, the content before
    the summary, the time of publishing before that of the last change."""
    schema = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string, content string"
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    own = F.try_element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"]
    return feed_text(entries.select(collapse(F.col("title")).alias("title"), normalise(own).alias("url"), parse_published(F.coalesce("published", "updated")).alias("published"), strip_tags(F.coalesce("content", "summary")).alias("text")))


def feed_text(items: DataFrame) -> DataFrame:
    whole = (F.char_length("text") > BODY_ABOVE) & ~is_teaser(F.col("text"))
    return items.withColumn("body", F.when(whole, F.col("text"))).withColumn("excerpt", F.when(~whole, F.col("text"))).drop("text")


def json_list(rows: DataFrame, document: str, items: str, paths: dict[str, str], require: str | None = None, at_least: tuple[str, float] | None = None) -> DataFrame:
    """Items of a JSON document: fields by path, optional filters on a boolean and on a least number. Rows without a url go."""
    each = rows.select(F.explode(F.from_json(F.get_json_object(document, f"$.{items}" if items else "$"), "array<string>")).alias("item"))
    if require:
        each = each.filter(F.get_json_object("item", f"$.{require}") == "true")
    if at_least:
        each = each.filter(F.expr(f"try_cast(get_json_object(item, '$.{at_least[0]}') AS double)") >= at_least[1])
    out = each.select(*[F.get_json_object("item", f"$.{path}").alias(name) for name, path in paths.items()])
    return out.filter(F.coalesce(F.trim("url"), F.lit("")) != "") if "url" in paths else out


def json_path(path: str) -> str:
    """a.0.b as a path of Spark: $.a[0].b"""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".") if p)


def json_value(item: Column, path: str) -> Column:
    """The value at a path as a text; null where there is none, or an empty one."""
    return F.nullif(F.get_json_object(item, json_path(path)), F.lit(""))


def first_text(item: Column, paths: list[str]) -> Column:
    """The first of the paths that has a text or a number, without blanks around; lists, objects and flags are none."""
    value = lambda p: F.trim(json_value(item, p))
    return F.coalesce(*[F.when((value(p) != "") & ~value(p).rlike(r"^(?:[\[{].*|true|false)$"), value(p)) for p in paths], F.lit(None).cast("string"))


def json_candidates(rows: DataFrame, document: str, settings: dict, *keep: str) -> DataFrame:
    """Items of JSON documents as (keep..., position, url, title, author, published, excerpt, body, external_id), by a source's settings:

    items_path (with object_values: the values of an object stand for a list), require (path, true or false), at_least (path, number), url_template and
    url_fallback ({path} encoded, {raw:path} as it is; a template that lacks a value gives none), titles, summaries, authors (paths, the first with a text),
    published, external_id (paths), summary_is_body. Items without a title or an address are left out; documents that are no JSON, or have no list there, give none.
    """
    path = json_path(settings["items_path"]) if settings.get("items_path") else "$"
    held = F.get_json_object(document, path)
    listed = F.map_values(F.from_json(held, "map<string,string>")) if settings.get("object_values") else None
    plain = F.from_json(held, "array<string>")
    each = rows.select(*keep, F.posexplode(plain if listed is None else F.when(held.startswith("{"), listed).otherwise(plain)).alias("position", "item"))
    item = F.col("item")
    if settings.get("require"):
        at, wanted = settings["require"]
        each = each.filter(F.get_json_object(item, json_path(at)) == str(wanted).lower())
    if settings.get("at_least"):
        at, least = settings["at_least"]
        each = each.filter(F.coalesce(json_value(item, at).try_cast("double") >= least, F.lit(False)))
    address = F.coalesce(*[rendered(settings[k], lambda p: json_value(item, p)) for k in ("url_template", "url_fallback") if settings.get(k)])
    text = lambda name: first_text(item, settings.get(name, []))
    value = lambda name: json_value(item, settings[name]) if settings.get(name) else F.lit(None).cast("string")
    summary = text("summaries")
    out = each.select(
        *keep, "position", address.alias("url"), collapse(strip_tags(text("titles"))).alias("title"), text("authors").alias("author"), parse_published(value("published")).alias("published"), F.substring(collapse(strip_tags(summary)), 1, MOST_EXCERPT).alias("excerpt"),
        (strip_tags(summary) if settings.get("summary_is_body") else F.lit(None).cast("string")).alias("body"), value("external_id").alias("external_id"),
    )
    return out.filter(F.col("url").isNotNull() & F.col("title").isNotNull() & (F.col("title") != ""))


def rendered(template: str, value) -> Column:
    """A template whose {path} stands for an encoded value and {raw:path} for the value itself; null where one is missing. value: the column of a
    path."""
    parts: list[Column] = []
    for plain, raw, path in re.findall(r"([^{}]+)|\{(raw:)?([^}]+)\}", template):
        own = F.nullif(value(path), F.lit("")) if path else None
        encoded = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
        parts.append(F.lit(plain) if own is None else own if raw else encoded(own))
    return F.concat(*parts)


def resume_window(listing: DataFrame, position: str, url: str, anchor: str | None, head: int, tail: int) -> DataFrame:
    """The first ``head`` rows of a listing and the ``tail`` rows after the one remembered."""
    if anchor is None:
        return listing.filter(F.col(position) <= head)
    at = listing.filter(F.col(url) == anchor).agg(F.min(position)).first()[0]
    after = F.col(position).between(at + 1, at + tail) if at is not None else F.lit(False)
    return listing.filter((F.col(position) <= head) | after)


def pushed_items(items: DataFrame, most: int = MOST_IN_BATCH) -> DataFrame:
    """items: (batch, position, title, url). Adds canonical and the reason for which an item is rejected, if any."""
    out = items.withColumn("canonical", normalise(F.col("url")))
    nth = F.row_number().over(Window.partitionBy("batch", "canonical").orderBy("position"))
    out = out.withColumn("__n", nth)
    reason = F.when(F.col("position") > most, "too-many").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no-title").when(F.col("canonical").isNull(), "bad-url").when(F.col("__n") > 1, "duplicate")
    return out.withColumn("reason", reason).drop("__n")


def allowed(url: Column, allow: list[str], deny: list[str], extensions: list[str] = ("pdf", "zip", "jpg", "png", "mp4")) -> Column:
    start = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda p: url.startswith(p)) if xs else F.lit(False)
    ok = start(allow) if allow else F.lit(True)
    return ok & ~start(deny) & ~url.rlike(f"(?i)\\.(?:{'|'.join(extensions)})(?:\\?|$)")


def robots_rules(files: DataFrame, name: str) -> DataFrame:
    """files: (host, text). (host, prefix, allow, position): the rules of groups for all agents, or for agents whose name has
    ``name``. The last user-agent line above a rule decides; comments and empty paths are no rules."""
    lines = files.select("host", F.posexplode(F.split("text", "\r?\n")).alias("position", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter(F.col("line").contains(":"))
    field, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("host", "position", field.alias("field"), value.alias("value"))
    agent = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True)
    lines = lines.withColumn("agent", agent.over(Window.partitionBy("host").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    ours = (F.col("agent") == "*") | F.col("agent").contains(name)
    return lines.filter(ours & F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select("host", F.col("value").alias("prefix"), (F.col("field") == "allow").alias("allow"), "position")


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages: (host, path); rules: (host, prefix, allow, position). The longest matching prefix decides, of equal ones the first;
    no rule allows. Rules meet only pages of their host."""
    hits = pages.select("host", "path").distinct().join(rules, "host").filter(F.col("path").startswith(F.col("prefix")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("prefix").alias("n"), (-F.col("position")).alias("first"), "allow")).alias("b"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def heading_dates(updates: DataFrame) -> DataFrame:
    """updates: (page, position, level, date, text). Each update takes the last date heading above it, up to the next h2."""
    w = Window.partitionBy("page").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    section = F.sum(F.when((F.col("level") == 2) & F.col("date").isNull(), 1).otherwise(0)).over(w)
    inside = Window.partitionBy("page", "__s").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return updates.withColumn("__s", section).withColumn("dated", F.last("date", ignorenulls=True).over(inside)).drop("__s")


def absent_only(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target does not have yet."""
    return rows.join(target.select(key).distinct(), key, "left_anti")
