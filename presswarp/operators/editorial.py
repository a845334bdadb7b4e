"""Selection, publication and readiness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_chinese, label_only

#: Score thresholds of the tiers; other tiers are not scored.
THRESHOLDS = {"T1": 46, "T1_5": 49, "T2": 52}
RICH_ABOVE = 72
HOLD_SECONDS = 180


def threshold(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in THRESHOLDS.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def selected(passes: Column, first: Column, second: Column, tier: Column) -> Column:
    """Both scores together reach twice the tier's threshold."""
    return F.coalesce(passes & (first + second >= 2 * threshold(tier)), F.lit(False))


def shown_score(first: Column, second: Column) -> Column:
    return F.floor((first + second) / 2)


def rich(first: Column, second: Column, tier: Column) -> Column:
    total = first + second
    return F.coalesce((total >= 2 * threshold(tier)) | (total > RICH_ABOVE), F.lit(False))


def released(is_selected: Column, visible_after: Column, now: Column) -> Column:
    """In three-valued logic: a selected row without a time is not released."""
    return ~is_selected | (visible_after <= now)


def eligible(kind: Column, passes: Column, title: Column, summary: Column) -> Column:
    full = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "") & ~label_only(c)
    return F.coalesce((kind == "editorial") & passes & full(title) & full(summary), F.lit(False))


def listed(title: Column) -> Column:
    return has_chinese(title) & ~label_only(title)


def availability(visibility: Column, is_editorial: Column, is_released: Column) -> Column:
    return F.when((visibility == "public") & is_editorial & is_released, "public").when((visibility == "public") & is_editorial, "summary-only").otherwise("unavailable")


def override(*layers: Column) -> Column:
    """The first layer that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in layers])


def visible_after(first_selected: Column, grouped_at: Column, seconds: int = HOLD_SECONDS) -> Column:
    """A selected row waits for its grouping, for ``seconds`` at most."""
    until = F.timestamp_seconds(F.unix_seconds(first_selected) + seconds)
    return F.when(grouped_at.isNull(), until).otherwise(F.greatest(first_selected, F.least(until, grouped_at)))


def bounded_media(media: Column, kind: str = "video", most: int = 3) -> Column:
    """The first videos that have a poster."""
    return F.slice(F.filter(media, lambda m: (m["kind"] == kind) & m["poster"].isNotNull()), 1, most)


def ready(articles: DataFrame, readiness: DataFrame) -> DataFrame:
    """Rows whose (article, revision, analysis) is ready."""
    return articles.join(readiness.select("article", "revision", "analysis").distinct(), ["article", "revision", "analysis"], "left_semi")


def reselected(rows: DataFrame) -> DataFrame:
    """rows: (id, source, passes, first, second, tier, selected). Rows whose stored flag differs from the rule, tallied by source."""
    now = selected(F.col("passes"), F.col("first"), F.col("second"), F.col("tier"))
    changed = rows.withColumn("__now", now).filter(~F.col("__now").eqNullSafe(F.col("selected")))
    return changed.groupBy("source").agg(F.count_if("__now").alias("gained"), F.count_if(~F.col("__now")).alias("lost"))


def alert_changes(open_alerts: DataFrame, findings: DataFrame, now: Column, repeat_hours: int = 6) -> DataFrame:
    """open_alerts: (key, since, told); findings: (key, detail). (key, action): open, repeat, quiet or recover."""
    a = open_alerts.withColumn("__open", F.lit(True))
    b = findings.withColumn("__found", F.lit(True))
    both = a.join(b, "key", "full")
    age = F.unix_seconds(now) - F.unix_seconds("told")
    action = F.when(F.col("__open").isNull(), "open").when(F.col("__found").isNull(), "recover").when(age >= repeat_hours * 3600, "repeat").otherwise("quiet")
    return both.select("key", action.alias("action"), "detail")


def boot_loops(beats: DataFrame, minutes: int = 60, least: int = 3) -> DataFrame:
    """beats: (worker, at, started). Workers whose start changed at least ``least`` times within the window before a beat."""
    from pyspark.sql import Window

    w = Window.partitionBy("worker").orderBy("at")
    changed = beats.withColumn("__c", F.when(F.lag("started").over(w) != F.col("started"), 1).otherwise(0)).withColumn("__t", F.unix_seconds("at"))
    recent = Window.partitionBy("worker").orderBy("__t").rangeBetween(-minutes * 60, 0)
    return changed.withColumn("changes", F.sum("__c").over(recent)).groupBy("worker").agg(F.max("changes").alias("changes")).filter(F.col("changes") >= least)
