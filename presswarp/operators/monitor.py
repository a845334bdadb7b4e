"""Why stories are hot, what a monitor of announced events counts, and what is wrong right now. All are aggregates by key against an explicit clock."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local, local_date, story_status

# Hours of the why-hot counts, rows of a story's lists, days of the monitor, and the limits of the findings.
HOT_HOURS, NEW_HOURS, REPORT_HOURS = 48, 6, 24
MOST_OFFICIAL, MOST_TIMELINE = 12, 100
MONITOR_DAYS = 90
QUIET_MINUTES, WAITING_HOURS, LEAST_WAITING, LEAST_FAILED, DAILY_BY_HOUR = 360, 2, 10, 20, 10
BACKUP_STALE_HOURS, BACKUP_FAILED_HOURS, QUEUE_HOURS, FETCH_HOURS = 30, 50, 2, 26
#: End of fixed values.


def why_hot(signals: DataFrame, behind: DataFrame, now: datetime) -> DataFrame:
    """signals: (story_id, participant_key, source_id, kind, observed_at); behind: (source_id) of sources that collection has not caught up with. A row a
    story with signals up to now: participants of 48 hours, those of the last 6 hours that were never there before, editorial reports of 24 hours, and
    whether no signal of 48 hours came from a source that is behind.

    A participant is summed up first, so a story's signals meet as one row a participant and task.
    """
    at, ago = F.col("observed_at"), lambda h: F.lit(now - timedelta(hours=h))
    late = F.broadcast(behind.select("source_id").distinct().withColumn("_behind", F.lit(True)))  # a row a source
    own = signals.filter(at <= F.lit(now)).join(late, "source_id", "left")
    each = own.groupBy("story_id", "participant_key").agg(
        F.max(at).alias("last"), F.min(at).alias("first"), F.count_if((F.col("kind") == "editorial") & (at > ago(REPORT_HOURS))).alias("reports"), F.count_if(F.col("_behind") & (at > ago(HOT_HOURS))).alias("partial")
    )
    recent, new = F.col("last") > ago(HOT_HOURS), (F.col("first") > ago(NEW_HOURS)) & F.col("participant_key").isNotNull()
    return each.groupBy("story_id").agg(
        F.count_if(recent & F.col("participant_key").isNotNull()).alias("participants_48h"), F.count_if(new).alias("new_participants_6h"), F.sum("reports").alias("recent_reports_24h"), (F.sum("partial") == 0).alias("observation_complete")
    )


def story_details(stories: DataFrame, reports: DataFrame, hot: DataFrame, ranks: DataFrame, now: datetime) -> DataFrame:
    """stories: (story_id, title, digest, summary, latest_at, first_report_at); reports: (story_id, report_id, source_id, source_name, at, first_party, summary); hot: ``why_hot``;
    ranks: (story_id, rank, heat) of the latest ranking. One row a story with reports: its status, counts, times, the excerpt that stands for a missing
    digest and summary (of the earliest report with one), the newest official reports and the newest reports of all, as ids.

    Lists are cut by windows before they are collected, so none is longer than its limit.
    """
    newest = Window.partitionBy("story_id").orderBy(F.col("at").desc(), "report_id")
    official = Window.partitionBy("story_id", "first_party").orderBy(F.col("at").desc(), "report_id")
    placed = reports.withColumns({"place": F.row_number().over(newest), "turn": F.row_number().over(official)})
    ids = lambda keep, place: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(place).alias("p"), "report_id")))), lambda x: x["report_id"])
    told = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.struct("at", "report_id", "summary", "source_name"))
    each = placed.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("report_count"), F.count_distinct("source_id").alias("source_count"), F.min("at").alias("_first"), F.max("at").alias("_last"), F.min(told).alias("_origin"),
        ids(F.col("first_party") & (F.col("turn") <= MOST_OFFICIAL), "turn").alias("official"), ids(F.col("place") <= MOST_TIMELINE, "place").alias("timeline"),
    )
    rows = stories.withColumnRenamed("summary", "own_summary").join(each, "story_id").join(hot, "story_id", "left").join(ranks.select("story_id", "rank", "heat"), "story_id", "left")
    latest = F.coalesce("latest_at", "_last")
    bare = F.col("digest").isNull() & F.col("own_summary").isNull()
    excerpt = F.when(bare & F.col("_origin").isNotNull(), F.struct(F.col("_origin.summary").alias("text"), F.col("_origin.source_name").alias("source_name")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "story_id", "title", story_status(latest, F.lit(now)).alias("status"), "report_count", "source_count", F.coalesce("first_report_at", "_first").alias("first_report_at"), latest.alias("latest_at"), excerpt.alias("excerpt"),
        zero("participants_48h"), zero("new_participants_6h"), zero("recent_reports_24h"), F.coalesce("observation_complete", F.lit(True)).alias("observation_complete"), "rank", "heat", "official", "timeline",
    )


def monitor_marks(events: DataFrame) -> DataFrame:
    """events: (event_id, type, status, presented, kind_explicit, occurred_on, confirmed_at, planned_from, created_at). Adds date, state (confirmed, likely or pending) and unclear:
    the day of a calendar's mark is that it happened on, was confirmed, is planned from, or was first written."""
    status = F.coalesce("presented", F.when(F.col("status") == "confirmed", "confirmed").otherwise("announced"))
    state = F.when(status == "confirmed", "confirmed").when(status == "likely_completed", "likely").otherwise("pending")
    day = F.coalesce("occurred_on", local_date(F.col("confirmed_at")), local_date(F.col("planned_from")), local_date(F.col("created_at")))
    return events.withColumns({"date": day, "state": state, "unclear": F.col("presented").isNotNull() & ~F.col("kind_explicit")})


def monitor_stats(marks: DataFrame, now: datetime, days: int = MONITOR_DAYS) -> DataFrame:
    """One row: landed resets and credits of the last days, the median of the days between days with a reset, and the last day with a confirmed one."""
    today = local_date(F.lit(now))
    landed = marks.filter("state <> 'pending'")
    near = (F.col("date") > F.date_sub(today, days)) & (F.col("date") <= today)
    reset = F.col("type") == "direct_reset"
    counts = landed.agg(F.count_if(reset & near).alias("resets"), F.count_if((F.col("type") == "reset_credit") & near).alias("credits"), F.max(F.when(reset & (F.col("state") == "confirmed"), F.col("date"))).alias("last_reset"))
    by_day = landed.filter(reset & (F.col("date") > F.date_sub(today, days))).select("date").distinct()
    gaps = by_day.withColumn("gap", F.date_diff("date", F.lag("date").over(Window.orderBy("date"))))  # a row a day of a calendar
    return counts.crossJoin(F.broadcast(gaps.agg(F.median("gap").alias("median_days"))))


def monitor_version(events: DataFrame, outage: Column) -> DataFrame:
    """One row: 16 hex digits that change with any event's id, time of update or status as shown, and with the outage shown. events: (event_id, updated_at, presented)."""
    line = F.concat_ws("|", "event_id", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.coalesce("presented", F.lit("-")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros("updated_at")).alias("t"), F.col("event_id").alias("e"), line.alias("l"))))
    return events.agg(ordered.alias("o")).select(F.substring(F.sha2(F.concat_ws("\n", F.transform("o", lambda x: x["l"]), F.coalesce(outage, F.lit(""))), 256), 1, 16).alias("version"))


# ---- findings


def _finding(frame: DataFrame, key: Column, level: str, detail: Column, since: Column | None = None) -> DataFrame:
    return frame.select(key.cast("string").alias("key"), F.lit(level).alias("level"), detail.cast("string").alias("detail"), (F.lit(None) if since is None else since).cast("timestamp").alias("since"))


def findings(now: datetime, articles: DataFrame, sources: DataFrame, reports: DataFrame, backups: DataFrame, receipts: DataFrame, jobs: DataFrame, fetches: DataFrame, started: datetime | None = None, restarts: int = 0, grace_minutes: int = 20) -> DataFrame:
    """(key, level, detail, since): what is wrong at the time ``now``. Levels: now, today, digest.

    articles: (discovered_at, state, error); sources: (enabled); reports: (kind, day); backups: (at, uploaded); receipts: (status, service, purpose); jobs: (name, state,
    start_after); fetches: (source_key, ok, last_ok). In the first minutes after a worker's start nothing is said of content, unless it starts again and again.
    """
    ago = lambda **x: F.lit(now - timedelta(**x))
    out: list[DataFrame] = []
    at = F.col("discovered_at")
    if started is None or now - started > timedelta(minutes=grace_minutes) or restarts >= 3:
        any_source = sources.filter("enabled").limit(1).select(F.lit(True).alias("_any"))
        last = articles.filter(at > ago(minutes=4 * QUIET_MINUTES)).agg(F.max(at).alias("last")).crossJoin(F.broadcast(any_source))
        out.append(_finding(last.filter(F.col("last").isNull() | (F.col("last") < ago(minutes=QUIET_MINUTES))), F.lit("content.collect"), "now", F.lit(f"nothing new for {QUIET_MINUTES} minutes"), F.col("last")))
        new = F.col("state") == "new"
        stuck = articles.filter(at > ago(days=2)).agg(F.count_if(new & (at < ago(hours=WAITING_HOURS))).alias("waiting"), F.min(F.when(new, at)).alias("oldest"), F.count_if((F.col("state") == "failed") & (at > ago(hours=3))).alias("failed"))
        waits = F.col("waiting") >= LEAST_WAITING
        out.append(_finding(stuck.filter(waits | (F.col("failed") >= LEAST_FAILED)), F.lit("content.process"), "now", F.concat(F.lit("waiting "), "waiting", F.lit(", failed "), "failed"), F.when(waits, F.col("oldest"))))
        today = local_date(F.lit(now))
        missing = reports.agg(F.count_if((F.col("kind") == "daily") & (F.col("day") == today)).alias("n")).filter((F.col("n") == 0) & (F.hour(local(F.lit(now))) >= DAILY_BY_HOUR))
        out.append(_finding(missing, F.lit("report.daily"), "now", F.concat(F.lit("no daily report of "), today)))
    backup = backups.agg(F.max_by(F.struct("at", "uploaded"), "at").alias("b")).select(F.col("b.at").alias("at"), F.coalesce("b.uploaded", F.lit(False)).alias("uploaded"))
    failed = F.col("uploaded") & (F.col("at") < ago(hours=BACKUP_FAILED_HOURS))
    stale = F.col("at").isNull() | ~F.col("uploaded") | (F.col("at") < ago(hours=BACKUP_STALE_HOURS))
    out.append(_finding(backup.filter(failed), F.lit("backup.failed"), "today", F.lit("no whole backup for two days"), F.col("at")))
    out.append(_finding(backup.filter(~F.coalesce(failed, F.lit(False)) & stale), F.lit("backup.stale"), "digest", F.when(F.col("at").isNull(), "no backup yet").otherwise("no whole backup for a day")))
    unknown = receipts.filter("status = 'unknown'").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "service", "purpose"))), ",").alias("which")).filter("n > 0")
    out.append(_finding(unknown, F.lit("receipts.unknown"), "digest", F.concat_ws(" ", "n", "which")))
    queues = jobs.filter(F.col("state").isin("created", "retry") & (F.col("start_after") <= F.lit(now)) & ~F.col("name").startswith("cron.")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("start_after").alias("oldest"))
    out.append(_finding(queues.filter(F.col("oldest") < ago(hours=QUEUE_HOURS)), F.concat(F.lit("queue."), "name"), "digest", F.concat("n", F.lit(" waiting")), F.col("oldest")))
    old = fetches.filter(~F.col("ok") & (F.col("last_ok") < ago(hours=FETCH_HOURS))).agg(F.array_join(F.array_sort(F.collect_list("source_key")), ",").alias("which"), F.min("last_ok").alias("since")).filter("which <> ''")
    out.append(_finding(old, F.lit("leaderboard.fetch"), "digest", F.col("which"), F.col("since")))
    return reduce(DataFrame.unionByName, out)
