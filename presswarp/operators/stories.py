"""Stories from verdicts: what a post reports, joins or reacts to, which stories are one, what changed in selection."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRM, REVIEWED, REACTION = 0.8, 0.75, 0.8  # fixed values
REFRESH_HOURS = 36
TASK_ROWS = 3_500_000  # rows of candidates and verdicts to a task
SHARES = 16  # parts a post's facts are dealt to


def firmly_tied(relation: Column, confidence: Column, least: float = FIRM) -> Column:
    return F.coalesce(relation.isin("SAME_OCCURRENCE", "SAME_STORY") & (confidence >= least), F.lit(False))


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """rows: (post, fact, ...). With ``share``, one of SHARES parts of a post's facts: a post's share is in one task, and what is
    derived from it stays there."""
    return rows.withColumn("share", F.pmod(F.xxhash64("fact"), F.lit(SHARES))).repartition(tasks, "post", "share")


def judged(candidates: DataFrame, verdicts: DataFrame, tasks: int | None = None) -> DataFrame:
    """candidates: (post, fact, root, score); verdicts: (post, fact, relation, confidence, at). One row a post: ``same``, the fact
    it reports (by confidence, then score), ``joins``, the fact whose story it carries on (the most similar root), ``roundup``,
    whether all its candidates are called that, and ``reacts``, the fact a discussion counts for. The first verdict on a
    candidate counts (one without a time never does); one without a verdict is unrelated. Ties go to the least fact. Copies of a
    candidate are taken together.

    Both are dealt to ``tasks``, else to as many as their counted rows need, so that a task doesn't grow with the input; where both
    have the ``share`` of ``dealt`` they are taken as they lie. Shares of a post are merged before they meet."""
    keyed = F.col("post").isNotNull() & F.col("fact").isNotNull()  # no filter: it would go below the exchange and have the rows dealt twice
    known = verdicts.withColumn("v", F.when(keyed, F.struct("at", "relation", "confidence"))).drop("at", "relation", "confidence")
    rows = candidates.withColumn("c", F.struct("score", "root")).drop("score", "root").unionByName(known, allowMissingColumns=True)
    if tasks is None:
        tasks = tasks_for(candidates.sparkSession, rows.count())
    if "share" not in candidates.columns or "share" not in verdicts.columns:
        rows = dealt(rows, tasks)
    pairs = rows.groupBy("post", "share", "fact").agg(F.max("c").alias("c"), F.max(F.when(F.col("c.root"), F.col("c"))).alias("root"), F.min_by("v", "v.at").alias("v")).filter("c is not null")
    relation, confidence = F.coalesce("v.relation", F.lit("UNRELATED")), F.coalesce("v.confidence", F.lit(0.0))
    same, story = relation == "SAME_OCCURRENCE", relation == "SAME_STORY"
    least = (-F.col("fact")).alias("f")
    parts = pairs.groupBy("post", "share").agg(
        F.max(F.when(same, F.struct(confidence.alias("confidence"), "c.score", least))).alias("same"), F.max(F.when(story & F.col("root").isNotNull(), F.struct("root.score", least))).alias("joins"),
        F.bool_and(relation == "ROUNDUP").alias("roundup"), F.max(F.when(story & (confidence >= REACTION), F.struct("c.score", least))).alias("reaction"),
    )
    best = lambda name: F.max(name)["f"] * -1
    out = parts.repartition(tasks, "post").groupBy("post").agg(best("same").alias("same"), best("joins").alias("joins"), F.bool_and("roundup").alias("roundup"), best("reaction").alias("reaction"))
    return out.select("post", "same", "joins", "roundup", F.coalesce("same", "reaction").alias("reacts"))


def consolidations(roots: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """roots: (grp, story, at, roundup); first, second: (from, into, relation, confidence). Each group's stories against its
    earliest one: ``merge`` if both readings tie them. Roundups take no part; a group with one story left gives no rows."""
    live = roots.filter(~F.col("roundup"))
    anchor = live.groupBy("grp").agg(F.min(F.struct("at", "story"))["story"].alias("into"))
    pairs = live.join(anchor, "grp").filter("story <> into").select(F.col("story").alias("from"), "into").distinct()
    for name, verdicts in (("first", first), ("second", second)):
        pairs = pairs.join(verdicts.select("from", "into", F.struct("relation", "confidence").alias(name)), ["from", "into"], "left")
    tied = firmly_tied(F.col("first.relation"), F.col("first.confidence"))
    review = F.when(tied, F.col("second.relation"))
    return pairs.select("from", "into", (tied & firmly_tied(review, F.col("second.confidence"), REVIEWED)).alias("merge"), F.col("first.relation").alias("first"), review.alias("second"))


def usable_merges(merges: DataFrame, stories: DataFrame) -> DataFrame:
    """(from, into) of merges that can be done together: both stories are there and not merged, each goes into one (the least), and
    none that takes another in goes away itself. Others are left for the next run."""
    live = stories.filter("merged_into is null").select(F.col("story"))
    once = merges.filter(F.col("from") != F.col("into")).groupBy("from").agg(F.min("into").alias("into"))
    known = once.join(live.withColumnRenamed("story", "from"), "from", "left_semi").join(live.withColumnRenamed("story", "into"), "into", "left_semi")
    leaving = known.select(F.col("from").alias("into"))
    return known.join(leaving, "into", "left_anti").select("from", "into")


def merged_stories(stories: DataFrame, merges: DataFrame) -> DataFrame:
    """stories: (story, merged_into, version, first_at, latest_at). Merged ones point to their story; that takes over the earliest
    and the latest time. Versions of all that took part go up by one."""
    ends = stories.join(merges, F.col("story") == F.col("from")).groupBy("into").agg(F.min("first_at").alias("f"), F.max("latest_at").alias("l"))
    out = stories.join(merges.withColumnRenamed("into", "gone_to"), F.col("story") == F.col("from"), "left").join(ends, F.col("story") == F.col("into"), "left")
    changed = F.col("gone_to").isNotNull() | F.col("into").isNotNull()
    return out.select(
        "story", F.coalesce("gone_to", "merged_into").alias("merged_into"), (F.col("version") + changed.cast("int")).alias("version"),
        F.least("first_at", "f").alias("first_at"), F.greatest("latest_at", "l").alias("latest_at"),
    )


def moved_signals(signals: DataFrame, merges: DataFrame, rest: list[str]) -> DataFrame:
    """Signals (story, article, ...) under the stories that are left: one for each story and article, its own before one moved."""
    out = signals.join(merges, F.col("story") == F.col("from"), "left")
    order = F.struct(F.col("into").isNotNull(), "story")
    return out.groupBy(F.coalesce("into", "story").alias("kept"), "article").agg(F.min_by(F.struct(*rest), order).alias("x")).select(F.col("kept").alias("story"), "article", "x.*")


def developments(selected: DataFrame, reports: DataFrame) -> DataFrame:
    """selected: (story, fact, article, first_party, score, at); reports: (fact, article). A story's facts, ``place`` 1 being
    the one that came up last, each with its representative and the number of its reports (of selected rows where it has none)."""
    least = (-F.col("article")).alias("a")
    facts = selected.filter("fact is not null").groupBy("story", "fact").agg(
        F.min("at").alias("first_at"), (-F.max(F.struct("first_party", "score", (-F.unix_micros("at")).alias("t"), least))["a"]).alias("representative"), F.count(F.lit(1)).alias("own"),
    )
    counts = reports.groupBy("fact").agg(F.count_distinct("article").alias("n"))
    order = Window.partitionBy("story").orderBy(F.col("first_at").desc(), "fact")
    return facts.join(counts, "fact", "left").select("story", "fact", "representative", F.coalesce("n", "own").alias("reports"), F.row_number().over(order).alias("place"))


def selection_changes(rows: DataFrame, ready: DataFrame, now: datetime, hours: int = REFRESH_HOURS) -> DataFrame:
    """rows: (article, selected, selected_ready_at, visibility, body_mode, timeline_at, visible_after); ready: (article, ready).
    (article, selected, visible_after) of what changes: recent public rows that were never judged come in if they are whole and
    ready, and go out if they are not whole."""
    fresh = rows.filter((F.col("visibility") == "public") & F.col("selected_ready_at").isNull() & (F.col("timeline_at") >= F.lit(now - timedelta(hours=hours))))
    whole = F.col("body_mode") == "full"
    able = ready.filter("ready").select("article").distinct()
    up = fresh.filter(~F.col("selected") & whole).join(able, "article", "left_semi").select("article", F.lit(True).alias("selected"), F.coalesce("visible_after", F.lit(now)).alias("visible_after"))
    return up.unionByName(fresh.filter(F.col("selected") & ~whole).select("article", F.lit(False).alias("selected"), "visible_after"))


def headlines(reports: DataFrame, items: DataFrame, gone: DataFrame) -> DataFrame:
    """reports: (report, headline); items: (report, place, item, title); gone: (item). A report's headline, else the title of its
    first item that is not withdrawn (one without an id never is); null where there is none."""
    left = items.join(gone.select("item").distinct(), "item", "left_anti").groupBy("report").agg(F.min_by("title", "place").alias("title"))
    return reports.join(left, "report", "left").select("report", F.coalesce(F.when(F.col("headline") != "", F.col("headline")), "title").alias("headline"))


def merged_hosts(hits: DataFrame) -> DataFrame:
    """hits: (host, engine, rank). A host's engines and best rank, with its place among all: by engines, rank and name."""
    each = hits.filter("host <> ''").groupBy("host").agg(F.count_distinct("engine").alias("engines"), F.min("rank").alias("best_rank"))
    return each.orderBy(F.col("engines").desc(), "best_rank", "host")


def unrepeated_blocks(blocks: DataFrame, doc: str, place: str, text: str, listed: Column, copies: int) -> DataFrame:
    """Blocks without copies: of lists that a document has ``copies`` times or more, the first stays. Counted by digest in a
    mergeable aggregate, so that a block that every document has is in no one task."""
    marked = blocks.withColumn("__k", F.when(listed, F.md5(text)))
    often = marked.filter("__k is not null").groupBy(doc, "__k").agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first")).filter(F.col("__n") >= copies)
    kept = marked.join(often, [doc, "__k"], "left").filter(F.col("__first").isNull() | (F.col(place) == F.col("__first")))
    return kept.drop("__k", "__n", "__first")
