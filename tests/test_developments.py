"""Developments of stories, their order and pages by cursors."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswarp.operators import developments as dv

DAY = datetime(2024, 1, 10)


def at(d):
    return DAY + timedelta(days=d)


def frames(spark, more=()):
    members = [(1, 10, 1, False, "full", 9.0, at(0), None), (1, 10, 2, True, "summary", 1.0, at(1), None), (1, 10, 3, True, "full", 2.0, at(2), None), (1, 10, 4, True, "full", 2.0, at(1), None), (1, 11, 5, None, None, None, at(0), at(5)), (1, 12, 6, True, "full", 1.0, at(3), None), (1, None, 7, True, "full", 1.0, at(9), None), (2, 20, 8, False, "full", 1.0, at(0), None), (1, 9, 9, False, "full", 0.0, at(3), None), *more]
    m = spark.createDataFrame(members, "story_id int, fact_id int, article_id int, first_party boolean, body_mode string, score double, timeline_at timestamp, sort_at timestamp")
    return dv.developments(m, spark.createDataFrame([(10, 7), (99, 1)], "fact_id int, reports long"), spark.createDataFrame([(10, "ten", at(0))], "fact_id int, title string, occurred_at timestamp"))


def test_developments(spark):
    got = [(r.story_id, r.place, r.fact_id, r.representative, r.reports, r.title, r.size) for r in frames(spark).orderBy("story_id", "place").collect()]
    assert got == [(1, 1, 11, 5, 1, None, 4), (1, 2, 12, 6, 1, None, 4), (1, 3, 9, 9, 1, None, 4), (1, 4, 10, 4, 7, "ten", 4), (2, 1, 20, 8, 1, None, 1)]
    revision = lambda df: {r.story_id: r.revision for r in df.collect()}
    other = frames(spark, [(1, 12, 60, True, "full", 5.0, at(4), None)])
    assert revision(frames(spark)) == revision(frames(spark)) and revision(other)[1] != revision(frames(spark))[1] and revision(other)[2] == revision(frames(spark))[2]


def test_pages(spark):
    rows = frames(spark)

    def ask(cursor, story=1, channel=None, rows=rows):
        q = spark.createDataFrame([("q", story, cursor, channel)], "request_id string, story_id int, cursor string, channel string")
        found = dv.page(rows, q, 3, "channel").orderBy("place").collect()
        return found[0].outcome, [r.fact_id for r in found if r.fact_id is not None], found[0].next

    first = ask(None)
    assert first[:2] == ("start", [11, 12, 9]) and first[2].startswith("dv1.")
    assert ask(first[2]) == ("ok", [10], None)
    assert ask(first[2], channel="x")[:2] == ("invalid", []) and ask(first[2], story=2)[:2] == ("invalid", []) and ask("dv1.junk")[0] == ask("no")[0] == ask("")[0] == "invalid"
    assert ask(first[2], rows=frames(spark, [(1, 77, 70, True, "full", 5.0, at(4), None)]))[:2] == ("changed", [])
    assert ask(None, story=5) == ("missing", [], None) and ask(None, story=2) == ("start", [20], None)
    bad = spark.range(1).select(dv.cursor(F.lit(-1), F.lit("r"), F.lit("b")).alias("c")).select(dv.read(F.col("c"), F.lit("r"), F.lit("b")).alias("x")).first().x
    assert bad.outcome == "invalid"
