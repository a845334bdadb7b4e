"""Why-hot counts, story pages, the monitor and findings, on cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswarp.operators import monitor as mo

NOW = datetime(2024, 1, 20, 6)


def hours(h):
    return NOW - timedelta(hours=h)


def test_why_hot(spark):
    rows = [
        (1, "a", 1, "editorial", hours(1)), (1, "a", 1, "editorial", hours(2)), (1, "b", 1, "signal", hours(5)), (1, "b", 1, "signal", hours(7)), (1, "c", 2, "editorial", hours(30)), (1, "d", 2, "signal", hours(60)), (1, "e", 1, "signal", hours(-1)), (1, None, 1, "signal", hours(1)),
        (2, "a", 9, "signal", hours(47)), (3, "a", 9, "signal", hours(49)), (4, "a", 1, "editorial", hours(6)),
    ]
    frame = spark.createDataFrame(rows, "story_id int, participant_key string, source_id int, kind string, observed_at timestamp")
    behind = spark.createDataFrame([(9,), (9,), (77,)], "source_id int")
    got = {r.story_id: tuple(r)[1:] for r in mo.why_hot(frame, behind, NOW).select("story_id", "participants_48h", "new_participants_6h", "recent_reports_24h", "observation_complete").collect()}
    assert got == {1: (3, 1, 2, True), 2: (1, 0, 0, False), 3: (0, 0, 0, True), 4: (1, 0, 1, True)}
    assert mo.why_hot(frame.limit(0), behind, NOW).count() == 0


def test_story_details(spark):
    reports = spark.createDataFrame([(1, k, k % 3, f"s{k % 3}", hours(k), k % 2 == 0, "" if k > 28 else f"t{k}") for k in range(1, 31)] + [(2, 99, 1, "s1", hours(100), False, None)], "story_id int, report_id int, source_id int, source_name string, at timestamp, first_party boolean, summary string")
    stories = spark.createDataFrame([(1, "one", None, None, None, None), (2, "two", None, "own", hours(80), hours(200)), (3, "none", None, None, None, None)], "story_id int, title string, digest string, summary string, latest_at timestamp, first_report_at timestamp")
    hot = spark.createDataFrame([(1, 5, 1, 2, False)], "story_id int, participants_48h long, new_participants_6h long, recent_reports_24h long, observation_complete boolean")
    ranks = spark.createDataFrame([(1, 3, 2.5)], "story_id int, rank int, heat double")
    one, two = mo.story_details(stories, reports, hot, ranks, NOW).orderBy("story_id").collect()
    assert (one.status, one.report_count, one.source_count, one.rank, one.observation_complete, one.first_report_at, one.latest_at) == ("active", 30, 3, 3, False, hours(30), hours(1))
    assert (one.excerpt.text, one.excerpt.source_name) == ("t28", "s1") and one.official == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24] and one.timeline == list(range(1, 31))
    assert (two.status, two.excerpt, two.rank, two.participants_48h, two.observation_complete, two.first_report_at, two.official) == ("settled", None, None, 0, True, hours(200), [])


def test_monitor(spark):
    day = lambda d: datetime(2024, 1, d, 12)
    rows = [
        ("a", "direct_reset", "confirmed", None, True, None, day(2), None, day(1)), ("b", "direct_reset", "open", "likely_completed", False, None, None, day(5), day(3)), ("c", "direct_reset", "open", "announced", True, None, None, day(19), day(18)), ("d", "reset_credit", "confirmed", "confirmed", True, None, day(6), None, day(6)),
        ("e", "direct_reset", "confirmed", None, True, None, datetime(2023, 6, 1), None, day(1)), ("f", "direct_reset", "confirmed", None, True, None, datetime(2024, 1, 14, 20), None, day(1)), ("g", "direct_reset", "open", None, True, None, None, None, day(1)),
    ]
    events = spark.createDataFrame(rows, "event_id string, type string, status string, presented string, kind_explicit boolean, occurred_on date, confirmed_at timestamp, planned_from timestamp, created_at timestamp")
    marks = {r.event_id: (str(r.date), r.state, r.unclear) for r in mo.monitor_marks(events).collect()}
    assert marks["a"] == ("2024-01-02", "confirmed", False) and marks["b"] == ("2024-01-05", "likely", True) and marks["c"][1] == marks["g"][1] == "pending" and marks["f"][0] == "2024-01-15"
    r = mo.monitor_stats(mo.monitor_marks(events), NOW).first()
    assert (r.resets, r.credits, str(r.last_reset), r.median_days) == (3, 1, "2024-01-15", 6.5)
    empty = mo.monitor_stats(mo.monitor_marks(events.limit(0)), NOW).first()
    assert (empty.resets, empty.credits, empty.last_reset, empty.median_days) == (0, 0, None, None)


def test_version(spark):
    rows = [("a", hours(1), "confirmed"), ("b", hours(1), None), ("c", hours(9), "likely")]
    version = lambda r, outage: mo.monitor_version(spark.createDataFrame(r, "event_id string, updated_at timestamp, presented string"), F.lit(outage).cast("string")).first().version
    first = version(rows, None)
    assert len(first) == 16 and version(rows[::-1], None) == first
    assert len({first, version(rows, "p"), version(rows[:2], None), version([("a", hours(1), "announced"), *rows[1:]], None), version([("a", hours(2), "confirmed"), *rows[1:]], None)}) == 5


def test_findings(spark):
    make = spark.createDataFrame

    def found(articles=(), sources=((True,),), reports=((("daily"), NOW.date()),), backups=((hours(1), True),), receipts=(), jobs=(), fetches=(), now=NOW, **more):
        frames = (make(list(articles), "discovered_at timestamp, state string, error string"), make(list(sources), "enabled boolean"), make(list(reports), "kind string, day date"), make(list(backups), "at timestamp, uploaded boolean"), make(list(receipts), "status string, service string, purpose string"), make(list(jobs), "name string, state string, start_after timestamp"), make(list(fetches), "source_key string, ok boolean, last_ok timestamp"))
        return {r.key: (r.level, r.detail, r.since) for r in mo.findings(now, *frames, **more).collect()}

    fresh = (hours(1), "done", None)
    assert found([fresh]) == {}
    assert found() == {"content.collect": ("now", "nothing new for 360 minutes", None)} and found(sources=[(False,)]) == {}
    assert found([(hours(7), "done", None)])["content.collect"][2] == hours(7)
    assert found(started=hours(0.1)) == {} and "content.collect" in found(started=hours(0.1), restarts=3)
    assert found([fresh, *[(hours(3), "new", None)] * 10])["content.process"] == ("now", "waiting 10, failed 0", hours(3)) and "content.process" not in found([fresh, *[(hours(3), "new", None)] * 9])
    assert found([fresh, *[(hours(2), "failed", None)] * 20])["content.process"] == ("now", "waiting 0, failed 20", None)
    assert "report.daily" in found([fresh], reports=[]) and "report.daily" not in found([(datetime(2024, 1, 20, 1), "done", None)], reports=[], now=datetime(2024, 1, 20, 1, 30))
    assert found([fresh], backups=[])["backup.stale"][1] == "no backup yet" and "backup.stale" in found([fresh], backups=[(hours(40), True)]) and "backup.stale" in found([fresh], backups=[(hours(1), False), (hours(2), True)])
    assert set(found([fresh], backups=[(hours(51), True)])) == {"backup.failed"}
    assert found([fresh], receipts=[("unknown", "b", "p"), ("unknown", "a", "p"), ("unknown", "a", "p"), ("ok", "z", "p")])["receipts.unknown"][1] == "3 a/p,b/p"
    jobs = [("q", "created", hours(3)), ("q", "retry", hours(1)), ("q", "done", hours(9)), ("cron.x", "created", hours(9)), ("later", "created", hours(-1)), ("short", "created", hours(1))]
    assert found([fresh], jobs=jobs) == {"queue.q": ("digest", "2 waiting", hours(3))}
    assert found([fresh], fetches=[("b", False, hours(27)), ("a", False, hours(30)), ("c", True, hours(99)), ("d", False, hours(1)), ("e", False, None)])["leaderboard.fetch"] == ("digest", "a,b", hours(30))
