"""Choices on cases: representatives, related facts, qualification, due sources, addresses, flags."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswarp.operators import choices as ch

DAY = datetime(2024, 1, 10)


def test_representatives(spark):
    rows = [
        ("m", "a", "Model One", "model-one", 5, "OTHER", None), ("m", "a", "other", "model-one", 5, "OTHER", None), ("m", "a", "low", "model-one", 1, "FIRST_PARTY", None), ("m", "a", "top", "model-one", 9, "OTHER", "mixed"), ("m", "b", "x y", "model-one", 2, "FIRST_PARTY", None), ("m", "b", "x-y", "model-one", 2, "OTHER", None),
        ("m", "c", "Longer Name", "zz", 1, "SCAFFOLDED", None), ("m", "c", "Short", "zz", 1, "SCAFFOLDED", None), ("m", "d", "gone", "zz", 1, "OTHER", "why"), ("m", "e", "Model One", "model-one", 1, "OTHER", None), ("m", "e", "Aa", "model-one", 1, "OTHER", None),
    ]
    frame = spark.createDataFrame(rows, "model_id string, metric_key string, source_model_name string, model_slug string, rank int, kind string, ineligible string")
    got = {(r.metric_key, r.source_model_name): (r.selected, r.selection_reason) for r in ch.representatives(frame).collect()}
    assert {k for k, (s, _) in got.items() if s} == {("a", "other"), ("b", "x y"), ("c", "Short"), ("e", "Model One")}
    assert got["a", "top"] == (False, "mixed") and got["a", "other"][1] == "default" and got["b", "x y"][1] == "first-party" and got["c", "Short"][1] == "scaffolded" and got["c", "Longer Name"][1] == "scaffolded-lower" and got["a", "low"][1] == "lower-priority" and got["d", "gone"] == (False, "why")


def test_related_facts(spark):
    posts = spark.createDataFrame([(1, "u", "5", "https://x.com/b/status/6?s=1"), (2, "u", None, None), (3, None, "9", "nothing"), (4, "v", "5", "https://x.com/b/status/5")], "article_id int, url string, reply_to string, quoted_url string")
    at = lambda d: DAY + timedelta(days=d)
    rows = [(1, "u", None, 10, at(0), True), (2, "u", None, 20, at(1), True), (8, "u", None, 30, at(-1), False), (5, "w", "x:5", 50, at(3), True), (6, "w", "x:6", 60, at(2), True), (7, None, "x:6", 50, at(1), True), (4, "v", "x:4", 40, at(0), True), (9, None, "x:9", 90, at(0), False)]
    members = spark.createDataFrame(rows, "article_id int, url string, identity_key string, fact_id int, created_at timestamp, trusted boolean")
    got = {r.article_id: (r.same_url, r.referenced) for r in ch.related_facts(posts, members).collect()}
    assert got == {1: (20, [50, 60]), 2: (10, []), 3: (None, []), 4: (None, [50])}


def test_qualified_models(spark):
    units = spark.createDataFrame([("a", 1.0, "f1", "o1", "broad"), ("b", 1.0, "f2", "o2", "code"), ("c", 0.0, "f3", "o3", "math")], "unit string, weight double, family string, operator string, budget string")
    signals = spark.createDataFrame([(u, m) for m, us in {"x": "abb", "y": "a", "z": "ac", "k": "ab", "l": "ab", "old": "ab", "new": "ab"}.items() for u in us], "unit string, model string")
    models = spark.createDataFrame([("old", DAY - timedelta(days=900)), ("new", DAY)], "model string, released timestamp")
    found = lambda **x: {r.model for r in ch.qualified_models(signals, units, models, ["k", "l"], DAY - timedelta(days=500), **({"sources": 2, "families": 2, "operators": 2, "categories": 1, "direct_anchors": 2} | x)).collect()}
    assert found() == {"x", "new"} and found(direct_anchors=1) == {"x", "new", "k", "l"} and found(sources=3) == set() and found(categories=2) == set() and found(sources=1, families=1, operators=1, categories=0) == {"x", "y", "z", "new"}


def test_due_sources(spark):
    rows = [(1, True, "rss", DAY), (2, True, "rss", None), (3, False, "rss", None), (4, True, "mp", None), (5, True, "rss", DAY + timedelta(seconds=1)), (6, True, "web", DAY - timedelta(days=1)), (7, None, "rss", None)]
    frame = spark.createDataFrame(rows, "source_id int, enabled boolean, kind string, next_fetch_at timestamp")
    assert [r.source_id for r in ch.due_sources(frame, ["rss", "web"], DAY, 9).collect()] == [2, 6, 1] and [r.source_id for r in ch.due_sources(frame, ["rss", "web"], DAY, 9, F.col("source_id") == 6).collect()] == [2, 1]


def test_addresses():
    assert ch.addresses_in('{"a": ["https://x/1", "no", {"b": "HTTP://y/2 "}], "c": "https://x/1", "d": "https://x/p.PNG?z", "e": 3, "https://key/": null}') == ["https://x/1", "HTTP://y/2"]
    assert ch.addresses_in("") == ch.addresses_in("no json") == ch.addresses_in("[" * 9000) == [] and ch.addresses_in('"https://x"') == ["https://x"]
    assert len(ch.addresses_in(str([f"https://x/{k}" for k in range(500)]).replace("'", '"'))) == ch.MOST_ADDRESSES


def test_flags(spark):
    names = "participation_mode relevance title summary judged_selected tier site_fulltext syndicate_fulltext body_status has_body visibility indexed_at excluded_at".split()
    good = dict(zip(names, ["editorial", "pass", "中文标题", "概述", True, "T1", True, True, "ok", True, "public", None, None]))
    changes = [{}, {"participation_mode": "signal"}, {"title": None}, {"summary": "summary_zh:"}, {"tier": "EXCLUDE_MP"}, {"judged_selected": None}, {"body_status": "pending"}, {"syndicate_fulltext": None}, {"title": "English"}, {"title": "English", "indexed_at": DAY}, {"excluded_at": DAY}, {"visibility": "hidden"}, {k: None for k in names}]
    schema = ", ".join(f"{n} {'boolean' if n in ('judged_selected', 'site_fulltext', 'syndicate_fulltext', 'has_body') else 'timestamp' if n.endswith('_at') else 'string'}" for n in ["k", *names]).replace("k string", "k int", 1)
    rows = spark.createDataFrame([(k, *(good | c).values()) for k, c in enumerate(changes)], schema)
    got = [(r.eligible, r.selectable, r.body_mode, r.redistributed, r.indexable) for r in ch.publication_flags(rows).orderBy("k").collect()]
    yes = (True, True, "full", True, True)
    no = (False, False, "full", True, False)
    assert got == [yes, no, no, no, (True, False, "full", True, False), (True, False, "full", True, False), (True, True, "summary", False, True), (True, True, "full", False, True), (True, True, "full", True, False), yes, (True, True, "full", True, False), (True, True, "full", True, False), (False, False, "summary", False, False)]
    moments = spark.createDataFrame([(True, None, DAY), (True, DAY, DAY), (True, DAY - timedelta(hours=49), DAY), (True, DAY - timedelta(hours=48), DAY), (False, None, DAY), (None, None, DAY)], "b boolean, p timestamp, d timestamp")
    assert [r[0] for r in moments.select(ch.historical(F.col("b"), F.col("p"), F.col("d"))).collect()] == [True, False, True, False, False, False]
