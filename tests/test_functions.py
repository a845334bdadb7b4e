"""Functions and operators on small, hand-written rows."""

from datetime import datetime
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswarp.functions import dates, text, urls
from presswarp.operators import consensus, graph, heat, ops, reading, relational, similarity
from presswarp.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


def test_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top": "https://example.com/a/b/?a=1&b=2",
        "https://example.com": "https://example.com/",
        "https://example.com/a/": "https://example.com/a",
        "https://mp.weixin.qq.com/s?sn=4&scene=1&mid=2&__biz=1&idx=3": "https://mp.weixin.qq.com/s?__biz=1&mid=2&idx=3&sn=4",
        "ftp://example.com/": None,
        "nothing": None,
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    for r in df.select("u", "want", urls.normalise(F.col("u")).alias("got")).collect():
        assert r.got == r.want, r.u
    assert one(spark, urls.identity_key(F.lit("https://twitter.com/a/status/42?s=1"))) == "x:42"
    assert one(spark, urls.doi(F.lit("see https://doi.org/10.1000/ABC.5)."))) == "10.1000/abc.5"
    blocked = ["10.0.0.1", "127.0.0.1", "192.168.3.4", "172.20.0.1", "169.254.1.1", "224.0.0.1", "100.64.0.1", "junk"]
    open_ = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "192.169.0.1"]
    df = spark.createDataFrame([(a, True) for a in blocked] + [(a, False) for a in open_], "a string, want boolean")
    assert all(r.got == r.want for r in df.select("want", urls.blocked_address(F.col("a")).alias("got")).collect())


def test_text(spark):
    assert one(spark, text.strip_tags(F.lit("<p>a&amp;b</p><script>x</script><br>c&nbsp;d"))) == "a&b c d"
    assert one(spark, text.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.escape_xml(F.lit("<a & 'b'>\x01"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, text.infer_language(F.lit("自然资源部发布全国国土空间规划纲要"), F.lit(None).cast("string"))) == "zh"
    assert one(spark, text.infer_language(F.lit("An English title of some length"), F.lit("and a body"))) == "en"
    assert one(spark, text.infer_language(F.lit("короткий"), F.lit(None).cast("string"))) is None
    assert one(spark, text.label_only(F.lit(" **title_zh**: "))) is True
    assert one(spark, text.is_teaser(F.lit("Something happened. Read more"))) is True
    assert one(spark, text.model_slug(F.lit("GPT-4o v2.1"))) == "gpt-4-o-v-2-1"
    assert one(spark, text.bigram_overlap(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(2 / 3)
    links = one(spark, text.markdown_links(F.lit("![pic](/a.png) [A long title](https://e.com/x) [tiny](/y)")))
    assert [(r.title, r.url) for r in links] == [("A long title", "https://e.com/x")]
    tags = one(spark, text.normalised_tags(F.array(F.lit(" AI "), F.lit("quake"), F.lit("junk")), {"quake": "earthquake"}, ["ai", "earthquake"], F.lit("science")))
    assert tags == ["science", "ai", "earthquake"]


def test_quality(spark):
    body = "The storm made landfall on the coast and moved inland over the night, with heavy rain and wind. " * 3
    rows = [("Storm made landfall", body, []), ("Storm", "{{a}} {{b}} {{c}} text", ["template-shell"]), ("Some title", "short", ["too-short"]), ("Zzzz qqqq xxyy jjkk", body, ["title-body-mismatch"]), ("Cookies", "Accept All cookies " + body, ["consent-wall-only"])]
    df = spark.createDataFrame([(t, b, w) for t, b, w in rows], "t string, b string, want array<string>")
    for r in text.with_quality(df, "t", "b").collect():
        assert [x for x in r.reasons if x != "boilerplate-only" or not r.want] == r.want, r.t


def test_dates(spark):
    when = F.lit("2024-12-30 20:00:00").cast("timestamp")
    assert one(spark, dates.iso_week_label(when)) == "2025-W01"
    assert str(one(spark, dates.local_date(when))) == "2024-12-31"
    assert one(spark, dates.is_day(F.lit("2023-02-29"))) is False
    assert one(spark, dates.rfc822(when)) == "Tue, 31 Dec 2024 04:00:00 +0800"
    for shape, want in (("2024-03-05T10:00:00+02:00", datetime(2024, 3, 5, 8)), ("Tue, 5 Mar 2024 10:00:00 GMT", datetime(2024, 3, 5, 10)), ("March 5, 2024", datetime(2024, 3, 4, 16)), ("soon", None)):
        assert one(spark, dates.parse_published(F.lit(shape))) == want, shape
    assert one(spark, dates.story_status(when, F.lit("2025-01-01 00:00:00").cast("timestamp"))) == "watching"


def test_heat_windows(spark):
    """Evidence from 50 hours ago counts in the window of six hours before only."""
    at = datetime(2024, 1, 10)
    rows = [(1, k, k, True, datetime(2024, 1, 9, 20)) for k in range(3)] + [(1, 9, 9, False, datetime(2024, 1, 7, 22))]
    sig = spark.createDataFrame(rows, "story bigint, participant bigint, source bigint, editorial boolean, observed_at timestamp")
    r = heat.story_heat(sig, at).first()
    assert (r.participants, r.editorial, r.recent) == (3, 3, 3)
    assert r.heat == pytest.approx(3 * 0.5 ** (4 / 24)) and r.heat_prev == pytest.approx(0.5 ** (44 / 24))
    top = heat.hot_board(sig, at).first()
    assert (top.badge, top.trend) == ("surge", "up")
    late = heat.behind(spark.createDataFrame([(0, datetime(2024, 1, 9), 30), (1, datetime(2024, 1, 9, 23), 30), (2, None, 30)], "source bigint, last_ok timestamp, interval_minutes int"), at)
    assert {r.source: r.behind for r in late.collect()} == {0: True, 1: False, 2: True}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("b", 2, 3.0)], "k string, s int, price double")
    got = {(r.k, r.t): r.price for r in ops.as_of(left, right, ["k"], "t", "s", ["price"]).collect()}
    assert got == {("a", 5): 1.0, ("a", 10): 2.0, ("b", 1): None}


def test_peak(spark):
    for moment, want in (("2024-01-10 02:00:00", 2.0), ("2024-01-10 05:00:00", 1.0), ("2024-01-13 02:00:00", 1.0)):
        assert one(spark, ops.peak_factor(F.lit(moment).cast("timestamp"))) == want


def test_kemeny_is_best_of_all_orders():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        m = rng.normal(size=(n, n))
        m = m - m.T
        order, proven = consensus.best_order(m)
        assert proven and consensus.reversal_cost(m, order) == pytest.approx(min(c for c, _ in orders_by_force(m)))
    big = np.triu(np.ones((20, 20)), 1)
    order, proven = consensus.best_order(big - big.T)
    assert proven and order == list(range(20))


def test_normal_cdf(spark):
    got = [r.x for r in spark.createDataFrame([(0.0,), (1.96,), (-1.0,)], "v double").select(consensus.normal_cdf("v").alias("x")).collect()]
    assert got == pytest.approx([0.5, 0.9750021048517795, 0.15865525393145707], abs=1e-12)


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (60, 50)], "a bigint, b bigint")
    got = {r.node: r.component for r in graph.connected(edges).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[51] == got[60] == 50
    chain = spark.createDataFrame([(k, min(k + 1, 12)) for k in range(13)], "k bigint, to bigint")
    assert {r.target for r in relational.follow_chain(chain, "k", "to").collect()} == {12}


def test_fair_interleave(spark):
    rows = spark.createDataFrame([(k, 10 - k) for k in range(10)], "id bigint, size bigint")
    got = [r.id for r in relational.fair_interleave(rows, "id", [F.col("id").desc()], [F.col("size"), "id"], 4).orderBy("place").collect()]
    assert got == [9, 8, 7, 6]


def test_identity(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["z"])], "id bigint, keys array<string>")
    aliases = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "alias string, target string")
    got = {r.id: (r.target, r.conflict) for r in similarity.resolve_aliases(rows, aliases).collect()}
    assert got == {1: ("X", False), 2: (None, True), 3: (None, False)}


def test_ledger(spark):
    log = spark.createDataFrame([(1, "a", "upsert"), (2, "b", "upsert"), (3, "a", "remove"), (4, "c", "upsert")], "seq bigint, article string, op string")
    live = reading.snapshot(log, "article", 3)
    assert [r.article for r in live.collect()] == ["b"]
    assert {(r.seq, r.op) for r in reading.changes(log, live, "article", 1, 4).collect()} == {(2, "upsert"), (3, "remove"), (4, "remove")}


def test_readers(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('// note\n{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.jsonl_rows(spark, str(tmp_path / "rows.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "rows.csv").write_text('a,b\n1,"x ""y""\nz"\n')
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "rows.csv"), "a int, b string").collect()] == [(1, 'x "y"\nz')]
    (tmp_path / "feed.xml").write_text(f"<rss><channel><item><title> A  title </title><link>http://www.e.com/a?ref=1</link><pubDate>Tue, 5 Mar 2024 10:00:00 GMT</pubDate><description>{'word ' * 100}</description></item><item><title>B</title><link>https://e.com/b</link><description>Short. Read more</description></item></channel></rss>")
    got = {r.title: r for r in readers.feed_items(spark, str(tmp_path / "feed.xml")).collect()}
    assert got["A title"].url == "https://e.com/a" and got["A title"].body and got["A title"].published == datetime(2024, 3, 5, 10)
    assert got["B"].body is None and got["B"].excerpt
    doc = spark.createDataFrame([('{"list": [{"t": "x", "u": "https://a", "ok": true, "n": 3}, {"t": "y", "u": "", "ok": true, "n": 9}, {"t": "z", "u": "https://b", "ok": false}]}',)], "doc string")
    assert [r.t for r in readers.json_list(doc, "doc", "list", {"t": "t", "url": "u"}, "ok", ("n", 2)).collect()] == ["x"]
    pushed = spark.createDataFrame([(1, 1, "t", "https://e.com/a"), (1, 2, "t", "https://www.e.com/a/"), (1, 3, "", "https://e.com/b"), (1, 4, "t", "no")], "batch int, position int, title string, url string")
    assert {r.position: r.reason for r in readers.pushed_items(pushed).collect()} == {1: None, 2: "duplicate", 3: "no-title", 4: "bad-url"}
    pages = spark.createDataFrame([("h", "/a/b"), ("h", "/a/c"), ("g", "/x")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a", False, 0), ("h", "/a/b", True, 1), ("h", "/a/b", False, 2)], "host string, prefix string, allow boolean, position int")
    assert {(r.host, r.path): r.allowed for r in readers.robots_allowed(pages, rules).collect()} == {("h", "/a/b"): True, ("h", "/a/c"): False, ("g", "/x"): True}
    ups = spark.createDataFrame([(1, 1, 3, "d1", ""), (1, 2, 4, None, "u"), (1, 3, 2, None, "h"), (1, 4, 4, None, "v")], "page int, position int, level int, date string, text string")
    assert {r.position: r.dated for r in readers.heading_dates(ups).collect()} == {1: "d1", 2: "d1", 3: None, 4: None}


def orders_by_force(matrix):
    for order in permutations(range(len(matrix))):
        yield consensus.reversal_cost(matrix, list(order)), order


def test_stability_ranges(spark):
    """Each unit's weight up and down by a fifth and left out, every order by force."""
    rng = np.random.default_rng(12)
    names, units = [f"m{m}" for m in range(5)], ["u0", "u1", "u2"]
    rows = [(u, a, b, float(rng.uniform(-1, 1)), 1.0 + 0.37 * k) for k, u in enumerate(units) for a, b in combinations(names, 2)]
    pairs = spark.createDataFrame(rows, "unit string, a string, b string, p double, weight double")
    moved = consensus.kemeny(consensus.scenarios(pairs, units), ["scenario"])
    got = {r.model: (r.best, r.worst, r.sensitive) for r in consensus.stability(moved, consensus.kemeny(consensus.net_support(pairs))).collect()}
    ranks = {n: set() for n in names}
    for unit, factor in [("none", 1.0), *[(u, f) for u in units for f in (0.0, 0.8, 1.2)]]:
        m = np.zeros((5, 5))
        for u, a, b, p, w in rows:
            i, j, value = names.index(a), names.index(b), p * w * (factor if u == unit else 1.0)
            m[i, j] += value
            m[j, i] -= value
        for place, k in enumerate(min(orders_by_force(m))[1]):
            ranks[names[k]].add(place + 1)
    assert got == {n: (min(r), max(r), max(r) - min(r) >= 3) for n, r in ranks.items()}


def test_configuration_reads_each_descriptor_once(spark):
    """What is derived from a descriptor is bound once: its pattern is in the plan once, not in every place that looks at the tokens."""
    from presswarp.functions import rules

    plan = spark.sql("SELECT 'max, beta' AS d").select(rules.configuration(F.array("d")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("non-thinking") == 1
