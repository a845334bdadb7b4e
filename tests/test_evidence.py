"""Evidence and readiness on cases."""

import json

from pyspark.sql import functions as F

from presswarp.operators import evidence as ev


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}").orderBy("_k").select(column).collect()]


def test_same_barring_loss(spark):
    rows = [("abc", "abc"), ("a�c", "abc"), ("abc", "a��c"), ("a��c", "abbc"), ("a c", "a   c"), ("abc", "abd"), ("abc", "ab"), (None, ""), (None, "x"), ("🌋x", "�x"), ("�", "�"), ("a�c", "x�c"), (" a�", "a� ")]
    assert values(spark, "a string, b string", rows, ev.same_barring_loss(F.col("a"), F.col("b"))) == [True, True, True, False, True, False, False, True, False, True, True, False, True]


def test_lead_item(spark):
    schema = "lead string, highlights array<struct<title: string, id: int>>, items array<struct<title: string, id: int>>"
    items = [("Quake hits the coast", 1), ("Quake hits the coast, many fled", 2), ("Rain in spring", 3), ("地震袭击沿海", 4)]
    rows = [(None, [items[2]], items), ("", [], items), ("", None, None), ("Quake hits the coast", [], items), ("quake, hits: the COAST! many", [], items), ("Rain", [], items), ("nothing like it at all", [], items), ("沿海地震", [], items), ("!?", [], items), ("x", [], items), ("Rain in spring", [], []), ("地震袭击", [], items)]
    got = values(spark, schema, rows, ev.lead_item(F.col("lead"), F.col("highlights"), F.col("items"))["id"])
    assert got == [3, 1, None, 1, 2, 3, None, 4, None, None, None, 4]


def test_priced_near(spark):
    schema = "body string, names array<string>, a decimal(14,6), b decimal(14,6)"
    far = "x" * 900
    rows = [
        ("GPT costs $0.15 and $0.60.", ["GPT"], "0.15", "0.6"), ("GPT costs 0.1500", ["GPT"], "0.15", None), ("GPT costs 0.155", ["GPT"], "0.15", None), ("GPT 12", ["GPT"], "1", None), ("GPT 1,", ["GPT"], "1", None), ("GPT 1.00", ["GPT"], "1", None),
        (f"0.15 {far} GPT", ["GPT"], "0.15", None), (f"GPT {far} 0.15 GPT", ["GPT"], "0.15", None), ("0.15 only", ["GPT"], "0.15", None), (f"A {far} B 0.15", ["A", None, " ", "B "], "0.15", None), (None, ["A"], "1", None), ("A 1", [], "1", None), ("A 1", None, "1", None), ("A\n\n 0.15", ["A"], "0.15", None), ("A10.15", ["A"], "0.15", None), ("A+ 2", ["A+"], "2", None),
    ]
    from decimal import Decimal

    rows = [(t, n, *(None if x is None else Decimal(x) for x in p)) for t, n, *p in rows]
    got = values(spark, schema, rows, ev.priced_near(F.col("body"), F.col("names"), [F.col("a"), F.col("b")]))
    assert got == [True, True, False, False, True, True, False, False, False, True, False, False, False, True, False, True]


def test_evidence(spark):
    schema = "title string, excerpt string, body string, status string, post string, quote string, evidence string"
    title = "Quake of M6.1 hits: the coast"
    rows = [
        (title, f"<p>{title}</p>", None, "ok", None, None), (title, "Quake of M6.1", None, "ok", None, None), (title, f"{title} Read more", None, "ok", None, None), (title, f"{title}. Two fled.", None, "ok", None, None), (title, "123 !!", None, "ok", None, None), (title, None, "A body with words", "ok", None, None), (title, None, "A body with words", "pending", None, None),
        (title, None, None, None, "https://t.co/x @someone", None), (title, None, None, None, "words", None), (title, None, None, None, None, "quoted words"), ("", "words", None, None, None, None), (None, None, None, None, None, None), ("标题", "<script>词</script>", None, None, None, None), ("ＡＢＣ", "abc", None, None, None, None), ("标题", "标题，点击阅读全文", None, None, None, None), ("标题", "正文", None, None, None, None),
    ]
    frame = spark.createDataFrame([(*r, "old") for r in rows], schema).coalesce(1)
    got = [r.evidence for r in ev.with_evidence(frame, "title", "excerpt", "body", "status", "post", "quote").collect()]
    assert got == [False, False, False, True, False, True, False, False, True, True, True, False, False, False, False, True]


def test_protocols_and_payloads(spark):
    rows = [("a", '{"intelligenceIndexVersion": "3.0", "editionId": "x"}'), ("a", '{"editionId": "x", "release": "r"}'), ("a", '{"editionId": "x", "datasetVersion": 2}'), ("livebench", '{"release": "2024"}'), ("a", '{"release": "2024"}'), ("a", '{"benchmarkVersion": 1}'), ("a", "{}"), ("a", None), ("a", "no json")]
    got = values(spark, "s string, m string", rows, ev.protocol(F.col("s"), F.col("m")))
    assert [g.split(":", 2)[2] for g in got] == ["intelligenceIndexVersion=3.0", "editionId=x", "editionId=x;datasetVersion=2", "release=2024", "published-schema", "benchmarkVersion=1", *["published-schema"] * 3]
    out = values(spark, "p string", [('{"a": 1, "b": null, "l": {"x": 1, "y": 2}}',), (None,)], ev.pruned(F.col("p"), "a int, b int, l struct<x: int, y: int>", ["a", "l.x"]))
    assert [o and json.loads(o) for o in out] == [{"b": None, "l": {"y": 2}}, None]


def test_report_index(spark):
    doc = json.dumps({"lead": "l", "other": 1, "sections": [{"label": "A", "items": [{"itemId": "1", "title": "t", "text": "long", "links": {"original": "o"}}, {"itemId": "2", "sourceUrl": "s", "links": {"original": "o"}}]}, {"label": "B"}]})
    one, two, none = values(spark, "d string", [(doc,), ("{}",), (None,)], ev.report_index("daily", F.col("d")))
    assert one.lead == "l" and [s.label for s in one.sections] == ["A", "B"] and [(i.itemId, i.sourceUrl) for i in one.sections[0]["items"]] == [("1", "o"), ("2", "s")] and one.sections[1]["items"] == []
    assert two.sections == [] and none.sections == []
    assert values(spark, "d string", [('{"themes": [{"heading": "H", "storyRefs": [{"itemId": "9"}]}]}',)], ev.report_index("weekly", F.col("d")))[0].themes[0].storyRefs[0].itemId == "9"
