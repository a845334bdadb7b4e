"""Snapshots stored on change only; rows beyond a cap; turns of orders."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswarp.operators import relational as rel
from presswarp.operators import surfaces as sf
from presswarp.sources import snapshots

DAY = datetime(2024, 1, 1)


def test_digest(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 2.5), (3, "a", float("nan"))]
    make = lambda r: spark.createDataFrame(r, "k int, a string, b double")
    one = snapshots.digest(make(rows))
    assert one.endswith(":4") and len(one) == 34
    assert snapshots.digest(make(rows[::-1]).repartition(3).select("b", "k", "a")) == one
    assert snapshots.digest(make(rows).withColumn("seen", F.rand()), ("seen",)) == one
    others = [rows[1:], rows + rows[:1], [(1, "a", None), (1, None, None), *rows[2:]], [(1, "a", 0.0), *rows[1:]], [(9, *rows[0][1:]), *rows[1:]]]
    assert len({one, *(snapshots.digest(make(o)) for o in others)}) == 6
    assert snapshots.digest(make([])) == "0" * 32 + ":0"


def test_store(spark, tmp_path):
    place = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    rows = spark.range(5).withColumn("v", F.col("id") * 2)
    assert place.latest() is None
    with pytest.raises(KeyError):
        place.read()
    assert place.store(rows, DAY, complete=False) == (None, False)
    first, changed = place.store(rows, DAY, known={"source": "x"})
    assert changed and place.read().count() == 5 and place.latest()["source"] == "x"
    assert place.store(rows.orderBy(F.desc("id")), DAY.replace(day=2)) == (first, False)
    assert (place.latest()["first_seen"], place.latest()["last_seen"]) == ("2024-01-01T00:00:00", "2024-01-02T00:00:00")
    second, changed = place.store(rows.withColumn("v", F.lit(1)), DAY.replace(day=3))
    assert changed and place.read().agg(F.sum("v")).first()[0] == 5 and place.read(first).agg(F.sum("v")).first()[0] == 20
    assert place.store(rows, DAY.replace(day=4), complete=False) == (second, False)
    assert place.store(place.read(), DAY.replace(day=5), force=True)[1] and len(place.all()) == 3
    again = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    assert [e["rows"] for e in again.all()] == [5, 5, 5]


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (snapshots.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.store(spark.range(1), DAY)
    monkeypatch.setattr(two, "_versions", lambda: [])  # it looked before the other published
    with pytest.raises(RuntimeError):
        two._publish([])
    assert one.latest()["rows"] == 1


def test_changed_rows(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (None, "n", 1)], "k int, s string, v int")
    b = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, "d", None), (None, "n", 2)], "k int, s string, v int")
    assert {(r.k, r.change) for r in snapshots.changed_rows(a, b, ["k"]).collect()} == {(2, "changed"), (3, "went"), (4, "came"), (None, "changed")}


def test_over_capacity_of_equal_rows(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 5), ("b", 3), ("b", 3), (None, 1)], "k string, v int")
    beyond = lambda cap: sorted((str(r.k), r.v) for r in sf.over_capacity(rows, [F.desc("v")], cap).collect())
    assert beyond(1) == [("None", 1), ("a", 5), ("b", 3), ("b", 3)] and beyond(3) == [("None", 1), ("b", 3)] and beyond(9) == []


def turns_by_hand(a, b, n, oldest):
    out = [oldest] if oldest is not None else []
    a, b = list(a), list(b)
    while len(out) < n and (a or b):
        for line in (a, b):
            while line and line[0] in out:
                line.pop(0)
            if line and len(out) < n:
                out.append(line.pop(0))
    return out


def test_fair_interleave(spark):
    rows = [(k, (k * 7) % 11, (k * 5) % 13) for k in range(1, 12)]
    frame = spark.createDataFrame(rows, "k int, x int, y int")
    a, b = ([r[0] for r in sorted(rows, key=lambda r: (r[c], r[0]))] for c in (1, 2))
    for n in (1, 4, 7, 20):
        for oldest in (None, 5):
            third = None if oldest is None else [F.col("k") != oldest, F.col("k")]
            found = rel.fair_interleave(frame, "k", [F.col("x"), F.col("k")], [F.col("y"), F.col("k")], n, third).orderBy("place").collect()
            assert [r.k for r in found] == turns_by_hand(a, b, n, oldest) and [r.place for r in found] == list(range(1, len(found) + 1))
    assert rel.fair_interleave(frame.limit(0), "k", [F.col("x")], [F.col("y")], 3).count() == 0
