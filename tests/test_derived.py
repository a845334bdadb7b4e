"""Derived facts after each batch against a full recomputation."""

import random

from pyspark.sql import functions as F

from presswarp.streaming import derived

SCHEMA = "k string, at bigint, live boolean, team string, points bigint"


def full(rows):
    """The newest row of each key, summed by group."""
    newest = {}
    for k, at, live, team, points in rows:
        if k is not None and (k not in newest or at > newest[k][0]):
            newest[k] = (at, live, team, points)
    out = {}
    for _, live, team, points in newest.values():
        if live:
            n, s = out.get(team, (0, 0))
            out[team] = (n + 1, s + (points or 0))
    return out


def test_sums_after_each_batch(spark, tmp_path):
    rng = random.Random(5)
    make = lambda: derived.DerivedSums(spark, f"file://{tmp_path}/sums", SCHEMA, "k", "at", "live", ["team"], ["points"], 3)
    facts, seen, at = make(), [], list(range(1000))
    rng.shuffle(at)
    for batch in range(5):
        rows = [(rng.choice([None, *"abcdefgh"]), at.pop(), rng.random() < 0.8, rng.choice([None, "x", "y", "z"]), rng.choice([None, 1, 5, -3])) for _ in range(12)]
        rows += rng.sample(seen, min(len(seen), 3))  # repeated and late ones
        seen += rows
        frame = spark.createDataFrame(rows, SCHEMA)
        facts.apply(frame, batch)
        if batch == 1:
            facts.apply(frame, batch)  # run again after a failure
        if batch == 2:
            facts.compact()
            facts = make()
        got = {r.team: (r.rows, r.points) for r in facts.sums().collect()}
        assert got == full(seen), batch
    facts.apply(spark.createDataFrame([(k, 10**6, False, None, None) for k in "abcdefgh"], SCHEMA), 9)
    assert facts.sums().count() == 0
    facts.apply(spark.createDataFrame([], SCHEMA), 10)
    assert facts.sums().count() == 0


def test_stream_of_changes(spark, tmp_path):
    rows = [(f"k{j % 5}", j, j % 7 != 0, f"t{j % 3}", j) for j in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    facts = derived.DerivedSums(spark, f"file://{tmp_path}/facts", SCHEMA, "k", "at", "live", ["team"], ["points"])
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    derived.maintain(stream(), facts.apply, f"{tmp_path}/state")
    assert {r.team: (r.rows, r.points) for r in facts.sums().collect()} == full(rows)
    more = [("k9", 100, True, "t1", 7), ("k0", 101, False, None, None)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    derived.maintain(stream(), facts.apply, f"{tmp_path}/state")  # goes on where it stopped
    assert {r.team: (r.rows, r.points) for r in facts.sums().collect()} == full(rows + more)


def test_facts_of_the_keys_concerned(spark, tmp_path):
    tables = {"article": {"1": ("s1", "a"), "2": ("s1", "b"), "3": ("s2", "c")}, "source": {"s1": "on", "s2": "off"}}
    asked = []

    def frames():
        return spark.createDataFrame([(k, *v) for k, v in tables["article"].items()], "key string, source string, body string"), spark.createDataFrame(list(tables["source"].items()), "source string, mode string")

    def compute(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        a, s = frames()
        return a.join(keys, "key", "left_semi").join(s, "source").select("key", F.concat("body", F.lit(":"), "mode").alias("fact"))

    watched = {"article": derived.Watched("id", ["source", "body"]), "source": derived.Watched("id", ["mode"], lambda: frames()[0].select(F.col("source").alias("link"), "key"))}
    facts = derived.InvalidatedFacts(spark, f"file://{tmp_path}/facts", "string", watched, compute)
    kind = "table string, before map<string,string>, after map<string,string>"

    def step(batch, changes, want):
        facts.apply(spark.createDataFrame(changes, kind), batch)
        everything = {k: f"{body}:{tables['source'][source]}" for k, (source, body) in tables["article"].items()}
        assert {r.key: r.fact for r in facts.facts().collect()} == everything
        assert asked[-1] == want

    row = lambda k, s, b, **more: {"id": k, "source": s, "body": b, **more}
    step(0, [("article", None, row(k, *v)) for k, v in tables["article"].items()], ["1", "2", "3"])
    step(1, [("article", row("1", "s1", "a", views="1"), row("1", "s1", "a", views="2")), ("other", None, {"id": "1"})], [])
    tables["source"]["s1"] = "off"
    step(2, [("source", {"id": "s1", "mode": "on"}, {"id": "s1", "mode": "off"})], ["1", "2"])
    tables["article"]["2"] = ("s2", "B")
    del tables["article"]["3"]
    step(3, [("article", row("2", "s1", "b"), row("2", "s2", "B")), ("article", row("3", "s2", "c"), None)], ["2", "3"])
    tables["article"]["4"] = tables["article"].pop("1")
    step(4, [("article", row("1", "s1", "a"), row("4", "s1", "a"))], ["1", "4"])
    facts.compact()
    assert {r.key for r in facts.facts().collect()} == {"2", "4"}
