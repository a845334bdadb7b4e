"""The generator's numbers, and heads of pools, against plain loops."""

from pyspark.sql import functions as F

from presswarp.operators import pool


def test_generator(spark):
    s, want = 12345, []
    for _ in range(300):
        s = (s * 1664525 + 1013904223) % 2**32
        want.append(s)
    assert [r[0] for r in spark.range(300).orderBy("id").select(pool.lcg_key(F.col("id"), 12345)).collect()] == want
    far = spark.range(1).select(pool.lcg_key(F.lit(10**11), 7)).first()[0]
    a, c, state, n = 1664525, 1013904223, 7, 10**11 + 1
    while n:  # by squaring
        state, (a, c), n = (state * a + c) % 2**32 if n & 1 else state, (a * a % 2**32, (a * c + c) % 2**32), n >> 1
    assert far == state
    few = [r.id for r in pool.seeded_sample(spark.range(300), "id", 20, 12345).collect()]
    assert few == sorted(range(300), key=lambda k: want[k])[:20]


def test_heads(spark):
    cases = [(["a", "b", "c"], "a", ["a", "b", "c", "a"]), (["a", "a", "b"], "a", ["a", "a", "b"]), (["a"], "a", ["a"]), (["a", "b"], None, ["a", "b"]), (["a", "b"], "z", ["a", "b"]), ([], "a", [])]
    frame = spark.createDataFrame([(k, s, h) for k, (s, h, _) in enumerate(cases)], "k int, s array<string>, h string")
    assert [r[0] for r in frame.orderBy("k").select(pool.weight_head(F.col("s"), F.col("h"))).collect()] == [w for *_, w in cases]
