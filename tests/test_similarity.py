"""Recall: against every pair, and what leaves a task."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from presswarp.operators import similarity as sim


def pairs(text):
    bare = [c for c in text if c not in "\t\n\f\r "]
    return set(zip(bare, bare[1:], strict=False))


def expected(texts, facts, least=0.25, most=10):
    out = set()
    for q in [k for k in texts if k % 5 == 0 and pairs(texts[k])]:
        best = {}
        for r in texts:
            a, b = pairs(texts[q]), pairs(texts[r])
            if r != q and b and len(a & b) / min(len(a), len(b)) >= least:
                best[facts[r]] = max(best.get(facts[r], (0, 0)), (len(a & b) / min(len(a), len(b)), -r))
        out |= {(q, f, -r, s) for f, (s, r) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:most]}
    return out


def test_lexical_recall_in_blocks(spark, monkeypatch):
    """Small blocks and matrices, facts with several rows, ties, odd blanks and characters: the result of every pair."""
    rng = random.Random(5)
    monkeypatch.setattr(sim, "TEXT_BLOCK", 20)
    monkeypatch.setattr(sim, "TEXT_CHUNK", 40)
    texts = {k: "".join(rng.choice("abcé字\U0001f600\U0010ffff \n \x0b") for _ in range(rng.randrange(0, 40))) for k in range(200)} | {200: "", 205: "a", 210: "ab", 215: "\U0010ffff\U0010ffff"}
    facts = {k: k if k % 3 else k % 7 for k in texts}
    frame = spark.createDataFrame([(k, t, facts[k]) for k, t in texts.items()], "id bigint, text string, fact bigint")
    got = sim.lexical_recall(frame.filter("id % 5 = 0"), frame).select("query", "fact", "id", "score").collect()
    assert {tuple(r) for r in got} == expected(texts, facts) and len(got) == len(set(got))


def test_recall_sends_only_the_best_from_a_task():
    """However many rows reach the least score, a query's best facts are all that is left."""
    found = {"query": np.repeat([0, 1], 1000), "id": np.tile(np.arange(1000), 2), "fact": np.tile(np.arange(1000) // 2, 2), "score": np.ones(2000)}
    best = sim._best(found, 10)
    assert best["query"].tolist() == [0] * 10 + [1] * 10 and best["fact"].tolist() == [*range(10)] * 2 and best["id"].tolist() == [*range(0, 20, 2)] * 2


def test_packed_bigrams():
    """They come back as they were, and take less than the text."""
    texts = ["", "a", "ab", "\x00\x00\x00", "zebra crossing " * 40, "字\U0010ffff\U0010ffffa"]
    codes = [sim._bigram_codes(t) for t in texts]
    numbers, counts = sim._unpacked(pa.chunked_array([pa.array([sim._packed(c) for c in part], pa.binary()) for part in (codes[:3], codes[3:])]))
    assert counts.tolist() == [len(c) for c in codes] and (numbers == np.concatenate(codes)).all()
    assert len(sim._packed(codes[4])) < 4 * len(codes[4]) < len(texts[4])


def some_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgé字\U0010ffff ") for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_lexical_recall_in_ranges_of_facts(spark, monkeypatch):
    """Edges found in one range of facts leave out nothing of the next ones, also at ties and where a fact has many rows."""
    monkeypatch.setattr(sim, "FIRST_ROWS", 20)
    texts = dict(enumerate(some_texts(300)))
    texts |= {k: "ab" if k % 4 else "abc" for k in range(100, 300, 7)}
    facts = {k: k // 2 if k % 3 else k % 50 for k in texts}
    frame = spark.createDataFrame([(k, t, facts[k]) for k, t in texts.items()], "id bigint, text string, fact bigint").repartition(3)
    assert len(sim._ranges(frame)) > 2
    got = sim.lexical_recall(frame.filter("id % 5 = 0"), frame).select("query", "fact", "id", "score").collect()
    assert {tuple(r) for r in got} == expected(texts, facts) and len(got) == len(set(got))


def test_queries_that_are_done_read_no_more_texts(spark, monkeypatch):
    """Once all queries have ten facts that share all, later texts aren't even looked at."""
    monkeypatch.setattr(sim, "FIRST_ROWS", 100)

    def text(k):
        if k >= 400:
            raise ValueError("read in vain")
        return "abcd"

    rows = spark.range(1000).select("id", F.udf(text, "string")("id").alias("text"), F.col("id").alias("fact"))
    got = sim.lexical_recall(spark.createDataFrame([(3, "abc"), (5, "xabcd")], "id bigint, text string"), rows).select("query", "fact", "score").collect()
    assert {tuple(r) for r in got} == {(q, k, 1.0) for q in (3, 5) for k in range(11) if k != q}


def test_bounds_leave_out_no_pair(monkeypatch):
    """Groups of bigrams, parts and floors: the pairs above them are those of a comparison one by one."""
    monkeypatch.setattr(sim, "SINGLE", 5)
    monkeypatch.setattr(sim, "FOLDED", 7)
    texts = [t for t in some_texts(160) if pairs(t)]
    queries, rows = texts[:40], texts[20:]
    packed = lambda x: pa.chunked_array([pa.array([sim._packed(sim._bigram_codes(t)) for t in x], pa.binary())])
    score, rng = sim._shares(packed(queries), packed(rows), 0.25), np.random.default_rng(1)
    share = np.array([[len(pairs(a) & pairs(b)) / min(len(pairs(a)), len(pairs(b))) for b in rows] for a in queries])
    for first in range(0, len(rows), 32):
        mine, other = np.flatnonzero(rng.random(len(queries)) < 0.6), slice(first, min(first + 32, len(rows)))
        floor = np.where(rng.random(len(mine)) < 0.3, -np.inf, share[mine, first])
        i, j, s = score(mine, other, floor)
        want = {(a, b) for a in range(len(mine)) for b in range(other.start, other.stop) if share[mine[a], b] >= 0.25 and share[mine[a], b] > floor[a]}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and (s == share[mine[i], j]).all()
