"""Verdicts on candidates, on cases and in tasks of bounded size."""

import random
from collections import defaultdict

import pytest

from presswarp.operators import stories as st
from presswarp.plans.catalogue import QUERIES

CANDIDATES, VERDICTS = "post long, fact long, root boolean, score double", "post long, fact long, relation string, confidence double, at int"


def plain(candidates, verdicts):
    """One row a post, without Spark."""
    first, posts = {}, defaultdict(list)
    for post, fact, relation, confidence, at in sorted((v for v in verdicts if v[4] is not None), key=lambda v: v[4]):
        if post is not None and fact is not None:
            first.setdefault((post, fact), (relation, confidence))
    for post, fact, root, score in candidates:
        relation, confidence = first.get((post, fact), (None, None))
        posts[post].append((fact, root, (score is not None, score), relation or "UNRELATED", confidence or 0.0))
    out = {}
    for post, rows in posts.items():
        best = lambda found, key: max(found, key=key)[0] if found else None
        same = best([r for r in rows if r[3] == "SAME_OCCURRENCE"], lambda r: (r[4], r[2], -r[0]))
        story = [r for r in rows if r[3] == "SAME_STORY"]
        near = lambda r: (r[2], -r[0])
        reaction = best([r for r in story if r[4] >= 0.8], near)
        out[post] = (same, best([r for r in story if r[1]], near), all(r[3] == "ROUNDUP" for r in rows), reaction if same is None else same)
    return out


def got(rows):
    rows = rows.collect()
    found = {r.post: (r.same, r.joins, r.roundup, r.reacts) for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed):
    """Posts of a few facts and one of most, copies, keys, scores and relations that are null, candidates without verdicts and the reverse."""
    rng = random.Random(seed)
    kinds = ["SAME_OCCURRENCE", "SAME_STORY", "SAME_STORY", "ROUNDUP", "ROUNDUP", "UNRELATED", "other", None]
    post = lambda: rng.choice([7, 7, None, *range(120)])
    candidates = [(post(), rng.randrange(300), rng.choice([True, False, None]), rng.choice([None, 0.0, 0.25, 0.5])) for _ in range(600)]
    candidates += rng.sample(candidates, 100) + [(p, f, not r, 0.75) for p, f, r, _ in rng.sample(candidates, 50)] + [(3, None, True, 1.0), (500, None, False, None), (501, 9, True, None)]
    places = sorted({(c[0], c[1]) for c in candidates if c[1] is not None and c[0] != 501}, key=str)
    verdicts = [(p, f, rng.choice(kinds), rng.choice([None, 0.5, 0.8, 0.9]), at) for at in (1, 2, None) for p, f in rng.sample(places, 400)]
    verdicts += [(p, 1000, "SAME_OCCURRENCE", 1.0, 1) for p in range(20)] + [(3, None, "SAME_OCCURRENCE", 1.0, 1), (500, None, "ROUNDUP", 1.0, 1), (501, 9, "SAME_STORY", 0.8, 1), (999, 1, "SAME_STORY", 0.8, 1)]
    return candidates, verdicts


@pytest.mark.parametrize("tasks", [None, 1, 7])
def test_judged(spark, tasks):
    candidates, verdicts = random_rows(3)
    c, v = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(verdicts, VERDICTS)
    more = {} if tasks is None else {"tasks": tasks}
    assert got(st.judged(c, v, **more)) == plain(candidates, verdicts)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """A task has about TASK_ROWS rows whatever the input; it doesn't grow with a fixed number of partitions."""
    monkeypatch.setattr(st, "TASK_ROWS", 50)
    candidates, verdicts = random_rows(4)
    out = st.judged(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(verdicts, VERDICTS))
    assert out.rdd.getNumPartitions() == -(-(len(candidates) + len(verdicts)) // 50)
    assert got(out) == plain(candidates, verdicts)


def test_lines_are_dealt_once(spark):
    """The query's candidates and verdicts lie as they were dealt: no exchange but that and the one by post."""
    plan = QUERIES["post_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 4 and "HashAggregate" not in plan
