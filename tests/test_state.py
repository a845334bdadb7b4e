"""Streaming state: against plain loops over several batches, and bounded once keys are no longer alive."""

import random
from datetime import datetime, timedelta


from presswarp.streaming import streams

START = datetime(2024, 1, 1)


def batches(spark, path, frames):
    """A stream that reads one of the frames a batch, in order."""
    import os
    import time

    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{path}/part{k}")
        for name in os.listdir(f"{path}/part{k}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{path}/part{k}/{name}", f"{path}/in/{k}-{name}")
                os.utime(f"{path}/in/{k}-{name}", (time.time() - 1000 + k, time.time() - 1000 + k))
    return lambda: spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_revisions_and_log_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice("abcd"), rng.choice(["x", "y", "z", None]), rng.random() < 0.7, START) for k in range(120)]
    schema = "at int, key string, content string, live boolean, time timestamp"
    frames = [spark.createDataFrame(rows[k : k + 40], schema) for k in (0, 40, 80)]
    stream = batches(spark, tmp_path, frames)
    seen, want, last, log = {}, [], {}, []
    for _, key, content, live, _ in rows:
        if content not in seen.setdefault(key, []):
            seen[key].append(content)
            want.append((key, content, len(seen[key])))
        now = content if live and content is not None else None
        if now != last.get(key):
            log.append((key, "upsert" if now else "remove"))
            last[key] = now
    got = streams.run_available(streams.revisions(stream(), "key", "content", "at"), f"{tmp_path}/r").collect()
    assert sorted(((r.key, r.content, r.revision) for r in got), key=str) == sorted(want, key=str)
    got = streams.run_available(streams.change_log(stream(), "key", "content", "live", "at", "time", timedelta(days=1)), f"{tmp_path}/l").collect()
    assert sorted((r.key, r.op) for r in got) == sorted(log) and all((r.payload is None) == (r.op == "remove") for r in got)


def test_state_is_bounded(spark, tmp_path):
    """Each batch has keys of its own, a day later; without a bound state grows with them."""
    frames = [spark.createDataFrame([(10 * b + k, f"k{b}-{k}", "x", True, START + timedelta(days=b)) for k in range(10)], "at int, key string, content string, live boolean, time timestamp") for b in range(5)]
    stream = batches(spark, tmp_path, frames)
    assert streams.state_rows(streams.revisions(stream(), "key", "content", "at"), f"{tmp_path}/a")[-1] == 50
    assert max(streams.state_rows(streams.revisions(stream(), "key", "content", "at", "time", timedelta(hours=6)), f"{tmp_path}/b")) <= 20
    assert max(streams.state_rows(streams.change_log(stream(), "key", "content", "live", "at", "time", timedelta(hours=6)), f"{tmp_path}/c")) <= 20


def paused_by_hand(samples, recovery):
    paused, healthy, out = True, None, []
    for at, hot, well in samples:
        if hot:
            paused, healthy = True, None
        if paused:
            healthy = (healthy if healthy is not None else at) if well and not hot else None
            if healthy is not None and at - healthy >= recovery:
                paused = False
        out.append((at, paused))
    return out


def test_pressure(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for key in "abc":
        at = START
        for _ in range(90):
            at += timedelta(seconds=rng.choice([4, 9, 11]))
            hot = rng.random() < 0.08
            rows.append((key, at, hot, not hot and rng.random() < 0.85))
    rows.sort(key=lambda r: r[1])
    frames = [spark.createDataFrame(rows[k : k + 60], "key string, time timestamp, hot boolean, well boolean") for k in range(0, len(rows), 60)]
    stream = batches(spark, tmp_path, frames)
    got = streams.run_available(streams.pressure(stream(), "key", "time", "hot", "well"), f"{tmp_path}/p").collect()
    want = [(key, *x) for key in "abc" for x in paused_by_hand([r[1:] for r in rows if r[0] == key], timedelta(seconds=30))]
    assert sorted((r.key, r.time, r.paused) for r in got) == sorted(want)
    assert 0.2 < sum(p for *_, p in want) / len(want) < 0.9
    quiet = [spark.createDataFrame([(f"k{b}", START + timedelta(days=b), False, True)], "key string, time timestamp, hot boolean, well boolean") for b in range(4)]
    counts = streams.state_rows(streams.pressure(batches(spark, f"{tmp_path}/q", quiet)(), "key", "time", "hot", "well"), f"{tmp_path}/s")
    assert max(counts) <= 2
