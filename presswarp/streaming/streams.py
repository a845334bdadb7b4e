"""Structured Streaming forms of the stateful operators. Each takes a streaming frame and gives a streaming frame or query."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

LATENESS = "90 minutes"  # three intervals of half an hour


def hourly_counts(events: DataFrame, time: str, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Tumbling hours by event time; an hour is final once the watermark has passed it."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, "1 hour").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))


def sliding_counts(events: DataFrame, time: str, keys: list[str], width: str = "48 hours", step: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def first_arrivals(events: DataFrame, time: str, key: str, lateness: str = LATENESS) -> DataFrame:
    """One row of each identity within the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def _timed(rows: DataFrame, time: str | None, lateness: str) -> tuple[DataFrame, str]:
    """rows with the column ``time`` and a watermark on it, and the kind of timeout; without a time, state is kept for ever."""
    if time is None:
        return rows.withColumn("time", F.lit(None).cast("timestamp")), GroupStateTimeout.NoTimeout
    return rows.withColumn("time", F.col(time)).withWatermark("time", lateness), GroupStateTimeout.EventTimeTimeout


def _keep_until(state: GroupState, times: pd.Series, keep: timedelta | None) -> None:
    """State goes once the watermark is ``keep`` past the newest row of its key."""
    if keep is not None and times.notna().any():
        newest = int(times.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest + int(keep.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))


def revisions(arrivals: DataFrame, key: str, content: str, order: str, time: str | None = None, keep: timedelta | None = None, lateness: str = LATENESS) -> DataFrame:
    """(key, content, revision): versions of an identity not seen before. The state has 128-bit digests of the versions seen; with a time and
    ``keep``, an identity that nothing came of for so long is forgotten, so the state follows what is alive and not all there ever was.

    key, content: strings; order: a number that arrivals grow in. Null contents are versions like others.
    """
    rows, kind = _timed(arrivals, time if keep is not None else None, lateness)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(content).cast("string").alias("content"), F.md5(F.coalesce(F.col(content).cast("string"), F.lit("\u0000"))).alias("digest"), F.col(order).cast("bigint").alias("at"), "time")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [], "content": [], "revision": []})
            return
        seen = list(state.get[0]) if state.exists else []
        arrived = pd.concat(list(frames))
        new = arrived.sort_values("at", kind="stable").drop_duplicates("digest")
        new = new[~new.digest.isin(seen)]
        state.update((seen + new.digest.tolist(),))
        _keep_until(state, arrived.time, keep)
        yield pd.DataFrame({"key": k[0], "content": new.content, "revision": range(len(seen) + 1, len(seen) + len(new) + 1)})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, content string, revision bigint", "seen array<string>", "append", kind)


def change_log(rows: DataFrame, key: str, payload: str, live: str, order: str, time: str | None = None, keep: timedelta | None = None, lateness: str = LATENESS) -> DataFrame:
    """(key, op, payload): upsert when a live row is new or changed, remove when it is no longer live. With a time and ``keep``, a key without rows for so long
    is forgotten: its next live row is an upsert again, which readers take as it is."""
    rows, kind = _timed(rows, time if keep is not None else None, lateness)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.when(F.col(live).cast("boolean"), F.sha2(F.col(payload).cast("string"), 256)).otherwise("").alias("want"), F.col(order).cast("bigint").alias("at"), "time")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [], "op": [], "payload": []})
            return
        arrived = pd.concat(list(frames))
        want = arrived.sort_values("at", kind="stable").want.fillna("")
        moved = want[want != want.shift(fill_value=state.get[0] if state.exists else "")]
        state.update((want.iloc[-1],))
        _keep_until(state, arrived.time, keep)
        yield pd.DataFrame({"key": k[0], "op": (moved != "").map({True: "upsert", False: "remove"}), "payload": moved.where(moved != "", None)})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, op string, payload string", "hash string", "append", kind)


def pressure(samples: DataFrame, key: str, time: str, hot: str, recovered: str, recovery: timedelta = timedelta(seconds=30), keep: timedelta = timedelta(hours=1), lateness: str = LATENESS) -> DataFrame:
    """(key, time, paused): is work held back at each sample. It is from a hot sample on, until samples have said recovered, and none otherwise, for
    ``recovery``; what is neither hot nor recovered keeps the state and starts the recovery anew. A key begins held back, and is forgotten after
    ``keep`` without samples. hot, recovered: boolean columns; a null is not."""
    rows = samples.select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.coalesce(hot, F.lit(False)).alias("hot"), F.coalesce(recovered, F.lit(False)).alias("recovered")).withWatermark("time", lateness)
    least = pd.Timedelta(recovery)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [], "time": pd.Series([], dtype="datetime64[ns]"), "paused": []})
            return
        s = pd.concat(list(frames)).sort_values("time", kind="stable").reset_index(drop=True)
        paused, since = (state.get[0], pd.Timestamp(state.get[1], unit="us") if state.get[1] is not None else None) if state.exists else (True, None)
        # a run of recovered samples begins after each other one; the first run goes on where the state ended
        well = s.recovered & ~s.hot
        run = (~well).cumsum()
        start = s.time.where(well).groupby(run).transform("min")
        if since is not None:
            start = start.where(run != 0, since)
        over = well & (s.time - start >= least)  # the pause ends here
        event = pd.Series(pd.NA, index=s.index, dtype="boolean").mask(s.hot, True).mask(over & ~s.hot, False)
        held = event.ffill().fillna(paused).astype(bool)
        last = bool(held.iloc[-1])
        begun = start.iloc[-1] if last and bool(well.iloc[-1]) else None
        state.update((last, None if begun is None else int(begun.value // 1000)))
        _keep_until(state, s.time, keep)
        yield pd.DataFrame({"key": k[0], "time": s.time, "paused": held})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, time timestamp, paused boolean", "paused boolean, since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def waiting_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, wait: timedelta = timedelta(hours=48), lateness: str = LATENESS) -> DataFrame:
    """Pairs of the same key whose right row came at most ``wait`` before the left one; state is dropped beyond that."""
    a, b = left.withWatermark(left_time, lateness).alias("a"), right.withWatermark(right_time, lateness).alias("b")
    span = F.expr(f"interval {int(wait.total_seconds())} seconds")
    near = (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}")) & (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}") - span)
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into Parquet under ``path``, and reads the result. In update and complete mode, later
    batches' rows stand for earlier ones of the same key; ``batch`` tells them apart."""
    spark = stream.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("append").parquet(f"{path}/out")

    spark.createDataFrame([], StructType([*stream.schema.fields, StructField("batch", LongType())])).write.mode("overwrite").parquet(f"{path}/out")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def state_rows(stream: DataFrame, path: str, mode: str = "append") -> list[int]:
    """Runs a stream over what there is without keeping its rows; the rows of state after each batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).format("noop").start()
    query.awaitTermination()
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]
