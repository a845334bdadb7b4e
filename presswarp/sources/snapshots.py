"""Snapshots of tables that are stored only when what they say has changed.

A snapshot's digest is that of its rows as a multiset: the sums, modulo 2**64, of the two halves of each row's 128-bit hash, and the
number of rows; one aggregate, whatever the order or partitioning. Rows are hashed in canonical form: columns by name, nulls
written, columns that don't matter left out.

A snapshot's rows are written to a folder of their own first; then the list of snapshots gets a new version by one rename, which
either happens or does not. Who reads always finds a whole snapshot; a writer that failed leaves a folder that nothing names.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HALF = 1 << 64


def digest(rows: DataFrame, ignore: tuple[str, ...] = ()) -> str:
    """32 hex digits and the number of rows."""
    names = sorted(c for c in rows.columns if c not in ignore)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("")
    hashed = rows.select(F.md5(text).alias("h"))
    half = lambda at: F.sum(F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(38,0)"))
    r = hashed.agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(17).alias("b")).first()
    return f"{int(r.a or 0) % HALF:016x}{int(r.b or 0) % HALF:016x}:{r.n}"


class Snapshots:
    """The snapshots under a folder that all executors share. One writer at a time is expected; of two that write at once one fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.root}/list-*.json")) or []
        return sorted(int(s.getPath().getName()[5:-5]) for s in found)

    def all(self) -> list[dict]:
        """What is known of each snapshot, oldest first: id, digest, rows, first_seen, last_seen and what was given with it."""
        versions = self._versions()
        if not versions:
            return []
        stream = self._files.open(self._path(f"{self.root}/list-{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> dict | None:
        return next(reversed(self.all()), None)

    def _publish(self, entries: list[dict]) -> None:
        version = max(self._versions(), default=0) + 1
        draft, final = self._path(f"{self.root}/draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/list-{version}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"another writer has published version {version}")
        for old in self._versions()[:-2]:  # a reader may still hold the one before
            self._files.delete(self._path(f"{self.root}/list-{old}.json"), False)

    def store(self, rows: DataFrame, at: datetime, ignore: tuple[str, ...] = (), known: dict | None = None, complete: bool = True, force: bool = False) -> tuple[str | None, bool]:
        """(id, changed). Rows that say what the latest snapshot says are not stored; it is marked as seen. Rows that are not complete (a board that was not
        solved to its optimum, evidence that is not connected) are never published. force: store them even so."""
        latest = self.latest()
        if not complete:
            return (latest or {}).get("id"), False
        now = digest(rows, ignore)
        if latest is not None and latest["digest"] == now and not force:
            self._publish([*self.all()[:-1], latest | {"last_seen": at.isoformat()}])
            return latest["id"], False
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/rows-{name}")
        entry = {"id": name, "digest": now, "rows": int(now.rsplit(":", 1)[1]), "first_seen": at.isoformat(), "last_seen": at.isoformat(), **(known or {})}
        self._publish([*self.all(), entry])
        return name, True

    def read(self, name: str | None = None) -> DataFrame:
        """The rows of a snapshot; of the latest without a name."""
        entry = self.latest() if name is None else next((e for e in self.all() if e["id"] == name), None)
        if entry is None:
            raise KeyError(name or "no snapshot yet")
        return self.spark.read.parquet(f"{self.root}/rows-{entry['id']}")


def changed_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): keys that came, went or changed between two snapshots."""
    others = sorted(c for c in new.columns if c not in key)
    side = lambda df, name: df.select(*key, F.struct(*others).alias(name))
    a, b = side(old, "was"), side(new, "now")
    both = a.join(b, [a[k].eqNullSafe(b[k]) for k in key], "full_outer")
    change = F.when(F.col("was").isNull(), "came").when(F.col("now").isNull(), "went").otherwise("changed")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*[F.coalesce(a[k], b[k]).alias(k) for k in key], change.alias("change"))
