"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one only where that is unset and Spark runs in one
    process, as in tests; on a cluster an unset folder is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="presswarp-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Of one Arrow batch between Spark and Python; a row that is longer is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, so that memory does not follow the length of texts times the rows
    of a batch. A smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@cache
def _trim() -> Callable[[int], int]:
    """glibc's way to give memory back; nothing elsewhere."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """work, after which the Python worker, which Spark keeps for other tasks, gives back the memory that it no longer uses."""

    def wrapped(*given) -> Iterator[pa.RecordBatch]:
        yield from work(*given)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return wrapped


class Scratch:
    """Tables in the shared folder that cut the lineage of iterations. ``drop`` removes those that nothing reads any more; what
    the result still reads stays, for as long as the cluster keeps the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables, self.count = spark, fresh_dir(spark, name), [], 0

    def put(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.root}/{self.count}", self.count + 1
        df.write.parquet(path)
        frame = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((frame, path))
        return frame

    def drop(self, *frames: DataFrame | None) -> None:
        gone = [path for frame, path in self.tables if any(frame is x for x in frames)]
        self.tables = [(frame, path) for frame, path in self.tables if path not in gone]
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop_all(self) -> None:
        self.drop(*[frame for frame, _ in self.tables])


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(key: str, m: int) -> Column:
    """crc32 of the key's decimal text, modulo m; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % m


def hash_sample(df: DataFrame, by: str, keys: list[str], per_class: int, most_classes: int) -> DataFrame:
    """About ``per_class`` (at most 1.5 times that many, but for chance) rows of each of the ``most_classes`` largest classes,
    chosen by a hash of the keys; rows that agree in class and keys count as one.

    The classes' counts come from one aggregate; the threshold then is a plain filter, so no task gathers a class.
    """
    largest = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(by)).limit(most_classes)
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(scale))
    chosen = F.lit(False)
    for r in largest.collect():
        chosen = chosen | (F.col(by).eqNullSafe(F.lit(r[by])) & (draw < int(scale * min(1.0, 1.5 * per_class / r["n"]))))
    return df.filter(chosen).dropDuplicates([by, *keys])
