"""ZIP archives as a data source, and results of many publishers as rows of one kind.

``spark.read.format("zip")`` (after ``register``) reads the directory at the end of each archive by range, deals entries to
partitions by their compressed size, and each partition reads only the ranges of its entries. Paths are those of Arrow's file
systems (local and shared folders, s3, gs, hdfs); several are joined by commas, and a last part may hold * and ?.

Options: ``entries`` (a pattern of names, * by default), ``mode`` (``lines``: a row a line, streamed, in UTF-8 with bad bytes replaced;
``files``: a row an entry), ``partition_bytes``.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice
from operator import itemgetter
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 16 << 20  # of compressed entries
MOST_PARTITIONS = 512  # beyond that a partition has more than its bytes
OPEN_AT_ONCE = 16  # archives whose directories are read side by side
BATCH_LINES = 1024
BUFFER = 1 << 20
MOST_COLUMNS = 64  # of a CSV entry


class _Entries(InputPartition):
    def __init__(self, own: list[tuple[str, str]]):
        super().__init__(own)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(paths: str) -> list[str]:
    """The archives that paths name, in order."""
    out = []
    for path in (p.strip() for p in paths.split(",")):
        head, tail = posixpath.split(path)
        if "*" not in tail and "?" not in tail:
            out.append(path)
            continue
        system, root = _opened(head)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and fnmatch.fnmatchcase(f.base_name, tail))
        out += [posixpath.join(head, n) for n in names]
    return out


class _Ranges(io.RawIOBase):
    """A file of any file system, read by ranges; places before its start are an error of the kind that archives expect."""

    def __init__(self, path: str):
        system, own = _opened(path)
        self.file = system.open_input_file(own)
        self.end, self.at = self.file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        place = to + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.end}[whence]
        if place < 0:
            raise OSError("a place before the file's start")
        self.at = place
        return place

    def readinto(self, buffer) -> int:
        data = self.file.read_at(min(len(buffer), max(0, self.end - self.at)), self.at) if self.at < self.end else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def _archive(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_Ranges(path), BUFFER))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.lines = options["path"], options.get("mode", "lines") == "lines"
        self.pattern, self.bytes = options.get("entries", "*"), int(options.get("partition_bytes", PARTITION_BYTES))

    def _sizes(self, path: str) -> list[tuple[str, str, int]]:
        with _archive(path) as archive:
            return [(path, e.filename, e.compress_size) for e in archive.infolist() if not e.is_dir() and fnmatch.fnmatchcase(e.filename, self.pattern)]

    def partitions(self) -> list[_Entries]:
        with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
            entries = [e for own in pool.map(self._sizes, archives(self.paths)) for e in own]
        most, out, size = max(self.bytes, sum(n for *_, n in entries) // MOST_PARTITIONS), [], 0
        for path, name, n in entries:
            if not out or size + n > most:
                out.append([])
                size = 0
            out[-1].append((path, name))
            size += n
        return [_Entries(own) for own in out] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        for path, own in groupby(partition.value, itemgetter(0)):
            with _archive(path) as archive:
                for _, name in own:
                    with archive.open(name) as entry:
                        if self.lines:
                            yield from _line_batches(path, name, entry)
                        else:
                            yield path, name, entry.read()


def _line_batches(path: str, name: str, entry: IO[bytes]) -> Iterator[pa.RecordBatch]:
    text, first = io.TextIOWrapper(entry, "utf-8", errors="replace", newline="\n"), 0
    while lines := list(islice(text, BATCH_LINES)):
        n = len(lines)
        columns = [pa.repeat(path, n), pa.repeat(name, n), pa.array(range(first, first + n), pa.int64()), pa.array([x.rstrip("\n").removesuffix("\r") for x in lines], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["archive", "entry", "line_no", "line"])
        first += n


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        lines = self.options.get("mode", "lines") == "lines"
        return "archive string, entry string, line_no bigint, line string" if lines else "archive string, entry string, data binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSource)


def csv_entries(lines: DataFrame, schema: str) -> DataFrame:
    """(archive, entry, line_no, ...): the rows of CSV entries by the names of their own first line; columns an entry lacks are null. Lines are
    records (no line ends inside fields)."""
    names = ", ".join(f"c{k} string" for k in range(MOST_COLUMNS))
    # a line is taken apart once, however many of its cells are looked at
    cells = lambda c: F.transform(F.array(F.from_csv(c, names, {"mode": "PERMISSIVE"})), lambda x: F.array(*[x[f"c{k}"] for k in range(MOST_COLUMNS)]))[0]
    head = lines.filter("line_no = 0").select(F.col("archive").alias("_a"), F.col("entry").alias("_e"), cells(F.col("line")).alias("_names"))
    rows = lines.filter("line_no > 0").join(head, (F.col("archive") == F.col("_a")) & (F.col("entry") == F.col("_e")))
    place = lambda n: F.nullif(F.array_position("_names", n), F.lit(0)).cast("int")
    wanted = [tuple(x.strip().split(" ", 1)) for x in schema.split(",")]
    picked = F.transform(F.array(cells(F.col("line"))), lambda v: F.struct(*[F.try_element_at(v, place(n)).alias(n) for n, _ in wanted]))[0]
    rows = rows.withColumn("_row", picked)
    return rows.select("archive", "entry", "line_no", *[F.col(f"_row.{n}").try_cast(t).alias(n) for n, t in wanted])


# ---- results of publishers

#: A row of results, whatever publisher it comes from.
RESULT = {
    "source_key": "string", "source_model_name": "string", "base_name": "string", "organization": "string", "released_at": "string", "configuration": "string", "metric_key": "string", "metric_name": "string",
    "raw_score": "double", "lower_bound": "double", "upper_bound": "double", "source_rank": "int", "sample_size": "bigint", "source_published_at": "string", "position": "bigint",
}


def results(rows: DataFrame, source: str, given: dict[str, Column], metrics: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Rows of one publisher as result rows. given: columns of RESULT by expression (the others are null; a base name is the model's name without
    one); metrics: for tables with a column a metric, metric_key: (metric_name, score), one row for each. Rows without a model's name or a
    finite score are left out."""
    unknown = set(given) - set(RESULT)
    if unknown:
        raise ValueError(f"no columns of results: {sorted(unknown)}")
    own = given | {"source_key": F.lit(source)}
    if metrics is not None:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), s.cast("double").alias("s")) for k, (n, s) in metrics.items()]))
        rows = rows.select("*", each.alias("_m"))
        own |= {"metric_key": F.col("_m.k"), "metric_name": F.col("_m.n"), "raw_score": F.col("_m.s")}
    own.setdefault("base_name", own["source_model_name"])
    out = rows.select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in RESULT.items()])
    score = F.col("raw_score")
    return out.filter((F.trim("source_model_name") != "") & score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))


def united(frames: list[DataFrame]) -> DataFrame:
    """All publishers' rows: of rows that agree in source, model, configuration and metric the first (by position) stands; where a source states
    no rank in a metric, rows have the rank by score, equal scores the same one."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    keys = ["source_key", "source_model_name", "configuration", "metric_key"]
    first = every.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in every.columns if c not in keys]), F.struct(F.col("position").isNull(), "position", -F.col("raw_score"))).alias("r"))
    rows = first.select(*keys, "r.*")
    metric = Window.partitionBy("source_key", "metric_key")
    ranked = F.rank().over(metric.orderBy(F.col("raw_score").desc()))
    stated = F.max(F.col("source_rank").isNotNull()).over(metric)
    return rows.withColumn("source_rank", F.when(stated, F.col("source_rank")).otherwise(ranked)).select(*RESULT)
