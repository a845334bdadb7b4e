"""Facts derived from tables that change, kept up to date batch by batch.

``DerivedSums`` keeps sums by group: a change of a row takes what the row gave before from its old group and adds what it gives now
to the new one (signed deltas). ``InvalidatedFacts`` keeps a fact a key that is computed from several tables: a change of a column that
matters recomputes the fact of the keys concerned, and of no others.

Both write each batch to a folder of its own, named by the batch, and read only earlier ones: a batch that is run again after a
failure writes the same rows again. The work of a batch is that of the keys it changes and of the buckets of the log they are
in; ``compact`` writes the log anew with one row a key, so that it does not grow with the number of changes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16  # of the log by key: a batch reads those that its keys are in, and a task writes one; more for larger logs


class _Log:
    """A table of batches in generations: ``gen=0/<table>/batch=7``. The last generation that was finished counts."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.generation() is None:
            self.finish(0)

    def generation(self) -> int | None:
        found = [s.getPath().getName() for s in self.files.globStatus(self.path(f"{self.root}/gen=*")) or []]
        done = [int(n[4:]) for n in found if self.files.exists(self.path(f"{self.root}/{n}/_DONE"))]
        return max(done, default=None)

    def finish(self, generation: int) -> None:
        for name in self.schemas:
            self.files.mkdirs(self.path(f"{self.root}/gen={generation}/{name}"))
        self.files.create(self.path(f"{self.root}/gen={generation}/_DONE"), True).close()

    def write(self, name: str, rows: DataFrame, batch: int, by: str | None = None, generation: int | None = None) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/gen={self.generation() if generation is None else generation}/{name}/batch={batch}")

    def read(self, name: str) -> DataFrame:
        """All batches, with the column ``batch``."""
        path = f"{self.root}/gen={self.generation()}/{name}"
        schema = T.StructType([*self.schemas[name].fields, T.StructField("batch", T.LongType())])
        if not self.files.globStatus(self.path(f"{path}/batch=*")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)


def _newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")


class DerivedSums:
    """Sums of measures (whole numbers) by group over the newest live row of each key.

    Changes are rows (key, order, live, groups, measures); of a key the one with the largest order counts, in whatever order
    and batches they come; repeated changes change nothing. Rows with a null key are left out; null groups are groups; a null measure
    counts as 0. ``sums()`` has (groups, rows, measures) of groups with rows.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: str, live: str, groups: list[str], measures: list[str], buckets: int = BUCKETS):
        self.buckets = buckets
        self.key, self.order, self.live, self.groups, self.measures = key, order, live, groups, measures
        fields = {f.name: f for f in T.StructType.fromDDL(schema).fields}
        self.columns = [order, live, *groups, *measures]
        state = T.StructType([fields[c] for c in self.columns])
        rows = T.StructType([fields[key], *state.fields, T.StructField("was", state), T.StructField("bucket", T.IntegerType())])
        deltas = T.StructType([*(fields[g] for g in groups), T.StructField("rows", T.LongType()), *(T.StructField(m, T.LongType()) for m in measures)])
        self.log = _Log(spark, root, {"rows": rows, "deltas": deltas})

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One batch; the same batch may be applied again."""
        new = _newest(changes.select(self.key, *self.columns).filter(F.col(self.key).isNotNull()), self.key, self.order)
        new = new.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
        before = self.log.read("rows").filter((F.col("batch") < batch) & F.col("bucket").isin(touched))
        was = _newest(before.join(new.select(self.key), self.key, "left_semi").select(self.key, *self.columns), self.key, self.order)
        was = was.select(F.col(self.key).alias("_key"), F.struct(*self.columns).alias("was"))
        rows = new.join(was, F.col(self.key) == F.col("_key"), "left").filter(F.col("was").isNull() | (F.col(self.order) > F.col(f"was.{self.order}")))
        self.log.write("rows", rows.select(self.key, *self.columns, "was", "bucket").repartition("bucket"), batch, "bucket")
        written = self.log.read("rows").filter(F.col("batch") == batch)
        self.log.write("deltas", self._deltas(written), batch)

    def _deltas(self, rows: DataFrame) -> DataFrame:
        sides = []
        for sign, place in ((1, ""), (-1, "was.")):
            live = rows.filter(F.col(f"{place}{self.live}"))
            sides.append(live.select(*[F.col(f"{place}{g}").alias(g) for g in self.groups], F.lit(sign).cast("bigint").alias("rows"), *[(sign * F.coalesce(F.col(f"{place}{m}"), F.lit(0))).cast("bigint").alias(m) for m in self.measures]))
        sums = [F.sum(c).alias(c) for c in ("rows", *self.measures)]
        found = sides[0].unionByName(sides[1]).groupBy(*self.groups).agg(*sums)
        return found.filter(reduce(Column.__or__, [F.col(c) != 0 for c in ("rows", *self.measures)]))

    def sums(self) -> DataFrame:
        found = self.log.read("deltas").groupBy(*self.groups).agg(*[F.sum(c).alias(c) for c in ("rows", *self.measures)])
        return found.filter(F.col("rows") != 0)

    def compact(self) -> None:
        """One row a key and one a group in a new generation, which counts once both are written."""
        rows = self.log.read("rows")
        last = rows.agg(F.max("batch")).first()[0]
        if last is None:
            return
        at = self.log.generation() + 1
        newest = _newest(rows.select(self.key, *self.columns), self.key, self.order)
        newest = newest.withColumns({"was": F.lit(None).cast(self.log.schemas["rows"]["was"].dataType), "bucket": F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")})
        self.log.write("rows", newest.select(self.key, *self.columns, "was", "bucket").repartition("bucket"), last, "bucket", at)
        self.log.write("deltas", self.sums(), last, generation=at)
        self.log.finish(at)


class Watched:
    """What of a table matters: the column that says which keys, the columns whose change matters, and, where that column is not the key itself, a
    function that gives the frame (link, key) of now."""

    def __init__(self, column: str, columns: list[str], links: Callable[[], DataFrame] | None = None):
        self.column, self.columns, self.links = column, columns, links


def affected_keys(changes: DataFrame, watched: dict[str, Watched]) -> DataFrame:
    """(key) of the facts that changes touch. changes: (table, before, after), maps of columns to texts, null before an insert and after a delete.

    A row counts if it came, went, moved to another key, or changed in a column that matters; a row that moved counts for both keys.
    """
    parts = []
    for name, w in watched.items():
        own = changes.filter(F.col("table") == name)
        value = lambda side, c: F.try_element_at(side, F.lit(c))
        differs = reduce(Column.__or__, [~value(F.col("before"), c).eqNullSafe(value(F.col("after"), c)) for c in (w.column, *w.columns)])
        own = own.filter(F.col("before").isNull() | F.col("after").isNull() | differs)
        keys = own.select(F.explode(F.array_distinct(F.filter(F.array(value(F.col("before"), w.column), value(F.col("after"), w.column)), lambda k: k.isNotNull()))).alias("key"))
        if w.links is not None:
            keys = w.links().select(F.col("link").cast("string").alias("link"), F.col("key").cast("string").alias("key")).join(keys.distinct().withColumnRenamed("key", "link"), "link", "left_semi").select("key")
        parts.append(keys)
    return reduce(DataFrame.unionByName, parts).distinct()


class InvalidatedFacts:
    """A fact a key, recomputed when rows it rests on change. compute(keys) gives (key, fact) of the keys (a frame of texts) from the tables as they are;
    a key it gives nothing for has no fact any more."""

    def __init__(self, spark: SparkSession, root: str, fact: str, watched: dict[str, Watched], compute: Callable[[DataFrame], DataFrame]):
        self.watched, self.compute = watched, compute
        kind = T.StructType.fromDDL(f"fact {fact}")["fact"]
        self.log = _Log(spark, root, {"keys": T.StructType.fromDDL("key string"), "facts": T.StructType([T.StructField("key", T.StringType()), kind])})

    def apply(self, changes: DataFrame, batch: int) -> None:
        self.log.write("keys", affected_keys(changes, self.watched), batch)
        keys = self.log.read("keys").filter(F.col("batch") == batch).select("key")
        facts = self.compute(keys).select(F.col("key").cast("string").alias("_key"), "fact")
        self.log.write("facts", keys.join(facts, F.col("key") == F.col("_key"), "left").select("key", "fact"), batch)

    def facts(self) -> DataFrame:
        """(key, fact, batch): the facts, and the batch that computed each."""
        newest = self.log.read("facts").groupBy("key").agg(F.max_by(F.struct("fact", "batch"), "batch").alias("r"))
        return newest.select("key", "r.fact", "r.batch").filter(F.col("fact").isNotNull())

    def compact(self) -> None:
        last = self.log.read("facts").agg(F.max("batch")).first()[0]
        if last is not None:
            at = self.log.generation() + 1
            self.log.write("facts", self.facts().select("key", "fact"), last, generation=at)
            self.log.finish(at)


def maintain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what there is, a batch at a time."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
