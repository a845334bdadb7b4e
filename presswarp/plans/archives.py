"""Archives and results: written from tables as publishers write them, and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..sources import archives
from ..sources.tables import table
from .registry import query

KEYS = 20_000  # of rows in an archive at most


def zipped(rows: DataFrame, by: str, entry: str, line: str, order: str, folder: str) -> None:
    """Writes an archive for each value of ``by``, an entry for each of ``entry``, with the lines in order; a task an archive."""

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, own in frame.sort_values(order).groupby(entry, sort=True):
                archive.writestr(name, "".join(f"{x}\n" for x in own[line]))
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{key[0]}.zip") as to:
            to.write(out.getvalue())
        return pd.DataFrame({"n": [len(frame)]})

    rows.groupBy(by).applyInPandas(work, "n bigint").agg(F.sum("n")).collect()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderstatus AS archive, o_orderpriority || '.csv' AS entry, count(*) AS lines, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(length(o_orderkey || ',' || o_custkey || ',\"a, b\"')) AS BIGINT) AS chars FROM orders GROUP BY 1, 2")
def zip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in archives of a status, an entry a priority, read back line by line, a few entries a partition. An archive has a bounded range of
    keys, as a task writes it."""
    archives.register(spark)
    place = _folder(spark, "zip")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat("o_orderpriority", F.lit(".csv")).alias("entry"), F.concat_ws(",", "o_orderkey", "o_custkey", F.lit('"a, b"')).alias("line"), "o_orderkey")
    o = o.withColumn("archive", F.concat_ws("-", "o_orderstatus", F.floor(F.col("o_orderkey") / KEYS)))
    zipped(o, "archive", "entry", "line", "o_orderkey", place)
    lines = spark.read.format("zip").option("path", f"{place}/*.zip").option("partition_bytes", 20_000).load()
    name = F.regexp_extract("archive", "([^/]+)-[0-9]+[.]zip$", 1)
    return lines.groupBy(name.alias("archive"), "entry").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.split("line", ",")[0].cast("bigint")).alias("keys"), F.sum(F.char_length("line")).alias("chars"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_name, p_retailprice, p_size FROM part),
    wide AS (SELECT 'wide' AS source_key, 'm' || p_partkey % 300 AS model, p_brand AS configuration, unnest([{'k': 'price', 's': p_retailprice, 'i': 0}, {'k': 'size', 's': CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END, 'i': 1}]) AS m, p_partkey AS position FROM p WHERE p_partkey % 2 = 0),
    rows AS (SELECT source_key, model, configuration, m.k AS metric_key, m.s AS raw_score, NULL AS stated, position FROM wide WHERE m.s IS NOT NULL
        UNION ALL SELECT 'lines', 's' || s_suppkey, NULL, 'balance', s_acctbal, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END, s_suppkey FROM supplier
        UNION ALL SELECT 'nested', n_name, NULL, 'keys', CAST(n_nationkey * 1.5 AS DOUBLE), NULL, n_nationkey FROM nation),
    f AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY source_key, model, configuration, metric_key ORDER BY position) = 1)
    SELECT source_key, model, configuration, metric_key, raw_score, CAST(CASE WHEN bool_or(stated IS NOT NULL) OVER w THEN stated ELSE rank() OVER (PARTITION BY source_key, metric_key ORDER BY raw_score DESC) END AS INTEGER) AS source_rank FROM f WINDOW w AS (PARTITION BY source_key, metric_key)""")
def united_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three publishers, a column a metric in zipped CSV files, lines of JSON, and one nested document: one kind of row."""
    archives.register(spark)
    place = _folder(spark, "results")
    p = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    size = F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("")
    line = F.concat_ws(",", F.concat(F.lit("m"), F.col("p_partkey") % 300), quoted("p_brand"), F.col("p_retailprice").cast("string"), size, F.col("p_partkey").cast("string"))
    body = p.select(F.floor(F.col("p_partkey") / KEYS).alias("archive"), F.concat(F.lit("part"), F.col("p_partkey") % 3).alias("entry"), line.alias("line"), "p_partkey")
    head = body.select("archive", "entry").distinct().select("archive", "entry", F.lit("model,brand,price,size,at").alias("line"), F.lit(-1).cast("bigint").alias("p_partkey"))
    zipped(body.unionByName(head), "archive", "entry", "line", "p_partkey", f"{place}/wide")
    wide = archives.csv_entries(spark.read.format("zip").option("path", f"{place}/wide/*.zip").load(), "model string, brand string, price double, size double, at bigint")
    s = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.struct(F.col("s_acctbal").alias("score"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("rank")).alias("eval"), F.col("s_suppkey").alias("at"))).alias("value"))
    s.write.text(f"{place}/lines")
    lines = spark.read.schema("id string, eval struct<score double, rank int>, at bigint").json(f"{place}/lines")
    n = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("value"), F.col("n_nationkey").alias("at"))).alias("rows"))).alias("value"))
    n.write.text(f"{place}/nested")
    nested = spark.read.schema("rows array<struct<name string, value double, at bigint>>").json(f"{place}/nested").select(F.inline("rows"))
    frames = [
        archives.results(wide, "wide", {"source_model_name": F.col("model"), "configuration": F.col("brand"), "position": F.col("at")}, {"price": ("Price", F.col("price")), "size": ("Size", F.col("size"))}),
        archives.results(lines, "lines", {"source_model_name": F.col("id"), "metric_key": F.lit("balance"), "raw_score": F.col("eval.score"), "source_rank": F.col("eval.rank"), "position": F.col("at")}),
        archives.results(nested, "nested", {"source_model_name": F.col("name"), "metric_key": F.lit("keys"), "raw_score": F.col("value"), "position": F.col("at")}),
    ]
    return archives.united(frames).select("source_key", F.col("source_model_name").alias("model"), "configuration", "metric_key", "raw_score", "source_rank")
