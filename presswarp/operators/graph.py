"""Connected components of an edge frame."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one only where that is unset and Spark runs in one process, as in tests; on a
    cluster an unset folder is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="presswarp-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that is reachable. Each round passes labels along the edges and then takes the label's
    own label, so the rounds grow with the logarithm of the longest path; lineage is cut through the shared folder."""
    shared_dir(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    label = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")).checkpoint()
    while True:
        passed = both.join(label, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        own = label.join(passed, F.col("node") == F.col("x")).select("node", "component", F.least("component", "m").alias("new"))
        up = label.select(F.col("node").alias("at"), F.col("component").alias("up"))
        own = own.join(up, F.col("new") == F.col("at"), "left").select("node", "component", F.least("new", F.coalesce("up", "new")).alias("new")).checkpoint()
        moved = own.filter("new <> component").limit(1).count()
        label = own.select("node", F.col("new").alias("component"))
        if not moved:
            return label
