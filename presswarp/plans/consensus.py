"""Boards over ``lineitem``: units are suppliers modulo 9, models parts modulo 12, the score is the mean price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus, graph
from ..sources.tables import table
from .registry import query


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    unit, model = F.concat(F.lit("u"), F.col("l_suppkey") % 9), F.col("l_partkey") % 12
    g = li.groupBy(unit.alias("unit"), model.alias("model")).agg(F.round(F.avg("l_extendedprice"), 4).alias("score"), F.stddev_samp("l_extendedprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    g = g.filter("(model + cast(substring(unit, 2) as int)) % 5 <> 0")  # not every unit has every model
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return g.select("unit", "model", "score", (F.col("score") - half).alias("lower"), (F.col("score") + half).alias("upper"))


def units(spark: SparkSession) -> DataFrame:
    rows = [(f"u{k}", (k % 4 + 1) / 4, f"op{k % 3}", f"fam{k % 4}", "LOWER" if k == 8 else "HIGHER", 1.96 if k % 2 else None) for k in range(9)]
    return spark.createDataFrame(rows, "unit string, weight double, operator string, family string, direction string, interval_sd double")


SCORES = """sc AS (SELECT 'u' || (l_suppkey % 9) AS unit, l_suppkey % 9 AS k, l_partkey % 12 AS model, round(avg(l_extendedprice), 4) AS score FROM lineitem WHERE (l_partkey % 12 + l_suppkey % 9) % 5 <> 0 GROUP BY 1, 2, 3),
    ps AS (SELECT a.unit, a.k, a.model AS a, b.model AS b, CAST(sign(a.score - b.score) * CASE WHEN a.k = 8 THEN -1 ELSE 1 END AS DOUBLE) AS p, (a.k % 4 + 1) / 4 AS weight FROM sc a JOIN sc b ON a.unit = b.unit AND a.model < b.model),
    net AS (SELECT a, b, sum(weight * p) AS net, sum(weight) AS weight, count(*) AS shared FROM ps GROUP BY a, b)"""


@query(f"WITH {SCORES} SELECT unit, a, b, p, weight FROM ps")
def pair_support_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.pair_support(scores(spark, sf_dir), units(spark), ordinal=True)


@query(f"WITH {SCORES} SELECT * FROM net")
def net_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.net_support(consensus.pair_support(scores(spark, sf_dir), units(spark), ordinal=True))


@query()
def pair_support_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.pair_support(scores(spark, sf_dir), units(spark)).withColumn("p", F.round("p", 9))


@query()
def kemeny_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = consensus.net_support(consensus.pair_support(scores(spark, sf_dir), units(spark)))
    return consensus.index_values(consensus.kemeny(net), [3, 7]).select("model", "rank", "index", "optimal")


@query()
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over scenarios: without each unit and each operator, with weights moved, and by signs alone."""
    rows = scores(spark, sf_dir)
    pairs = consensus.pair_support(rows, units(spark)).cache()
    cases = consensus.scenarios(pairs, [f"u{k}" for k in range(9)], {f"u{k}": f"op{k % 3}" for k in range(9)}, consensus.pair_support(rows, units(spark), ordinal=True))
    moved = consensus.kemeny(cases, ["scenario"])
    return consensus.stability(moved, consensus.kemeny(consensus.net_support(pairs)))


@query(f"""WITH {SCORES}, r AS (SELECT model, row_number() OVER (ORDER BY sum(net) DESC, model) AS rank FROM (SELECT a AS model, net FROM net UNION ALL SELECT b, -net FROM net) GROUP BY model)
    SELECT unit, round(sum(weight * (1 + p * CASE WHEN x.rank < y.rank THEN 1 ELSE -1 END) / 2) / sum(weight), 9) AS agreement FROM ps JOIN r x ON x.model = a JOIN r y ON y.model = b GROUP BY unit""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each unit agrees with the order by net support."""
    from pyspark.sql import Window

    pairs = consensus.pair_support(scores(spark, sf_dir), units(spark), ordinal=True)
    net = consensus.net_support(pairs)
    total = net.select(F.col("a").alias("model"), "net").unionByName(net.select(F.col("b").alias("model"), (-F.col("net")).alias("net"))).groupBy("model").agg(F.sum("net").alias("s"))
    ranks = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("s").desc(), "model")))  # a row a model
    return consensus.agreement(pairs, ranks).withColumn("agreement", F.round("agreement", 9))


@query(f"""WITH {SCORES}, q AS (SELECT model, count(DISTINCT unit) AS sources, count(DISTINCT k % 3) AS operators, count(DISTINCT k % 4) AS families, sum((k % 4 + 1) / 4) AS coverage FROM sc GROUP BY model) SELECT * FROM q WHERE sources >= 7 AND operators >= 3 AND families >= 4""")
def qualify_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.qualified(scores(spark, sf_dir), units(spark), 7, 3, 4)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 400 AS a, o_orderkey % 400 + 1000 AS b FROM orders WHERE o_totalprice > 440000), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, x) AS (SELECT a, a FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.x = g.a) SELECT node, min(x) AS component FROM r GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 440000")
    return graph.connected(o.select((F.col("o_custkey") % 400).alias("a"), (F.col("o_orderkey") % 400 + 1000).alias("b")))
