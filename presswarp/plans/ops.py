"""Usage, latency, budgets, health and prices over ``events``, ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ops
from ..sources.tables import table
from .registry import query


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls: service = event type, model = user modulo 7, latency = value; values under 5 count as failed, 5 to 20 as refused."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("service"), (F.col("user_id") % 7).alias("model"), F.col("ts").alias("at"),
        "value", (F.col("value") < 5).alias("failed"), ((F.col("value") >= 5) & (F.col("value") < 20)).alias("refused"), (F.col("event_id") % 3 != 0).alias("billed"),
    )


CALLS = "calls AS (SELECT event_id AS id, event_type AS service, user_id % 7 AS model, ts AS moment, value, value < 5 AS failed, value >= 5 AND value < 20 AS refused, event_id % 3 <> 0 AS billed FROM events), clock AS (SELECT max(ts) AS clk FROM events)"


def now(frame: DataFrame):
    return frame.agg(F.max("at")).first()[0]


@query(f"""WITH {CALLS}, r(days) AS (VALUES (1), (7), (30), (90))
    SELECT service, days, count(*) AS calls, round(sum(value), 4) AS value FROM calls, clock, r
    WHERE date_diff('day', CAST(moment AS DATE), CAST(clk AS DATE)) BETWEEN 0 AND days - 1 GROUP BY service, days""")
def usage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return ops.usage_by_ranges(c, now(c), ["service"]).withColumn("value", F.round("value", 4))


@query(f"""WITH {CALLS}, d AS (SELECT *, CAST(moment + INTERVAL 8 HOUR AS DATE) AS day, hour(moment + INTERVAL 8 HOUR) AS hour FROM calls)
    SELECT CASE WHEN grouping(service) = 1 THEN 'all' ELSE service END AS service, CASE WHEN grouping(model) = 1 THEN 'all' ELSE CAST(model AS VARCHAR) END AS model,
           CASE WHEN grouping(day) = 1 THEN 'all' ELSE CAST(day AS VARCHAR) END AS day, CASE WHEN grouping(hour) = 1 THEN 'all' ELSE CAST(hour AS VARCHAR) END AS hour,
           count(*) AS calls, count(*) FILTER (failed) AS failed, round(avg(value), 9) AS latency
    FROM d GROUP BY GROUPING SETS ((), (service), (model), (service, model), (day), (hour), (day, service))""")
def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.timestamp_seconds(F.unix_seconds("at") + 8 * 3600)
    d = calls(spark, sf_dir).withColumn("day", F.to_date(local)).withColumn("hour", F.hour(local))
    keys = ["service", "model", "day", "hour"]
    sets = [[], ["service"], ["model"], ["service", "model"], ["day"], ["hour"], ["day", "service"]]
    grouped = d.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys))
    return grouped.agg(*[c.alias(f"__{k}") for k, c in zip(keys, ops.grouping_labels(keys), strict=True)], F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failed"), F.round(F.avg("value"), 9).alias("latency")).select(*[F.col(f"__{k}").alias(k) for k in keys], "calls", "failed", "latency")


@query(f"WITH {CALLS} SELECT CASE WHEN grouping(model) = 1 THEN -1 ELSE model END AS model, service, count(*) AS n, count(*) FILTER (failed) AS failed FROM calls GROUP BY GROUPING SETS ((service), (service, model))")
def service_health_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    grouped = c.groupingSets([[c.service], [c.service, c.model]], c.service, c.model)
    out = grouped.agg(F.grouping("model").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    return out.select(F.when(F.col("g") == 1, F.lit(-1).cast("bigint")).otherwise(F.col("model")).alias("model"), "service", "n", "failed")


@query(f"WITH {CALLS} SELECT service, model, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median, count(*) AS n FROM calls GROUP BY service, model")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latency_percentiles(calls(spark, sf_dir), ["service", "model"], "value").withColumn("median", F.round("median", 6))


@query(f"WITH {CALLS} SELECT service, round(quantile_cont(value, 0.5) FILTER (NOT failed AND NOT refused), 6) AS median FROM calls GROUP BY service")
def latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.when(~F.col("failed") & ~F.col("refused"), F.col("value"))
    return calls(spark, sf_dir).groupBy("service").agg(F.round(F.percentile(ok, 0.5), 6).alias("median"))


@query(f"""WITH {CALLS}, b AS (SELECT service, count(*) FILTER (moment > clk - INTERVAL 1 MINUTE) AS minute, count(*) FILTER (moment > clk - INTERVAL 1 HOUR AND billed) AS hour, count(*) FILTER (billed) AS day
        FROM calls, clock WHERE moment > clk - INTERVAL 1 DAY AND moment <= clk GROUP BY service),
    r AS (SELECT *, CASE WHEN minute >= 5 THEN 'minute' WHEN hour >= 3 THEN 'hour' WHEN day >= 40 THEN 'day' END AS reason FROM b)
    SELECT *, CASE reason WHEN 'minute' THEN 60 WHEN 'hour' THEN 600 WHEN 'day' THEN 3600 END AS wait_seconds FROM r""")
def budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return ops.budgets(c, now(c), {"minute": 5, "hour": 3, "day": 40})


@query(f"""WITH {CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY service, model ORDER BY moment DESC, id DESC) AS place, floor(epoch(clk)) - floor(epoch(moment)) AS age FROM calls, clock)
    SELECT service, model, bool_or(place = 1 AND refused AND age <= 3600) AS by_refusal, count(*) FILTER (failed AND age <= 120) = 2 AS by_failures FROM n WHERE place <= 2 GROUP BY service, model""")
def health_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return ops.benched(c, now(c))


@query(f"""WITH {CALLS} SELECT service, count(*) FILTER (refused) AS refused, count(*) FILTER (NOT refused AND NOT failed) AS accepted FROM calls, clock WHERE moment > clk - INTERVAL 24 HOUR
    GROUP BY service HAVING count(*) FILTER (refused) >= 10 AND count(*) FILTER (refused) * 8 > count(*) FILTER (NOT refused AND NOT failed)""")
def step_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps refused at least ten times in a day, and over an eighth as often as accepted."""
    c = calls(spark, sf_dir)
    recent = c.filter(F.unix_micros("at") > F.unix_micros(F.lit(now(c)).cast("timestamp")) - 86_400_000_000)
    out = recent.groupBy("service").agg(F.count_if("refused").alias("refused"), F.count_if(~F.col("refused") & ~F.col("failed")).alias("accepted"))
    return out.filter((F.col("refused") >= 10) & (F.col("refused") * 8 > F.col("accepted")))


@query("""SELECT regexp_replace(regexp_replace(m, '[0-9a-f]{8,}', '#', 'g'), '[0-9]+', '#', 'g') AS message, count(*) AS n, arg_max(m, event_id) AS example
    FROM (SELECT event_id, event_type || ' failed for ' || props || ' user ' || user_id AS m FROM events WHERE value < 20) GROUP BY 1""")
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value < 20")
    m = e.select("event_id", F.concat("event_type", F.lit(" failed for "), "props", F.lit(" user "), "user_id").alias("m"))
    return ops.error_groups(m, "m", "event_id")


@query("""WITH c AS (SELECT max(ts) AS clk FROM events), w AS (SELECT event_type, count(*) FILTER (ts > clk - INTERVAL 7 DAY) AS this_week, count(*) FILTER (ts <= clk - INTERVAL 7 DAY AND ts > clk - INTERVAL 14 DAY) AS last_week FROM events, c GROUP BY event_type)
    SELECT *, round(100.0 * (this_week - last_week) / nullif(last_week, 0), 4) AS change FROM w""")
def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    week = 7 * 86_400_000_000
    clk = e.agg(F.max(F.unix_micros("ts"))).first()[0]
    at = F.unix_micros("ts")
    out = e.groupBy("event_type").agg(F.count_if(at > clk - week).alias("this_week"), F.count_if((at <= clk - week) & (at > clk - 2 * week)).alias("last_week"))
    return out.withColumn("change", F.round(F.lit(100.0) * (F.col("this_week") - F.col("last_week")) / F.nullif(F.col("last_week"), F.lit(0)), 4))


@query("""SELECT s.s_suppkey, s.s_name FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_name HAVING max(l.l_shipdate) IS NULL OR max(l.l_shipdate) < (SELECT max(l_shipdate) - INTERVAL 5 DAY FROM lineitem)""")
def silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.unix_micros("l_shipdate")).alias("last"))
    clk = last.agg(F.max("last").alias("clk"))
    out = table(spark, sf_dir, "supplier").join(last, "s_suppkey", "left").crossJoin(F.broadcast(clk))  # clk is one row
    return out.filter(F.col("last").isNull() | (F.col("last") < F.col("clk") - 5 * 86_400_000_000)).select("s_suppkey", "s_name")


@query("""WITH v AS (SELECT o_custkey % 50 AS service, o_orderdate AS effective_at, max(o_totalprice) AS price FROM orders GROUP BY 1, 2),
    c AS (SELECT l_orderkey, l_linenumber, l_partkey % 60 AS service, l_shipdate, l_quantity FROM lineitem)
    SELECT c.service, count(*) AS calls, count(price) AS priced, round(sum(l_quantity * price) / 1e6, 4) AS cost FROM c ASOF LEFT JOIN v ON c.service = v.service AND c.l_shipdate >= v.effective_at GROUP BY c.service""")
def asof_price_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("service"), F.col("o_orderdate").alias("effective_at")).agg(F.max("o_totalprice").alias("price"))
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).alias("service"), "l_shipdate", "l_quantity")
    priced = ops.as_of(used, versions, ["service"], "l_shipdate", "effective_at", ["price"])
    return priced.groupBy("service").agg(F.count(F.lit(1)).alias("calls"), F.count("price").alias("priced"), F.round(F.sum(F.col("l_quantity") * F.col("price")) / 1e6, 4).alias("cost"))


@query("""WITH b AS (SELECT l_suppkey % 5 AS service, l_returnflag AS currency, l_quantity * 1000 AS tokens_in, l_discount * 5000 AS cached, CASE WHEN l_linenumber = 7 THEN 500 ELSE 0 END AS unknown_cache, l_tax * 20000 AS tokens_out,
                  CASE WHEN l_linestatus = 'O' THEN 0.4 END AS price_cached, CASE WHEN dayofweek(l_shipdate + INTERVAL 8 HOUR) BETWEEN 1 AND 5 AND (hour(l_shipdate + INTERVAL 8 HOUR) BETWEEN 9 AND 11 OR hour(l_shipdate + INTERVAL 8 HOUR) BETWEEN 14 AND 17) THEN 2.0 ELSE 1.0 END AS peak FROM lineitem),
    c AS (SELECT service, currency, (greatest(0, tokens_in - cached - unknown_cache) * 1.5 + (cached + unknown_cache) * coalesce(price_cached, 1.5) + tokens_out * 6.0) * peak / 1e6 AS cost FROM b)
    SELECT service, currency, round(sum(cost), 4) AS cost, round(sum(cost * CASE WHEN currency = 'R' THEN 7.1 ELSE 1 END), 4) AS converted FROM c GROUP BY service, currency""")
def fx_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs with a peak factor, by currency and converted."""
    li = table(spark, sf_dir, "lineitem")
    b = li.select(
        (F.col("l_suppkey") % 5).alias("service"), F.col("l_returnflag").alias("currency"), (F.col("l_quantity") * 1000).alias("tokens_in"), (F.col("l_discount") * 5000).alias("cached"),
        F.when(F.col("l_linenumber") == 7, 500).otherwise(0).alias("unknown_cache"), (F.col("l_tax") * 20000).alias("tokens_out"), F.when(F.col("l_linestatus") == "O", 0.4).alias("price_cached"),
        F.lit(1.5).alias("price_in"), F.lit(6.0).alias("price_out"), ops.peak_factor(F.col("l_shipdate")).alias("peak"),
    )
    c = b.withColumn("cost", ops.token_cost(b, F.col("peak")))
    return c.groupBy("service", "currency").agg(F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum(F.col("cost") * F.when(F.col("currency") == "R", 7.1).otherwise(1.0)), 4).alias("converted"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM d)
    SELECT user_id, CAST(median(gap) AS DOUBLE) AS gap, count(*) AS days FROM g GROUP BY user_id""")
def gap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median days between a user's active days."""
    d = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    gap = F.date_diff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day")))
    return d.withColumn("gap", gap).groupBy("user_id").agg(F.median("gap").alias("gap"), F.count(F.lit(1)).alias("days"))


@query(f"""WITH {CALLS}, s AS (SELECT service, id, CASE WHEN failed THEN 'bad' ELSE 'ok' END AS state, row_number() OVER (PARTITION BY service ORDER BY id) - row_number() OVER (PARTITION BY service, failed ORDER BY id) AS island FROM calls)
    SELECT service, state, max(n) AS longest, count(*) AS runs FROM (SELECT service, state, island, count(*) AS n FROM s GROUP BY ALL) GROUP BY service, state""")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).select("service", "id", F.when(F.col("failed"), "bad").otherwise("ok").alias("state"))
    return ops.change_runs(c, ["service"], "state", ["id"]).groupBy("service", "state").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query("""SELECT l_suppkey % 4 AS kind, l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping(l_suppkey % 4) * 4 + grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level
    FROM lineitem GROUP BY CUBE (l_suppkey % 4, l_returnflag, l_linestatus)""")
def cube_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("kind", F.col("l_suppkey") % 4)
    return li.cube("kind", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"""WITH {CALLS}, k AS (SELECT service, model, quantile_disc(value, 0.5) AS mid, count(*) AS n, count(*) FILTER (NOT failed AND NOT refused) AS accepted, count(*) FILTER (refused) AS pending FROM calls GROUP BY ALL),
    w AS (SELECT service, model, greatest(1, least(4, CAST(floor(4 * (1000 / (1000 + mid)) * pow(accepted / n, 2) / (1 + pending / n) + 0.5) AS INTEGER))) AS weight FROM k)
    SELECT service, model, CAST(unnest(range(1, weight + 1)) AS INTEGER) AS slot FROM w""")
def weighted_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a rotation as often as their weight (1 to 4): fast and accepted ones more often."""
    k = calls(spark, sf_dir).groupBy("service", "model").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("mid"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("failed") & ~F.col("refused")).alias("accepted"), F.count_if("refused").alias("pending"))
    raw = 4 * (F.lit(1000.0) / (1000 + F.col("mid"))) * F.pow(F.col("accepted") / F.col("n"), 2) / (1 + F.col("pending") / F.col("n"))
    weight = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(raw + 0.5).cast("int")))
    return k.select("service", "model", F.explode(F.sequence(F.lit(1), weight)).alias("slot"))
