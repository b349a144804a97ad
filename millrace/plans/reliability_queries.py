"""Reliability measures over order lines: delay in days against the plan, returns as cancellations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import canonical_pair, on_time_flags, safe_rate, unless
from millrace.operators import metrics
from millrace.plans.registry import Tables, facts, query

_DONE = "(NOT cancelled AND delay IS NOT NULL)"
_COUNTS = f"""count(*) AS scheduled, count(*) FILTER (WHERE {_DONE}) AS completed, count(*) FILTER (WHERE cancelled) AS cancelled,
  {", ".join(f"count(*) FILTER (WHERE {_DONE} AND delay <= {t}) AS on_time_{t}" for t in (5, 10, 15, 30))},
  round(quantile_cont(delay, 0.5) FILTER (WHERE {_DONE}), 2) AS median_delay, round(quantile_cont(delay, 0.9) FILTER (WHERE {_DONE}), 2) AS p90_delay,
  round(quantile_cont(delay, 0.95) FILTER (WHERE {_DONE}), 2) AS p95_delay, round(avg(delay) FILTER (WHERE {_DONE}), 4) AS mean_delay"""
_RATES = "round(cancelled / nullif(scheduled, 0), 6) AS cancelled_rate, round(completed / nullif(scheduled, 0), 6) AS completion_rate, " + ", ".join(f"round(on_time_{t} / nullif(completed, 0), 6) AS on_time_rate_{t}" for t in (5, 10, 15, 30))
_ROUTE = "CASE WHEN origin = destination THEN origin || ' ring service' ELSE least(origin, destination) || ' - ' || greatest(origin, destination) END"


def _grouped(by: str, having: str = "") -> str:
    return f"WITH {{facts}}, g AS (SELECT {by}, {_COUNTS} FROM facts GROUP BY ALL {having}) SELECT *, {_RATES} FROM g"


@query(f"WITH {{facts}}, g AS (SELECT {_COUNTS} FROM facts) SELECT *, {_RATES} FROM g")
def reliability_overall(t: Tables) -> DataFrame:
    return metrics.reliability(facts(t), [])


@query(_grouped("region, service"))
def reliability_by_region(t: Tables) -> DataFrame:
    return metrics.reliability(facts(t), ["region", "service"])


_SETS = [["month"], ["weekday"], ["service"], ["region"]]


@query(
    f"""WITH {{facts}}, f AS (SELECT *, strftime(day, '%Y-%m') AS month, cast(isodow(day) - 1 AS INTEGER) AS weekday FROM facts),
    g AS (SELECT month, weekday, service, region, CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(weekday) = 0 THEN 'weekday' WHEN grouping(service) = 0 THEN 'service' ELSE 'region' END AS grain, {_COUNTS}
    FROM f GROUP BY GROUPING SETS ((month), (weekday), (service), (region))) SELECT *, {_RATES} FROM g"""
)
def reliability_grouping_sets(t: Tables) -> DataFrame:
    rows = facts(t).withColumns({"month": F.date_format("day", "yyyy-MM"), "weekday": F.weekday("day")})
    return metrics.reliability_sets(rows, _SETS)


@query(
    f"""WITH {{facts}}, m AS (SELECT {_ROUTE} AS route, strftime(day, '%Y') AS month, count(*) AS n, count(delay) AS done, count(*) FILTER (WHERE delay <= 15) AS on_time FROM facts GROUP BY ALL)
    SELECT route, cast(sum(n) AS BIGINT) AS scheduled, count(on_time / nullif(done, 0)) AS months, round(stddev_pop(on_time / nullif(done, 0)), 4) AS rate_spread,
    round(avg(cast(on_time / nullif(done, 0) < 0.6 AS INTEGER)), 4) AS weak_share, cast(sum(done) AS BIGINT) AS completed, cast(sum(on_time) AS BIGINT) AS on_time, round(sum(on_time) / nullif(sum(done), 0), 6) AS on_time_rate
    FROM m GROUP BY route HAVING sum(n) >= 20"""
)
def route_consistency(t: Tables) -> DataFrame:
    rows = facts(t).withColumn("route", canonical_pair("origin", "destination"))
    return metrics.consistency(rows, "route", F.date_format("day", "yyyy"), floor=20, threshold=15, weak=0.6)


@query(_grouped("l_suppkey AS station", "HAVING count(*) >= 500"))
def station_summary(t: Tables) -> DataFrame:
    return metrics.reliability(facts(t).withColumn("station", F.col("l_suppkey")), ["station"], floor=500)


@query(_grouped("l_suppkey AS station, strftime(day, '%Y-%m') AS month, service"))
def station_month(t: Tables) -> DataFrame:
    return metrics.reliability(facts(t).withColumns({"station": F.col("l_suppkey"), "month": F.date_format("day", "yyyy-MM")}), ["station", "month", "service"])


_BAND = "CASE WHEN l_quantity <= 10 THEN '01-10' WHEN l_quantity <= 20 THEN '11-20' WHEN l_quantity <= 35 THEN '21-35' ELSE '36-50' END"


@query(
    f"""WITH {{facts}}, f AS (SELECT *, origin < destination AS forward, month(day) AS month, {_BAND} AS band FROM facts),
    g AS (SELECT forward, month, band, CASE WHEN grouping(forward) = 0 THEN 'forward' WHEN grouping(month) = 0 THEN 'month' WHEN grouping(band) = 0 THEN 'band' ELSE 'all' END AS grain, {_COUNTS}
    FROM f GROUP BY GROUPING SETS ((), (forward), (month), (band))) SELECT forward, cast(month AS INTEGER) AS month, band, grain, * EXCLUDE (forward, month, band, grain), {_RATES} FROM g"""
)
def segment_grouping_sets(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    band = F.when(q <= 10, "01-10").when(q <= 20, "11-20").when(q <= 35, "21-35").otherwise("36-50")
    rows = facts(t).withColumns({"forward": F.col("origin") < F.col("destination"), "month": F.month("day"), "band": band})
    return metrics.reliability_sets(rows, [[], ["forward"], ["month"], ["band"]])


@query(
    f"""WITH {{facts}}, f AS (SELECT *, unnest(list_concat(['all'], CASE WHEN len(hits) = 0 THEN ['none'] ELSE hits END)) AS label FROM (SELECT *, list_filter([
    CASE WHEN l_quantity < 5 THEN 'small' END, CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_extendedprice > 50000 THEN 'dear' END, CASE WHEN service = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL) AS hits FROM facts)),
    g AS (SELECT label, {_COUNTS} FROM f GROUP BY label) SELECT *, {_RATES} FROM g"""
)
def overlapping_conditions(t: Tables) -> DataFrame:
    conditions = {"small": F.col("l_quantity") < 5, "large": F.col("l_quantity") > 40, "dear": F.col("l_extendedprice") > 50000, "urgent": F.col("service") == "1-URGENT"}
    return metrics.reliability(metrics.overlapping(facts(t), conditions), ["label"])


@query(
    """WITH {facts}, j AS (SELECT l_orderkey, count(*) AS stops, bool_or(cancelled) AS any_cancelled, bool_and(cancelled) AS all_cancelled, max_by(struct_pack(d := delay), (ship_day, l_linenumber, l_partkey)).d AS last_delay FROM facts GROUP BY 1)
    SELECT count(*) AS journeys, count(*) FILTER (WHERE all_cancelled) AS cancelled, count(*) FILTER (WHERE any_cancelled AND NOT all_cancelled) AS partly_cancelled,
    count(*) FILTER (WHERE NOT all_cancelled AND last_delay IS NULL) AS missing_final, round(count(*) FILTER (WHERE any_cancelled AND NOT all_cancelled) / count(*), 6) AS partly_cancelled_rate,
    round(count(*) FILTER (WHERE NOT all_cancelled AND last_delay IS NULL) / count(*), 6) AS missing_final_rate FROM j"""
)
def headline_missing(t: Tables) -> DataFrame:
    last = F.max_by(F.struct("delay"), F.struct("ship_day", "l_linenumber", "l_partkey"))["delay"]
    j = facts(t).groupBy("l_orderkey").agg(F.bool_or("cancelled").alias("any"), F.bool_and("cancelled").alias("every"), last.alias("last"))
    partly, missing = F.col("any") & ~F.col("every"), ~F.col("every") & F.col("last").isNull()
    out = j.agg(F.count(F.lit(1)).alias("journeys"), F.count_if("every").alias("cancelled"), F.count_if(partly).alias("partly_cancelled"), F.count_if(missing).alias("missing_final"))
    return out.withColumns({"partly_cancelled_rate": safe_rate("partly_cancelled", "journeys"), "missing_final_rate": safe_rate("missing_final", "journeys")})


@query(
    """WITH {facts}, b AS (SELECT * FROM (VALUES (0, '<= 0'), (1, '1..5'), (2, '6..10'), (3, '11..15'), (4, '16..30'), (5, '31..90'), (6, '> 90')) x(position, bucket)),
    c AS (SELECT (delay > 0)::INT + (delay > 5)::INT + (delay > 10)::INT + (delay > 15)::INT + (delay > 30)::INT + (delay > 90)::INT AS position, count(*) AS n FROM facts WHERE delay IS NOT NULL GROUP BY 1)
    SELECT cast(b.position AS INTEGER) AS position, bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (position)"""
)
def delay_histogram(t: Tables) -> DataFrame:
    return metrics.histogram(facts(t), "delay", [0, 5, 10, 15, 30, 90])


@query(
    """WITH {facts}, j AS (SELECT day, region, l_orderkey, max(delay) AS delay, bool_or(cancelled) AS cancelled FROM facts GROUP BY ALL),
    c AS (SELECT day, region, threshold, count(*) AS journeys, count(*) FILTER (WHERE cancelled) AS cancelled, count(*) FILTER (WHERE delay > 30) AS severe, count(*) FILTER (WHERE delay > threshold) AS delayed
    FROM j, (SELECT unnest([5, 10, 15, 30]) AS threshold) GROUP BY ALL) SELECT *, round(1 - (delayed + cancelled) / journeys, 6) AS reliability_rate FROM c"""
)
def regional_daily(t: Tables) -> DataFrame:
    return metrics.regional_daily(facts(t).withColumnRenamed("l_orderkey", "journey"))


def _mart(by: str) -> str:
    return f"WITH {{facts}} SELECT {by}, count(*) AS scheduled, count(*) FILTER (WHERE cancelled) AS cancelled, count(delay) AS completed, cast(sum(delay) AS BIGINT) AS delay_sum, {', '.join(f'count(*) FILTER (WHERE delay <= {x}) AS on_time_{x}' for x in (5, 10, 15, 30))} FROM facts GROUP BY ALL"


def additive(df: DataFrame, *by: str) -> DataFrame:
    """Counts and sums that add up over any coarser grain."""
    flags = on_time_flags("delay", F.col("delay").isNotNull())
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("scheduled"), F.count_if("cancelled").alias("cancelled"), F.count("delay").alias("completed"), F.sum("delay").alias("delay_sum"), *[F.count_if(c).alias(k) for k, c in flags.items()])


@query(_mart("day"))
def network_daily(t: Tables) -> DataFrame:
    return additive(facts(t), "day")


@query(_mart(f"{_ROUTE} AS route, service, region"))
def route_mart(t: Tables) -> DataFrame:
    return additive(facts(t).withColumn("route", canonical_pair("origin", "destination")), "route", "service", "region")


@query(_mart("l_suppkey, origin, region"))
def station_mart(t: Tables) -> DataFrame:
    return additive(facts(t), "l_suppkey", "origin", "region")


_MONITOR = """j AS (SELECT region, l_orderkey, bool_or(cancelled) AS cancelled, max(delay) AS worst FROM facts GROUP BY ALL),
    r AS (SELECT region, count(*) AS observed, count(*) FILTER (WHERE NOT cancelled AND worst IS NOT NULL) AS measured, count(*) FILTER (WHERE NOT cancelled AND worst > 15) AS delayed, count(*) FILTER (WHERE NOT cancelled AND worst > 30) AS severe,
    count(*) FILTER (WHERE cancelled) AS cancelled, avg(worst) FILTER (WHERE NOT cancelled) AS mean_delay FROM j GROUP BY region)"""


def _monitor(t: Tables) -> DataFrame:
    j = facts(t).groupBy("region", "l_orderkey").agg(F.bool_or("cancelled").alias("cancelled"), F.max("delay").alias("worst"))
    on = ~F.col("cancelled")
    return j.groupBy("region").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(on & F.col("worst").isNotNull()).alias("measured"), F.count_if(on & (F.col("worst") > 15)).alias("delayed"),
        F.count_if(on & (F.col("worst") > 30)).alias("severe"), F.count_if("cancelled").alias("cancelled"), F.avg(F.when(on, F.col("worst"))).alias("mean_delay"),
    )


@query(f"WITH {{facts}}, {_MONITOR} SELECT region, cast(sum(observed) AS BIGINT) AS observed, cast(sum(measured) AS BIGINT) AS measured, cast(sum(delayed) AS BIGINT) AS delayed, cast(sum(severe) AS BIGINT) AS severe, cast(sum(cancelled) AS BIGINT) AS cancelled FROM r GROUP BY GROUPING SETS ((region), ())")
def monitor_regions(t: Tables) -> DataFrame:
    """The network is the sum over regions: a journey counts in each region that it touches."""
    r = _monitor(t)
    return r.groupingSets([["region"], []], "region").agg(*[F.sum(c).alias(c) for c in ("observed", "measured", "delayed", "severe", "cancelled")])


@query(
    f"""WITH {{facts}}, {_MONITOR}, s AS (SELECT region, round_even(least(greatest(45 * coalesce(delayed / nullif(measured, 0), 0) + 25 * coalesce(severe / nullif(measured, 0), 0) + 20 * coalesce(cancelled / nullif(observed, 0), 0)
    + 10 * least(greatest(coalesce(mean_delay, 0), 0) / 30, 1), 0), 100), 1) AS score FROM r)
    SELECT region, score, 100 - score AS reliability, CASE WHEN score >= 25 THEN 'serious' WHEN score >= 10 THEN 'elevated' ELSE 'normal' END AS status FROM s"""
)
def disruption_score(t: Tables) -> DataFrame:
    score = metrics.disruption_score("observed", "measured", "delayed", "severe", "cancelled", "mean_delay")
    out = _monitor(t).select("region", score.alias("score"))
    return out.select("region", "score", (100 - F.col("score")).alias("reliability"), metrics.disruption_status(F.col("score")).alias("status"))


_PROBLEMS = """p AS (SELECT region, l_suppkey, count(*) AS observed, count(*) FILTER (WHERE delay > 15) AS delayed, count(*) FILTER (WHERE delay > 30) AS severe, count(*) FILTER (WHERE cancelled) AS cancellations, round(avg(delay), 4) AS mean_delay FROM facts GROUP BY ALL)"""


@query(f"WITH {{facts}}, {_PROBLEMS} SELECT * FROM p WHERE delayed + severe + cancellations > 0")
def problem_entities(t: Tables) -> DataFrame:
    return metrics.problem_entities(facts(t), ["region", "l_suppkey"], 15, top=1 << 30, severe=30).drop("place")


@query(f"WITH {{facts}}, {_PROBLEMS} SELECT *, cast(row_number() OVER (PARTITION BY region ORDER BY severe DESC, cancellations DESC, delayed DESC, mean_delay DESC NULLS LAST, l_suppkey) AS INTEGER) AS place FROM p WHERE delayed + severe + cancellations > 0 QUALIFY place <= 5")
def topk_per_group(t: Tables) -> DataFrame:
    return metrics.problem_entities(facts(t), ["region", "l_suppkey"], 15, top=5, severe=30)


@query(f"WITH {{facts}}, g AS (SELECT {_ROUTE} AS route, count(*) AS n, round(count(*) FILTER (WHERE delay <= 15) / count(delay), 6) AS rate FROM facts GROUP BY 1 HAVING count(*) >= 20) SELECT * FROM g ORDER BY rate, route LIMIT 5")
def worst_routes(t: Tables) -> DataFrame:
    rows = facts(t).withColumn("route", canonical_pair("origin", "destination")).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count("delay").alias("d"), F.count_if(F.col("delay") <= 15).alias("o"))
    return rows.filter("n >= 20").select("route", "n", safe_rate("o", "d").alias("rate")).orderBy("rate", "route").limit(5)


@query("WITH {facts} SELECT l_orderkey, bool_or(cancelled) AS any_cancelled FROM facts GROUP BY 1")
def bool_or_group(t: Tables) -> DataFrame:
    return facts(t).groupBy("l_orderkey").agg(F.bool_or("cancelled").alias("any_cancelled"))


@query("WITH {facts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, delay, " + ", ".join(f"coalesce(delay <= {t}, false) AS on_time_{t}" for t in (5, 10, 15, 30)) + " FROM facts")
def threshold_flags(t: Tables) -> DataFrame:
    return facts(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "delay", *[c.alias(k) for k, c in on_time_flags("delay", F.col("delay").isNotNull()).items()])


@query("WITH {facts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT cancelled THEN cast(date_diff('day', day, ship_day) AS INTEGER) END AS days FROM facts")
def conditional_null(t: Tables) -> DataFrame:
    return facts(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", unless("cancelled", F.datediff("ship_day", "day")).alias("days"))


@query(f"WITH {{facts}} SELECT {_ROUTE} AS route, count(*) AS n FROM facts GROUP BY 1", name="canonical_pair")
def canonical_pair_counts(t: Tables) -> DataFrame:
    return facts(t).groupBy(canonical_pair("origin", "destination").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH {facts} SELECT l_orderkey, min_by(l_suppkey, (ship_day, l_linenumber, l_partkey)) AS first_supplier, max_by(l_suppkey, (ship_day, l_linenumber, l_partkey)) AS last_supplier, min(ship_day) AS first_day, max(ship_day) AS last_day, bool_or(cancelled) AS any_cancelled FROM facts GROUP BY 1")
def first_last_by_group(t: Tables) -> DataFrame:
    order = F.struct("ship_day", "l_linenumber", "l_partkey")
    return facts(t).groupBy("l_orderkey").agg(F.min_by("l_suppkey", order).alias("first_supplier"), F.max_by("l_suppkey", order).alias("last_supplier"), F.min("ship_day").alias("first_day"), F.max("ship_day").alias("last_day"), F.bool_or("cancelled").alias("any_cancelled"))


@query("WITH {facts}, e AS (SELECT l_orderkey, min_by(origin, (ship_day, l_linenumber, l_partkey)) AS a, max_by(origin, (ship_day, l_linenumber, l_partkey)) AS b FROM facts GROUP BY 1) SELECT a || ' > ' || b AS route, count(*) AS n FROM e GROUP BY 1")
def directed_pair(t: Tables) -> DataFrame:
    order = F.struct("ship_day", "l_linenumber", "l_partkey")
    ends = facts(t).groupBy("l_orderkey").agg(F.min_by("origin", order).alias("a"), F.max_by("origin", order).alias("b"))
    return ends.groupBy(F.concat_ws(" > ", "a", "b").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH {facts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round_even(date_diff('hour', day, ship_day) / 36.0, 0) AS INTEGER) AS units FROM facts")
def delay_minutes(t: Tables) -> DataFrame:
    """Rounded half to even, as a delay in units of 36 hours."""
    hours = F.datediff("ship_day", "day") * 24
    return facts(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(hours / 36.0, 0).cast("int").alias("units"))


@query("WITH {facts} SELECT threshold, service, count(*) FILTER (WHERE delay <= threshold) AS within, count(delay) AS completed FROM facts, (SELECT unnest([5, 10, 15, 30]) AS threshold) GROUP BY ALL")
def threshold_cross(t: Tables) -> DataFrame:
    """The selected threshold is a disconnected table of four rows."""
    thresholds = F.broadcast(t.spark.createDataFrame([(x,) for x in (5, 10, 15, 30)], "threshold int"))
    counts = facts(t).groupBy("service", "delay").agg(F.count("delay").alias("n"))  # few rows before the cross join
    return counts.crossJoin(thresholds).groupBy("threshold", "service").agg(F.coalesce(F.sum(F.when(F.col("delay") <= F.col("threshold"), F.col("n"))), F.lit(0)).alias("within"), F.sum("n").alias("completed"))


@query(
    f"""WITH {{facts}}, g AS (SELECT strftime(day, '%Y-%m') AS month, {_COUNTS}, min(day) AS first_day, max(day) AS last_day, count(DISTINCT (l_orderkey, l_linenumber)) AS keys FROM facts GROUP BY 1)
    SELECT month, scheduled, completed, cancelled, on_time_15 AS on_time, completed - on_time_15 AS delayed, round(on_time_15 / nullif(completed, 0), 6) AS on_time_rate, round((on_time_15 - on_time_5) / nullif(completed, 0), 6) AS sensitivity,
    scheduled - completed - cancelled AS missing, median_delay, p90_delay, scheduled >= 200 AS enough, first_day, last_day, keys, scheduled - keys AS duplicates FROM g"""
)
def bi_measures(t: Tables) -> DataFrame:
    """The measure set of a report at a selected threshold of 15, with its sensitivity against 5."""
    rows = facts(t).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(*metrics.reliability_columns(), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys"))
    return rows.select(
        "month", "scheduled", "completed", "cancelled", F.col("on_time_15").alias("on_time"), (F.col("completed") - F.col("on_time_15")).alias("delayed"), safe_rate("on_time_15", "completed").alias("on_time_rate"),
        safe_rate(F.col("on_time_15") - F.col("on_time_5"), "completed").alias("sensitivity"), F.expr("scheduled - completed - cancelled").alias("missing"), "median_delay", "p90_delay", (F.col("scheduled") >= 200).alias("enough"),
        "first_day", "last_day", "keys", (F.col("scheduled") - F.col("keys")).alias("duplicates"),
    )


@query("WITH {facts}, d AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE delay > 15) AS late FROM facts GROUP BY 1) SELECT day, cast(sum(n) OVER w AS BIGINT) AS n_7, cast(sum(late) OVER w AS BIGINT) AS late_7, count(*) OVER w = 7 AS complete FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)")
def rolling_7d(t: Tables) -> DataFrame:
    """One row per day of history before the window runs; incomplete where a day is missing."""
    d = facts(t).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delay") > 15).alias("late"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return d.select("day", F.sum("n").over(w).alias("n_7"), F.sum("late").over(w).alias("late_7"), (F.count(F.lit(1)).over(w) == 7).alias("complete"))
