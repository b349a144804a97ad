"""A report's measures under filters and thresholds, and scores of an exported model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import measures, models
from millrace.plans.order_queries import _LINEAR, _WEIGHTS
from millrace.plans.registry import Tables, facts, query
from millrace.sources.shared import new_path, small_reads, stage

_GRAIN = ["day", "region", "service"]
_KEY = ["l_orderkey", "l_linenumber"]
_F = "f AS (SELECT *, strftime(day, '%Y-%m') AS month, CASE WHEN l_linenumber > 1 THEN cast(l_quantity AS INTEGER) % 20 END AS departure FROM facts)"


def _sql(by: str, where: str, thresholds: str) -> str:
    done = "NOT cancelled AND delay IS NOT NULL"
    rate = lambda a, b: f"round({a} / nullif({b}, 0), 6)"
    return f"""WITH {{facts}}, {_F}, x AS (SELECT unnest({thresholds}::INTEGER[]) AS threshold), g AS (SELECT {by}, threshold, count(*) AS scheduled, count(*) FILTER (WHERE {done}) AS completed, count(*) FILTER (WHERE cancelled) AS cancelled, count(*) FILTER (WHERE NOT cancelled AND delay IS NULL) AS missing,
      count(*) FILTER (WHERE {done} AND delay <= threshold) AS on_time, count(*) FILTER (WHERE {done} AND delay <= 5) AS on_time_5, round(quantile_cont(delay, 0.5) FILTER (WHERE {done}), 2) AS median_delay, round(quantile_cont(delay, 0.9) FILTER (WHERE {done}), 2) AS p90_delay,
      round(quantile_cont(delay - departure, 0.5) FILTER (WHERE {done} AND departure IS NOT NULL), 2) AS median_accumulation, min(day) AS coverage_start, max(day) AS coverage_end, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM f, x WHERE {where} GROUP BY ALL)
    SELECT *, completed - on_time AS delayed, (scheduled >= 200)::INTEGER AS enough, {rate("cancelled", "scheduled")} AS cancellation_rate, {rate("on_time", "completed")} AS on_time_rate, {rate("(completed - on_time)", "completed")} AS delay_rate, {rate("completed", "scheduled")} AS coverage,
      {rate("on_time_5", "completed")} AS on_time_rate_5, {rate("missing", "scheduled")} AS missing_rate, round({rate("on_time", "completed")} - {rate("on_time_5", "completed")}, 6) AS sensitivity, scheduled - duplicate_rows AS distinct_keys FROM g"""


def _state(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Cells and repeats, from one reading of the facts each."""
    rows = facts(t).withColumn("departure", F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("int") % 20))
    with small_reads(t.spark):
        table, again = stage(measures.cells(rows, _GRAIN, departure="departure"), "cells"), stage(measures.repeat_sets(rows, _GRAIN, _KEY), "repeats")
    month = F.date_format("day", "yyyy-MM")  # of a cell's day, and no part of its key
    return table.withColumn("month", month), again.withColumn("month", month)


@query(_sql("month, region", "service IN ('1-URGENT', '2-HIGH')", "[5, 15, 30]"))
def measures_by_month_region(t: Tables) -> DataFrame:
    """Three thresholds of one filter, from one state."""
    table, again = _state(t)
    where = F.col("service").isin("1-URGENT", "2-HIGH")
    return reduce(DataFrame.unionByName, [measures.journey_measures(table, again, ["month", "region"], x, where) for x in (5, 15, 30)])


@query(_sql("service", "region = 'ASIA' AND day >= DATE '1997-03-01' AND day < DATE '1999-07-01'", "[10]"))
def measures_by_service(t: Tables) -> DataFrame:
    """Another grain, filter and threshold from the same state."""
    where = (F.col("region") == "ASIA") & (F.col("day") >= F.lit("1997-03-01").cast("date")) & (F.col("day") < F.lit("1999-07-01").cast("date"))
    return measures.journey_measures(*_state(t), ["service"], 10, where)


@query("WITH {facts} SELECT l_suppkey, count(*) AS scheduled_arrivals, count(delay) AS completed_arrivals, count(*) FILTER (WHERE delay <= 15) AS on_time_arrivals, 15 AS threshold, round(count(*) FILTER (WHERE delay <= 15) / nullif(count(delay), 0), 6) AS station_on_time_rate, (count(*) >= 500)::INTEGER AS enough FROM facts WHERE service <> '5-LOW' GROUP BY 1")
def measures_of_stations(t: Tables) -> DataFrame:
    table = measures.cells(facts(t), ["l_suppkey", "service"])
    return measures.arrival_measures(table, ["l_suppkey"], 15, F.col("service") != "5-LOW")


@query("SELECT max(ts) AS last_retrieval, date_diff('hour', max(ts), TIMESTAMP '2024-02-03 07:59:59') AS refresh_age_hours FROM events")
def refresh_age(t: Tables) -> DataFrame:
    return measures.refresh(t.events, "ts", "2024-02-03 07:59:59")


@query(f"SELECT o_orderkey, round(1 / (1 + exp(-(1.5 * ({_LINEAR}) - 0.3))), 6) AS probability FROM orders")
def exported_scores(t: Tables) -> DataFrame:
    """A linear model with a calibration: written as an artefact, loaded, checked against its own rows, and applied."""
    prep = models.Preprocess({"o_totalprice": (250000.0, 250000.0, 140000.0)}, {"o_orderpriority": ("none", list(_WEIGHTS))})
    root = new_path(t.spark, "artefact")
    models.export(models.Artefact(prep, [0.3, *_WEIGHTS.values()], -0.5, {"type": "platt", "slope": 1.5, "intercept": -0.3}), t.orders, "o_orderkey", root)
    scored = models.load(t.spark, root).score(t.orders)
    return scored.select("o_orderkey", F.round("probability", 6).alias("probability"))
