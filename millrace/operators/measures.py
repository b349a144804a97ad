"""A report's measures under any filter and threshold, from counts per finest grain.

Facts are read once, into cells: grain, cancelled, and delay or accumulated delay with a number of rows. Cells add up over
any coarser grain, so every measure comes from them without the facts: medians and percentiles are exact, since a
cell's value has its number. Distinct keys are rows less repeats, and keys that occur more than once are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import safe_rate

#: Least numbers of rows for a route and for a station to be shown.
ROUTE_SAMPLE, STATION_SAMPLE = 200, 500
BASE_THRESHOLD = 5


def cells(facts: DataFrame, grain: list[str], delay: str = "delay", departure: str | None = None, cancelled: str = "cancelled") -> DataFrame:
    """(grain, off, delay, gained, n, n_gained); gained is the delay less that at departure, where both are known and
    nothing was cancelled.

    Delays (n rows) and gains (n_gained rows) are cells of their own, so there are as many as values of both together and
    not as their pairs, of which there would be nearly one for each row.
    """
    gained = F.when(~F.col("off"), F.col("delay") - F.col("departure")) if departure else F.lit(None).cast("int")
    rows = facts.select(*grain, F.coalesce(F.col(cancelled), F.lit(False)).alias("off"), F.col(delay).alias("delay"), *([F.col(departure).alias("departure")] if departure else []))
    rows = rows.select(*grain, "off", "delay", gained.alias("gained"))
    one = F.lit(1)
    cell = F.struct("delay", F.when(F.lit(False), F.col("gained")).alias("gained"), one.alias("n"), F.lit(0).alias("n_gained"))
    gain = F.struct(F.when(F.lit(False), F.col("delay")).alias("delay"), "gained", F.lit(0).alias("n"), one.alias("n_gained"))
    each = F.when(F.col("gained").isNull(), F.array(cell)).otherwise(F.array(cell, gain)) if departure else F.array(cell)
    return rows.select(*grain, "off", F.inline(each)).groupBy(*grain, "off", "delay", "gained").agg(F.sum("n").alias("n"), F.sum("n_gained").alias("n_gained"))


def _repeats(facts: DataFrame, grain: list[str], key: list[str]) -> DataFrame:
    """(key columns, grain, n) of keys that occur more than once. Rows are counted and added up where they lie by the key's
    columns: grouped by a struct of these, they would be shuffled again, into tasks that grow with the table."""
    rows = facts.select(*grain, *key, F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("__all")).filter("__all > 1")
    return rows.groupBy(*key, *grain).agg(F.count(F.lit(1)).alias("n"))


def repeats(facts: DataFrame, grain: list[str], key: list[str]) -> DataFrame:
    """(grain, key, n) of keys that occur more than once."""
    return _repeats(facts, grain, key).select(*grain, F.struct(*key).alias("key"), "n")


def repeat_sets(facts: DataFrame, grain: list[str], key: list[str]) -> DataFrame:
    """(key, keys, grain, n): repeated keys whose rows lie in the same cells with the same numbers are one set, under one key
    and with their number. There are as many sets as ways to lie in cells, however many keys; stage them, as their keys are
    numbers of this very run."""
    cells = F.sort_array(F.collect_list(F.struct(*grain, "n"))).alias("cells")  # of one key, at most one for each cell
    sets = _repeats(facts, grain, key).groupBy(*key).agg(cells).groupBy("cells").agg(F.count(F.lit(1)).alias("keys"))
    sets = sets.withColumn("key", F.monotonically_increasing_id())  # of its own step: beside inline it would number cells
    return sets.select("key", "keys", F.inline("cells"))


def _done() -> Column:
    return ~F.col("off") & F.col("delay").isNotNull()


def _number(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum("n" if condition is None else F.when(condition, F.col("n"))), F.lit(0))


def journey_measures(table: DataFrame, repeated: DataFrame, by: list[str], threshold: int = BASE_THRESHOLD, where: Column | None = None, day: str = "day") -> DataFrame:
    """All measures of journeys per `by`, among the cells that meet `where`, at a chosen threshold; `by`, `where` and `day`
    use columns of the grain. Repeats are those of `repeats` or `repeat_sets`. Rates are null where nothing is counted."""
    rows, again = (df if where is None else df.filter(where) for df in (table, repeated))
    done, late = _done(), F.col("delay") <= threshold
    exact = lambda value, condition, q, n="n": F.round(F.percentile(F.when(condition, F.col(value)), q, F.col(n)), 2)
    out = rows.groupBy(*by).agg(
        _number().alias("scheduled"), _number(done).alias("completed"), _number(F.col("off")).alias("cancelled"), _number(~F.col("off") & F.col("delay").isNull()).alias("missing"),
        _number(done & late).alias("on_time"), _number(done & (F.col("delay") <= BASE_THRESHOLD)).alias("on_time_5"), exact("delay", done, 0.5).alias("median_delay"), exact("delay", done, 0.9).alias("p90_delay"),
        exact("gained", F.col("gained").isNotNull(), 0.5, "n_gained").alias("median_accumulation"), F.min(day).alias("coverage_start"), F.max(day).alias("coverage_end"),
    )
    again = again if "keys" in again.columns else again.withColumn("keys", F.lit(1))
    extra = again.groupBy(*by, "key", "keys").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum((F.col("n") - 1) * F.col("keys")).alias("duplicate_rows"))
    if by:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        out = out.alias("a").join(extra.alias("b"), same, "left").select("a.*", "b.duplicate_rows")
    else:
        out = out.crossJoin(F.broadcast(extra))  # one row each
    out = out.withColumns({"duplicate_rows": F.coalesce("duplicate_rows", F.lit(0)), "threshold": F.lit(threshold), "delayed": F.col("completed") - F.col("on_time"), "enough": (F.col("scheduled") >= ROUTE_SAMPLE).cast("int")})
    rates = {"cancellation_rate": ("cancelled", "scheduled"), "on_time_rate": ("on_time", "completed"), "delay_rate": ("delayed", "completed"), "coverage": ("completed", "scheduled"), "on_time_rate_5": ("on_time_5", "completed"), "missing_rate": ("missing", "scheduled")}
    out = out.withColumns({k: safe_rate(a, b) for k, (a, b) in rates.items()})
    return out.withColumns({"sensitivity": F.round(F.col("on_time_rate") - F.col("on_time_rate_5"), 6), "distinct_keys": F.col("scheduled") - F.col("duplicate_rows")})


def arrival_measures(table: DataFrame, by: list[str], threshold: int = BASE_THRESHOLD, where: Column | None = None) -> DataFrame:
    """The counterparts for arrivals at stations."""
    rows = table if where is None else table.filter(where)
    done = _done()
    out = rows.groupBy(*by).agg(_number().alias("scheduled_arrivals"), _number(done).alias("completed_arrivals"), _number(done & (F.col("delay") <= threshold)).alias("on_time_arrivals"))
    return out.withColumns({"threshold": F.lit(threshold), "station_on_time_rate": safe_rate("on_time_arrivals", "completed_arrivals"), "enough": (F.col("scheduled_arrivals") >= STATION_SAMPLE).cast("int")})


def refresh(audit: DataFrame, retrieved: str, now: str) -> DataFrame:
    """(last_retrieval, refresh_age_hours) of an audit table: hours whose beginning was crossed, null without a retrieval."""
    last = F.max(retrieved)
    hours = lambda ts: F.unix_timestamp(F.date_trunc("hour", ts)) / 3600
    return audit.agg(last.alias("last_retrieval")).withColumn("refresh_age_hours", (hours(F.lit(now).cast("timestamp")) - hours(F.col("last_retrieval").cast("timestamp"))).cast("long"))
