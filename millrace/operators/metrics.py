"""Reliability metrics: one aggregate per grain, thresholds side by side, additive counts before rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import THRESHOLDS, col, safe_rate
from millrace.operators.ranking import quantiles


def reliability_columns(delay: str = "delay", cancelled: str = "cancelled", thresholds=THRESHOLDS) -> list[Column]:
    """Counts, and exact percentiles of the delays of what was not cancelled."""
    done = ~F.coalesce(col(cancelled), F.lit(False)) & col(delay).isNotNull()
    q = F.percentile(F.when(done, col(delay)), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return [
        F.count(F.lit(1)).alias("scheduled"),
        F.count_if(done).alias("completed"),
        F.count_if(F.coalesce(col(cancelled), F.lit(False))).alias("cancelled"),
        *[F.count_if(done & (col(delay) <= t)).alias(f"on_time_{t}") for t in thresholds],
        F.round(q[0], 2).alias("median_delay"),
        F.round(q[1], 2).alias("p90_delay"),
        F.round(q[2], 2).alias("p95_delay"),
        F.round(F.avg(F.when(done, col(delay))), 4).alias("mean_delay"),
    ]


def with_rates(df: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Rates of the counts; null where nothing was counted."""
    rates = {"cancelled_rate": safe_rate("cancelled", "scheduled"), "completion_rate": safe_rate("completed", "scheduled")}
    return df.withColumns(rates | {f"on_time_rate_{t}": safe_rate(f"on_time_{t}", "completed") for t in thresholds})


def reliability(df: DataFrame, by: list[str], delay: str = "delay", cancelled: str = "cancelled", thresholds=THRESHOLDS, floor: int = 0) -> DataFrame:
    out = df.groupBy(*by).agg(*reliability_columns(delay, cancelled, thresholds))
    return with_rates(out.filter(F.col("scheduled") >= floor) if floor else out, thresholds)


def reliability_sets(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Several grains in one pass; the columns outside a set are null and `grain` names the set."""
    keys = sorted({k for s in sets for k in s})
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    out = grouped.agg(F.grouping_id().alias("__id"), *reliability_columns())
    grain = F.lit(None).cast("string")
    for s in sets:
        mask = sum((k not in s) << (len(keys) - 1 - i) for i, k in enumerate(keys))
        grain = F.when(F.col("__id") == mask, F.lit(",".join(sorted(s)) or "all")).otherwise(grain)
    return with_rates(out.withColumn("grain", grain).drop("__id"))


def consistency(df: DataFrame, key: str, month: Column, floor: int, threshold: int = 5, weak: float = 0.9) -> DataFrame:
    """Per key: months observed, spread of the monthly on-time rate, share of months under `weak`. Monthly counts add up to the key's."""
    done = F.col("delay").isNotNull()
    monthly = df.groupBy(key, month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"), F.count_if(done & (F.col("delay") <= threshold)).alias("on_time"))
    monthly = monthly.withColumn("rate", F.try_divide(F.col("on_time").cast("double"), F.col("done").cast("double")))
    out = monthly.groupBy(key).agg(
        F.sum("n").alias("scheduled"),
        F.count("rate").alias("months"),
        F.round(F.stddev_pop("rate"), 4).alias("rate_spread"),
        F.round(F.avg((F.col("rate") < weak).cast("int")), 4).alias("weak_share"),
        F.sum("done").alias("completed"),
        F.sum("on_time").alias("on_time"),
    )
    return out.filter(F.col("scheduled") >= floor).withColumn("on_time_rate", safe_rate("on_time", "completed"))


def histogram(df: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Counts per right-closed bucket, empty ones included. The bucket frame has one row per edge and one more."""
    labels = [f"<= {edges[0]}", *[f"{a + 1}..{b}" for a, b in zip(edges, edges[1:], strict=False)], f"> {edges[-1]}"]
    number = sum(((F.col(value) > e).cast("int") for e in edges), F.lit(0))
    counts = df.filter(F.col(value).isNotNull()).groupBy(number.alias("position")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame(list(enumerate(labels)), "position int, bucket string")
    return frame.join(counts, "position", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def overlapping(df: DataFrame, conditions: dict[str, Column], otherwise: str = "none", everything: str = "all") -> DataFrame:
    """Rows under every label whose condition holds, under `otherwise` if none does, and under `everything`."""
    hits = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull())
    labels = F.concat(F.array(F.lit(everything)), F.when(F.size(hits) == 0, F.array(F.lit(otherwise))).otherwise(hits))
    return df.withColumn("label", F.explode(labels))


def regional_daily(df: DataFrame, thresholds=THRESHOLDS, severe: int = 30) -> DataFrame:
    """Worst delay per (day, region, journey), then counts per threshold as long rows, from one aggregate."""
    journeys = df.groupBy("day", "region", "journey").agg(F.max("delay").alias("delay"), F.bool_or("cancelled").alias("cancelled"))
    counts = journeys.groupBy("day", "region").agg(
        F.count(F.lit(1)).alias("journeys"), F.count_if("cancelled").alias("cancelled"), F.count_if(F.col("delay") > severe).alias("severe"),
        *[F.count_if(F.col("delay") > t).alias(f"d{t}") for t in thresholds],
    )
    long = counts.select("day", "region", "journeys", "cancelled", "severe", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"d{t}").alias("delayed")) for t in thresholds])).alias("x"))
    out = long.select("day", "region", "journeys", "cancelled", "severe", "x.threshold", "x.delayed")
    return out.withColumn("reliability_rate", F.round(1 - (F.col("delayed") + F.col("cancelled")) / F.col("journeys"), 6))


def disruption_score(observed: str, measured: str, delayed: str, severe: str, cancelled: str, mean_delay: str) -> Column:
    """0 to 100: 45 for the delayed share, 25 severe, 20 cancelled, 10 for a mean of 30 or more; null where nothing is known."""
    share = lambda n, d: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double")), F.lit(0.0))
    mean = F.least(F.greatest(F.coalesce(F.col(mean_delay), F.lit(0.0)), F.lit(0.0)) / 30, F.lit(1.0))
    score = 45 * share(delayed, measured) + 25 * share(severe, measured) + 20 * share(cancelled, observed) + 10 * mean
    known = (F.col(observed) > 0) & ((F.col(measured) > 0) | (F.col(cancelled) > 0))
    return F.when(known, F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 1))


def disruption_status(score: Column, has_service: Column | None = None) -> Column:
    ladder = F.when(score.isNull(), "no-data").when(score >= 25, "serious").when(score >= 10, "elevated").otherwise("normal")
    return ladder if has_service is None else F.when(~has_service, "no-service").otherwise(ladder)


def problem_entities(df: DataFrame, by: list[str], threshold: int, top: int = 5, severe: int = 15) -> DataFrame:
    """The worst entities per group (by[:-1]): severe, cancellations, delayed, mean, all descending, then the name."""
    measured = ~F.col("cancelled") & F.col("delay").isNotNull()
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(measured & (F.col("delay") > threshold)).alias("delayed"), F.count_if(measured & (F.col("delay") > severe)).alias("severe"),
        F.count_if("cancelled").alias("cancellations"), F.round(F.avg(F.when(measured, F.col("delay"))), 4).alias("mean_delay"),
    ).filter("delayed + severe + cancellations > 0")
    order = [F.desc("severe"), F.desc("cancellations"), F.desc("delayed"), F.desc_nulls_last("mean_delay"), F.asc(by[-1])]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(*order))).filter(F.col("place") <= top)


def calibration_bins(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """Quantile bins, right-closed, the first with its minimum; equal edges fall together."""
    inner = [k / n for k in range(1, n)]
    edges = F.broadcast(quantiles(df, p, inner).select(F.array_distinct("q").alias("edges")))  # one row
    number = F.size(F.filter("edges", lambda e: e < F.col(p)))
    rows = df.crossJoin(edges).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("rate"))
    return rows.withColumn("gap", F.round(F.abs(F.col("mean_p") - F.col("rate")), 6))
