"""Point-in-time history: what was known strictly before a day, per key.

Events are added up to (key, day) first, so a frame never has more rows per key than days, however hot the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_history(df: DataFrame, key: list[str], day: Column, late: Column | None = None) -> DataFrame:
    """(key, day, n, late)."""
    late = F.lit(0) if late is None else F.coalesce(late.cast("int"), F.lit(0))
    return df.groupBy(*key, F.unix_date(day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(late).cast("long").alias("late"))


def prior_history(history: DataFrame, key: list[str], queries: DataFrame | None = None, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """For each (key, day) of the queries (default: the history's days): totals strictly before it, in all and in
    trailing windows, and the days since the first one. Days are epoch days."""
    if queries is not None:
        asked = queries.select(*key, "day").distinct().withColumn("asked", F.lit(True))
        history = history.join(asked, [*key, "day"], "full_outer")
    else:
        history = history.withColumn("asked", F.lit(True))
    order = Window.partitionBy(*key).orderBy("day")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    columns = {"prior_n": zero(F.sum("n").over(before)), "prior_late": zero(F.sum("late").over(before))}
    columns["experience_days"] = zero(F.col("day") - F.min(F.when(F.col("n") > 0, F.col("day"))).over(before)).cast("int")
    for w in windows:
        frame = order.rangeBetween(-w, -1)
        columns |= {f"n_{w}": zero(F.sum("n").over(frame)), f"late_{w}": zero(F.sum("late").over(frame))}
    return history.withColumns(columns).filter("asked").select(*key, "day", *columns)
