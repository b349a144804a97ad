"""Nearest as-of join within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances in a slice of time, about: so few right rows belong to two slices.
SLICE = 64


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, tolerance: int, value: list[str], slice_width: int | None = None) -> DataFrame:
    """left with the nearest right row of its key within `tolerance` (in the units of the time columns, numbers, inclusive);
    the earlier one wins ties. right has one row per key and time. A null key or time matches nothing.

    Both sides are dealt by key and slice of time, so a key with very many rows is many groups; right rows within the
    tolerance of a slice's edge belong to the neighbour too. In each group the last right row so far is looked up in
    ascending and in descending order: two running frames, linear in the rows; no pairs are made.
    """
    width = slice_width or max(SLICE * tolerance, 1)
    own = [c for c in left.columns if c not in by]
    at = lambda c: F.floor(c / width)
    payload = F.struct(F.col(right_ts).alias("ts"), *[F.col(v) for v in value])
    known = right.dropna(subset=[*by, right_ts])
    a = left.select(*by, at(F.col(left_ts)).alias("__slice"), F.col(left_ts).alias("__t"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("__r"), F.struct(*own).alias("__l"))
    slices = F.sequence(at(F.col(right_ts) - tolerance), at(F.col(right_ts) + tolerance))
    b = known.select(*by, F.explode(slices).alias("__slice"), F.col(right_ts).alias("__t"), payload.alias("__r"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"))
    group = Window.partitionBy(*by, "__slice")
    so_far = lambda order: F.last("__r", ignorenulls=True).over(group.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = a.unionByName(b).withColumn("__b", so_far(F.asc("__t"))).withColumn("__a", so_far(F.desc("__t"))).filter(F.col("__l").isNotNull())
    to_back, to_ahead = F.col("__t") - F.col("__b.ts"), F.col("__a.ts") - F.col("__t")
    pick = F.when(to_back.isNotNull() & (to_ahead.isNull() | (to_back <= to_ahead)), F.when(to_back <= tolerance, F.col("__b"))).when(to_ahead <= tolerance, F.col("__a"))
    rows = rows.withColumn("__m", pick)
    return rows.select(*by, *[F.col("__l")[c].alias(c) for c in own], F.col("__m.ts").alias("matched_ts"), *[F.col("__m")[v].alias(v) for v in value])
