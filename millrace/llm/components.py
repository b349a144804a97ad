"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (id, component), component being the least id that is connected; ids without edges are absent.

    A round replaces edges by edges to the least neighbour, so a component becomes a star after a few rounds, a
    number that grows with the logarithm of its size. Every join is on a node's id and can be split where one
    node has many edges.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, n = stage(e, "edges"), 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{n}")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e, n = stage(small, f"small{n}"), n + 1
        twice = e.groupBy("u").count().filter("count > 1").select("u")
        chained = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if twice.union(chained).isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
