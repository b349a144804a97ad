"""A failed gate is a row; who needs a pass raises on it."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import tables
from millrace.plans import registered

REGISTRY = registered()


def test_gate_verdict_of_many_orders_without_lines(spark, tmp_path):
    spark.range(1500).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(400).select(F.col("id").alias("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = REGISTRY.QUERIES["gate_verdict"](spark, str(tmp_path))
    assert [tuple(r) for r in found.select("check_name", "observed", "status").collect()] == [("orders without lines", 1100, "FAIL")]
    with pytest.raises(ValueError, match="orders without lines"):
        tables.require_pass(found, "orders")
