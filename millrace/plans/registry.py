"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import bounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables; WITH facts is put before SQL that reads facts."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[key] = sql.replace("{facts}", FACTS_SQL)
        return f

    return register


#: One row per order line: its planned and actual day, delay in days, whether it was returned, and who took part.
FACTS_SQL = """facts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, l_quantity, l_extendedprice, o_orderpriority AS service, cast(o_orderdate AS DATE) AS day,
         cast(l_shipdate AS DATE) AS ship_day, l_returnflag = 'R' AS cancelled, sn.n_name AS origin, cn.n_name AS destination, r_name AS region,
         CASE WHEN l_returnflag <> 'R' THEN cast(date_diff('day', cast(o_orderdate AS DATE), cast(l_shipdate AS DATE)) - 45 AS INTEGER) END AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey)"""


#: Order lines, or orders, of a task, where there are more lines than that for each core, suppliers that are broadcast then,
#: and customers that are too few to deal orders by them (Spark broadcasts so few by itself).
TASK_ROWS, DIMENSION_ROWS, FEW_KEYS = 500_000, 1_000_000, 10_000


def facts(t: Tables) -> DataFrame:
    """The largest side is shuffled once, by order, and a task has a bounded number of its rows; nation and region are
    dimensions of fixed size."""
    nations = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    origin = F.broadcast(nations.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin"), F.col("r_name").alias("region")))
    destination = F.broadcast(nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination")))
    suppliers = t.supplier.join(origin, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "origin", "region")
    customers = t.customer.join(destination, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "destination")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("ship_day"), (F.col("l_returnflag") == "R").alias("cancelled"))
    # adaptive plans merge partitions by their compressed size, and a task's sorts and sums of narrow rows are many times that
    n, cores, orders = rows.count() // TASK_ROWS + 1, t.spark.sparkContext.defaultParallelism, t.orders
    if n > cores and t.customer.count() > FEW_KEYS:
        m = max(orders.count() // TASK_ROWS + 1, cores)
        orders, customers = orders.repartition(m, "o_custkey"), customers.repartition(m, "o_custkey")
    orders = orders.join(customers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderpriority").alias("service"), F.to_date("o_orderdate").alias("day"), "destination")
    if n > cores:
        rows, orders, suppliers = rows.repartition(n, "l_orderkey"), orders.repartition(n, "l_orderkey"), bounded(suppliers, DIMENSION_ROWS)
    rows = rows.join(orders, "l_orderkey").join(suppliers, "l_suppkey")
    return rows.withColumn("delay", F.when(~F.col("cancelled"), F.datediff("ship_day", "day") - 45))
