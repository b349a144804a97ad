"""Readers and writers of files on data that comes from the tables, areas of rings, and versions compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import geo, tenders
from millrace.plans.registry import Tables, query
from millrace.sources import feeds, sinks
from millrace.sources.shared import new_path


@query("SELECT o_orderkey AS id, o_custkey AS buyer, round(o_totalprice, 2) AS value, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS lots FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def notice_pages(t: Tables) -> DataFrame:
    """Notices as landed pages of JSON (one page per buyer), read again as one row each."""
    lots = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    notices = t.orders.join(lots, "o_orderkey").select("o_custkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer"), F.round("o_totalprice", 2).alias("value"), F.transform("x", lambda x: x["l_linenumber"]).alias("lots")).alias("n"))
    path = new_path(t.spark, "pages")
    notices.groupBy("o_custkey").agg(F.collect_list("n").alias("notices")).select(F.to_json(F.struct("notices"))).write.text(path)
    return feeds.read_notice_pages(t.spark, path, "id: bigint, buyer: bigint, value: double, lots: array<bigint>", multiline=False)


@query("SELECT n_name AS code, r_name AS name, 1 + n_nationkey % 2 AS polygons, 5 * (1 + n_nationkey % 2) AS points FROM nation JOIN region ON n_regionkey = r_regionkey")
def region_source(t: Tables) -> DataFrame:
    """Nations as GeoJSON features of one or two squares, read as regions; their number is checked."""
    point = lambda x, y: F.array((F.col("n_nationkey") + x).cast("double"), F.lit(float(y)))
    ring = F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1), point(0, 0))
    odd = F.col("n_nationkey") % 2 == 1
    shape = lambda kind, coordinates: F.to_json(F.struct(F.struct(F.col("n_name").alias("code"), F.col("r_name").alias("name")).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # a fixed dimension
    features = rows.select(F.when(odd, shape("MultiPolygon", F.array(F.array(ring), F.array(ring)))).otherwise(shape("Polygon", F.array(ring))).alias("f"))
    path = new_path(t.spark, "regions")
    features.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("f"), ","), F.lit("]}"))).write.text(path)
    found = feeds.read_regions(t.spark, path, t.nation.count())
    return found.select("code", "name", F.size("polygons").cast("long").alias("polygons"), F.aggregate("polygons", F.lit(0), lambda s, p: s + F.size(p[0])).cast("long").alias("points"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * l_extendedprice, 2) AS area FROM lineitem")
def ring_areas(t: Tables) -> DataFrame:
    """The shoelace area of a rectangle, which is its sides' product, against the clock and not closed."""
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    zero, a, b = F.lit(0.0), F.col("l_quantity"), F.col("l_extendedprice")
    ring = F.array(point(zero, zero), point(zero, b), point(a, b), point(a, zero))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(geo.ring_area(ring), 2).alias("area"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL")
def json_extract_roundtrip(t: Tables) -> DataFrame:
    """A small aggregate as one JSON file for other programs, written twice, and read back."""
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    path = f"{new_path(t.spark, 'extract')}/rows.json"
    for part in (rows.filter("n < 0"), rows):
        sinks.extract(part, path, ["priority", "status"])
    return t.spark.read.schema("priority string, status string, n long, total double").option("multiLine", True).json(path)


_VERSIONS = "v AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderpriority AS priority, o_orderstatus AS status, strftime(o_orderdate, '%Y') AS year FROM orders)"


@query(
    f"WITH {_VERSIONS} SELECT a.id, field, old_value, new_value, CASE WHEN field = 'status' THEN 'MATERIAL' ELSE 'INFORMATIONAL' END AS materiality FROM v a JOIN v b ON a.id = b.id AND a.version = 2 AND b.version = 5, "
    "LATERAL (SELECT * FROM (VALUES ('priority', a.priority, b.priority), ('status', a.status, b.status), ('year', a.year, b.year)) x(field, old_value, new_value)) WHERE old_value <> new_value"
)
def versions_compared(t: Tables) -> DataFrame:
    """Changed fields between the second and the fifth version of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    history = t.orders.select(F.col("o_custkey").alias("id"), F.row_number().over(w).alias("version"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy").alias("year"))
    return tenders.compare_versions(history, "id", ["priority", "status", "year"], 2, 5, {"status"})
