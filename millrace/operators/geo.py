"""Points in polygons with holes.

Regions are laid on a grid. A cell that no edge comes near is inside a polygon or outside as a whole, which its centre
tells; in the other cells a point is tested by the edges of its row of cells, which are all that a ray to the right
can cross. So points meet regions by an equi-join on the cell, and most of them are decided by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import stage

#: Cells along the longer side of all regions together.
CELLS = 256
#: Edges and cells of a grid that is broadcast; a larger one is joined by a shuffle.
BROADCAST_EDGES, BROADCAST_CELLS = 2_000_000, 200_000


def _edges(ring: Column) -> Column:
    """Each point of a ring with the one before it."""
    return F.zip_with(ring, F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1)), lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")))


def _inside(edges: Column, lon: Column, lat: Column) -> Column:
    """Inside the outer ring (number 0) and in none of the holes; edges (ring, x1, y1, x2, y2) are those of the point's row."""
    hit = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x1"] - e["x2"]) * (lat - e["y2"]) / (e["y1"] - e["y2"]) + e["x2"])
    rings = F.transform(F.filter(edges, hit), lambda e: e["ring"])
    odd = lambda r: F.size(F.filter(rings, lambda x: x == r)) % 2 == 1
    return odd(F.lit(0)) & ~F.exists(F.array_distinct(rings), lambda r: (r > 0) & odd(r))


def grid(regions: DataFrame, cells: int = CELLS) -> tuple[DataFrame, tuple[float, float, float]]:
    """((i, j, found), (x0, y0, width)): for each cell the regions in it, an array of (code, box, edges).

    edges is null where the whole cell is inside. Cells that are outside of every region are left out.
    """
    polygons = stage(regions.select("code", F.explode("polygons").alias("polygon")).filter(F.size("polygon") > 0).withColumn("id", F.monotonically_increasing_id()), "polygons")
    rings = polygons.select("id", F.posexplode("polygon").alias("ring", "points"))
    edges = rings.select("id", "ring", F.explode(_edges(F.col("points"))).alias("e")).select("id", "ring", "e.*")
    ends = edges.select(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    x0, y0, x1, y1 = (v or 0.0 for v in ends)
    width = max(x1 - x0, y1 - y0) / cells or 1.0
    column, row = lambda x: F.floor((x - x0) / width), lambda y: F.floor((y - y0) / width)
    edges = edges.withColumns({"i0": column(F.least("x1", "x2")), "i1": column(F.greatest("x1", "x2")), "j0": row(F.least("y1", "y2")), "j1": row(F.greatest("y1", "y2"))})
    rows = edges.withColumn("j", F.explode(F.sequence("j0", "j1")))
    strips = rows.groupBy("id", "j").agg(F.collect_list(F.struct("ring", "x1", "y1", "x2", "y2")).alias("edges"), F.array_distinct(F.flatten(F.collect_list(F.sequence("i0", "i1")))).alias("border"), F.min(F.when(F.col("ring") == 0, F.col("i0"))).alias("least"), F.max(F.when(F.col("ring") == 0, F.col("i1"))).alias("most"))
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    outer = rings.filter("ring = 0").select("id", F.array_min(xs).alias("x_least"), F.array_max(xs).alias("x_most"), F.array_min(ys).alias("y_least"), F.array_max(ys).alias("y_most"))
    each = strips.join(polygons.select("id", "code").join(outer, "id"), "id").filter("least is not null").withColumn("i", F.explode(F.sequence("least", "most")))
    border = F.array_contains("border", F.col("i"))
    centre = [(F.col(c) + 0.5) * width + v for c, v in (("i", x0), ("j", y0))]
    kept = each.filter(border | _inside(F.col("edges"), *centre))
    box = F.struct("x_least", "x_most", "y_least", "y_most").alias("box")
    found = kept.groupBy("i", "j").agg(F.collect_list(F.struct("code", box, F.when(border, F.col("edges")).alias("edges"))).alias("found"))
    return stage(found, "grid"), (x0, y0, width)


def assign_regions(points: DataFrame, regions: DataFrame, cells: int = CELLS) -> DataFrame:
    """points (longitude, latitude, ...) with the least code of the regions that hold them, else null.

    regions has code and polygons (polygon, ring, point, coordinate); the first ring of a polygon is its outside, the
    others are holes. A grid of checked size is broadcast, a larger one meets the points in a shuffled join on the
    cell, in which AQE splits a cell that holds very many of them. A point without coordinates is in no region.
    """
    table, (x0, y0, width) = grid(regions, cells)
    size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(F.size(f["edges"]), F.lit(0)))), F.lit(0))).first()
    table = F.broadcast(table) if size[0] <= BROADCAST_CELLS and size[1] <= BROADCAST_EDGES else table
    lon, lat = F.col("longitude"), F.col("latitude")
    at = points.withColumns({"__i": F.floor((lon - x0) / width), "__j": F.floor((lat - y0) / width)})
    inside = lambda f: lon.between(f["box"]["x_least"], f["box"]["x_most"]) & lat.between(f["box"]["y_least"], f["box"]["y_most"]) & (f["edges"].isNull() | _inside(f["edges"], lon, lat))
    code = F.array_min(F.transform(F.filter("__found", inside), lambda f: f["code"]))
    rows = at.join(table.select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("found").alias("__found")), ["__i", "__j"], "left")
    return rows.withColumn("region_code", code).drop("__i", "__j", "__found")


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    turned = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, turned, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, v: s + v)) / 2
