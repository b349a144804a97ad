"""As-of joins with a hot key and spatial joins on a grid, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import asof, geo


def plain_asof(left, right, tolerance):
    out = []
    for k, t, i in left:
        near = [(abs(s - t), s, v) for j, s, v in right if k is not None and t is not None and s is not None and j == k and abs(s - t) <= tolerance]
        best = min(near, default=(None, None, None))
        out.append((k, t, i, best[1], best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance,width", [(0, None), (5, None), (5, 10), (5, 3), (40, 7), (1000, 100)])
def test_asof_against_brute_force(spark, tolerance, width):
    rnd = random.Random(tolerance)
    left = [(rnd.choice(["a", "b", "c"]), rnd.randint(-200, 900), i) for i in range(300)] + [(None, 5, 300), ("a", None, 301), ("z", 1, 302)]
    right = sorted({(rnd.choice("ab"), rnd.randint(-200, 900)) for _ in range(200)})
    right = [(k, s, n) for n, (k, s) in enumerate(right)] + [(None, 5, 900), ("a", None, 901)]
    a = spark.createDataFrame(left, "k string, t long, i int")
    b = spark.createDataFrame(right, "k string, s long, v int")
    got = asof.asof_nearest(a, b, ["k"], "t", "s", tolerance, ["v"], width).select("k", "t", "i", "matched_ts", "v")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_asof(left, right, tolerance)


def test_asof_of_one_hot_key_is_linear(spark):
    rows = lambda n, step, name: spark.range(n).select(F.lit("all").alias("k"), (F.col("id") * step + 3).alias(name), F.col("id").alias(f"{name}_id"))
    began = time.monotonic()
    got = asof.asof_nearest(rows(1_000_000, 7, "t"), rows(1_000_000, 11, "s"), ["k"], "t", "s", 20, ["s_id"])
    far = got.select(F.count("matched_ts"), F.max(F.abs(F.col("t") - F.col("matched_ts"))), F.count(F.lit(1))).first()
    assert tuple(far) == (1_000_000, 5, 1_000_000)
    assert time.monotonic() - began < 60


def crosses(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (y1 > y) != (y2 > y) and x < (x1 - x2) * (y - y2) / (y1 - y2) + x2:
            odd = not odd
    return odd


def polygon(rnd, x, y, size, corners=9):
    import math

    ring = [[x + math.cos(a) * (r := size * rnd.uniform(0.5, 1)), y + math.sin(a) * r] for a in sorted(rnd.uniform(0, 6.28) for _ in range(corners))]
    return ring if rnd.random() < 0.5 else [*ring, ring[0]]


@pytest.mark.parametrize("cells,broadcast", [(1, True), (8, True), (64, False), (300, True)])
def test_regions_against_brute_force(spark, monkeypatch, cells, broadcast):
    if not broadcast:
        monkeypatch.setattr(geo, "BROADCAST_CELLS", 0)
    rnd = random.Random(cells)
    regions = []
    for k in range(12):
        x, y = rnd.uniform(0, 60), rnd.uniform(-20, 20)
        regions.append((f"r{k:02}", [[polygon(rnd, x, y, 15), *[polygon(rnd, x + d, y, 5) for d in ((0, 3) if k % 3 == 0 else ())]], *([[polygon(rnd, x + 30, y, 4)]] if k % 4 == 0 else [])]))
    regions.append(("huge", [[[[-100.0, -100.0], [200.0, -100.0], [200.0, -30.0], [-100.0, -30.0]]]]))
    points = [(float(n), rnd.uniform(-20, 110), rnd.uniform(-60, 50)) for n in range(3000)] + [(5000.0, None, 1.0), (5001.0, 1e9, 1e9), (5002.0, -1e9, 0.0)]

    def of(x, y):
        found = [code for code, polygons in regions if x is not None and any(crosses(p[0], x, y) and not any(crosses(h, x, y) for h in p[1:]) for p in polygons)]
        return min(found, default=None)

    frame = spark.createDataFrame(regions, "code string, polygons array<array<array<array<double>>>>")
    got = geo.assign_regions(spark.createDataFrame(points, "n double, longitude double, latitude double"), frame, cells)
    assert {r.n: r.region_code for r in got.collect()} == {n: of(x, y) for n, x, y in points}
    assert len({r.region_code for r in got.collect()}) > 8
    assert geo.assign_regions(spark.createDataFrame(points, "n double, longitude double, latitude double"), frame.limit(0), cells).filter("region_code is not null").count() == 0


def test_most_points_are_decided_by_their_cell(spark):
    square = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]]
    table, _ = geo.grid(spark.createDataFrame([("a", [square])], "code string, polygons array<array<array<array<double>>>>"), 50)
    cells = table.select(F.inline("found")).groupBy(F.col("edges").isNull().alias("whole")).count().collect()
    assert {r.whole: r["count"] for r in cells}[True] > 2000 > 300 > {r.whole: r["count"] for r in cells}[False]
