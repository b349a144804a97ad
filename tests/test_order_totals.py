"""Totals of orders: items are shuffled once and as one row each."""

import random

from pyspark.sql import functions as F

from millrace.plans import order_queries


def test_totals_against_brute_force_with_one_shuffle(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([7, 8, 9, None]), rnd.randint(0, 999) / 4, float(rnd.randint(1, 9)), rnd.choice(["A", "R", None])) for _ in range(60)]
    rows += [(5, None, 1.0, 1.0, None), (6, 7, 2.0, 3.0, "N"), *[(4, k % 50, 0.25, 1.0, "ARN"[k % 3]) for k in range(3000)]]
    found = order_queries.order_totals_of(spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string"))
    got = {r.l_orderkey: (r["items"], r.sellers, r.value, r.quantity, r.kinds) for r in found.collect()}
    distinct = lambda own, i: len({r[i] for r in own} - {None})
    expected = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        expected[key] = (len(own), distinct(own, 1), round(sum(round(r[2] + 1e-9, 2) for r in own), 2), sum(r[3] for r in own), distinct(own, 4))
    assert got == expected
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Expand" not in plan
