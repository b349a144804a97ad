"""Draws of all replicates as arrays: the digest's own bits, and no row for each draw."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import ranking


def drawn(text, rep):
    u = int(hashlib.md5(f"{text}{rep}".encode()).hexdigest()[:7], 16) / 268435456.0
    return sum(u >= x for x in (0.36787944, 0.73575888, 0.9196986, 0.98101184))


def test_weights_are_those_of_the_digest():
    texts = ["", "7:", "123:", "99999999:", "-5:", "ä€:", *[f"{'k' * n}:" for n in (40, 46, 47, 48, 49, 60, 200)], *[f"{k}:" for k in range(0, 3000, 37)]]
    got = ranking.poisson_weights([t.encode() for t in texts], 130)
    assert got.tolist() == [[drawn(t, r) for r in range(130)] for t in texts]


def test_weights_are_those_of_the_expression(spark):
    keys = [0, 5, 42, 1234567890123, -3]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").crossJoin(spark.range(12).select(F.col("id").cast("int").alias("r")))
    expected = {(x.k, x.r): x.w for x in rows.select("k", "r", ranking.poisson_weight(F.col("k"), F.col("r")).alias("w")).collect()}
    got = ranking.poisson_weights([f"{k}:".encode() for k in keys], 12)
    assert {(k, r): got[i, r] for i, k in enumerate(keys) for r in range(12)} == expected


def test_pairs_against_brute_force(spark):
    rows = [(k, float(k % 7) if k % 11 else None, float(k % 3), [True, False, None, False][k % 4]) for k in range(60)]
    got = {r.rep: r for r in ranking.bootstrap_pairs(spark.createDataFrame(rows, "k long, a double, b double, y boolean"), "a", "b", "y", "k", 9).collect()}
    low = -1.0  # a null score is below all others
    for rep in range(9):
        w = [(x if (x := a) is not None else low, b, y, drawn(f"{k}:", rep)) for k, a, b, y in rows if y is not None]
        auc = lambda i: sum(p[3] * q[3] * ((p[i] > q[i]) + (p[i] == q[i]) / 2) for p in w if p[2] for q in w if not q[2]) / (sum(p[3] for p in w if p[2]) * sum(q[3] for q in w if not q[2]))
        assert got[rep].n == sum(x[3] for x in w)
        assert np.allclose([got[rep].auc_a, got[rep].auc_b, got[rep].difference], [auc(0), auc(1), auc(0) - auc(1)], atol=2e-6)


def test_sums_of_many_parts_are_whole(spark):
    rows = spark.range(0, 3000, 1, 30).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"), (F.col("id") % 5 == 0).alias("y"))
    got = {r.rep: r.n for r in ranking.bootstrap_pairs(rows, "a", "b", "y", "k", 20).collect()}
    assert got == {rep: sum(drawn(f"{k}:", rep) for k in range(3000)) for rep in range(20)}


def test_many_draws_take_seconds(spark):
    rows = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 500).cast("double").alias("a"), (F.col("id") % 37).cast("double").alias("b"), (F.col("id") % 5 == 0).alias("y"))
    began = time.monotonic()
    assert len(ranking.bootstrap_pairs(rows, "a", "b", "y", "k").collect()) == 250
    assert time.monotonic() - began < 25  # ten million draws; as rows they took over 40 s
