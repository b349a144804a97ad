"""Rules without a key reach every customer of their region."""

from millrace.plans import registered


def test_every_customer_takes_part(spark, sf):
    nation = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}
    rules = [(r.s_suppkey, nation[r.s_nationkey]) for r in spark.read.parquet(f"{sf}/supplier.parquet").collect() if r.s_acctbal < 0]
    customers = [(r.c_custkey, nation[r.c_nationkey]) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    keyed = [(r.s_suppkey, r.s_nationkey) for r in spark.read.parquet(f"{sf}/supplier.parquet").collect() if r.s_acctbal >= 0]
    home = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    got = {r.c_custkey: (r.rules, r.first_rule) for r in registered().QUERIES["null_matches_all_join_region"](spark, sf).collect()}
    for c, region in customers:
        reached = [s for s, b in rules if b == region] + [s for s, n in keyed if n == home[c]]
        assert got.pop(c) == (len(reached), min(reached, default=None))
    assert not got
