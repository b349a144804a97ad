"""Gates and measures of order lines in tasks with a bounded number of rows."""

import random
import statistics
from datetime import date

import duckdb
from pyspark.sql import functions as F

from millrace.operators import measures
from millrace.plans import measure_queries, registered, registry


def text(x):
    return str(round(x, 6)) if isinstance(x, float) else str(x)


def test_queries_whose_facts_are_dealt_by_rows_equal_their_sql(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 500)  # 13 tasks where there are 4 cores
    assert registry.facts(registry.Tables(spark, sf)).rdd.getNumPartitions() > 4
    con, found = duckdb.connect(), registered()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("silver_gates", "measures_by_month_region", "measures_by_service"):
        rows = found.QUERIES[name](spark, sf)
        expected = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({found.SQL[name]})").fetchall()
        assert sorted(tuple(map(text, r)) for r in rows.collect()) == sorted(tuple(map(text, r)) for r in expected)


def test_gates_read_the_facts_once(spark, sf):
    plan = registered().QUERIES["silver_gates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 7  # nation twice, the others once


def test_delays_and_gains_are_cells_of_their_own(spark):
    rnd = random.Random(6)
    rows = [(date(2020, 1, 1), k, rnd.choice([None, *range(30)]), rnd.choice([None, *range(25)]), rnd.random() < 0.2) for k in range(900)]
    facts = spark.createDataFrame(rows, "day date, id int, delay int, departure int, cancelled boolean").unionByName(spark.createDataFrame(rows[:3], "day date, id int, delay int, departure int, cancelled boolean"))
    rows += rows[:3]
    table, again = measures.cells(facts, ["day"], departure="departure"), measures.repeats(facts, ["day"], ["id"])
    assert table.count() <= 2 * 31 + 60  # pairs of both would be hundreds
    got = measures.journey_measures(table, again, ["day"], 10).first()
    done = [r for r in rows if not r[4] and r[2] is not None]
    assert (got.scheduled, got.completed, got.on_time, got.duplicate_rows) == (903, len(done), sum(r[2] <= 10 for r in done), 3)
    assert got.median_delay == statistics.median(r[2] for r in done) and got.median_accumulation == statistics.median(r[2] - r[3] for r in done if r[3] is not None)
    assert {r.n for r in again.collect()} == {2} and again.agg(F.count("*")).first()[0] == 3


def test_orders_are_dealt_by_rows_before_they_meet_customers(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 100)  # 60 tasks of lines, 15 of orders
    monkeypatch.setattr(registry, "FEW_KEYS", 100)
    plan = registry.facts(registry.Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("RepartitionByExpression [o_custkey" in x or "RepartitionByExpression [c_custkey" in x for x in plan.splitlines()) == 2


def test_repeated_keys_are_counted_where_they_lie_and_kept_as_sets(spark):
    rnd = random.Random(5)
    keys = [k for k in range(400) for _ in range(rnd.choice([1, 2, 2, 3]))] + [7] * 50
    rows = [(rnd.choice("ab"), rnd.choice(["x", None]), k, None if k == 9 else k % 3) for k in keys]
    facts = spark.createDataFrame(rows, "region string, service string, id int, line int").repartition(5, "id")
    plain, sets = measures.repeats(facts, ["region", "service"], ["id", "line"]), measures.repeat_sets(facts, ["region", "service"], ["id", "line"])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the dealing by id
    got = sets.localCheckpoint()
    assert got.select("key").distinct().count() < plain.select("key").distinct().count() / 4
    assert got.agg(F.sum(F.col("n") * F.col("keys"))).first()[0] == plain.agg(F.sum("n")).first()[0]
    table = facts.select("region", "service", F.lit(date(2020, 1, 1)).alias("day"), F.lit(False).alias("off"), F.lit(1).alias("delay"), F.lit(None).cast("int").alias("gained"), F.lit(1).alias("n"), F.lit(0).alias("n_gained"))
    for by, where in ((["region"], None), (["service"], None), (["region", "service"], None), ([], None), (["region"], F.col("service") == "x"), ([], F.col("region") == "a")):
        kept = [r for r in rows if where is None or (r[1] == "x" if by else r[0] == "a")]
        at = [["region", "service"].index(c) for c in by]
        expected = {tuple(r[i] for i in at): 0 for r in kept}
        for group in expected:
            inside = [r for r in kept if tuple(r[i] for i in at) == group]
            expected[group] = len(inside) - len({r[2:] for r in inside})
        found = measures.journey_measures(table, got, by, 5, where).collect()
        assert {tuple(r[c] for c in by): r.duplicate_rows for r in found} == expected


def test_tasks_that_deal_lines_read_little_at_once(spark, sf, monkeypatch):
    split, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(split)
    monkeypatch.setattr(measure_queries, "stage", lambda df, name: seen.append(int(spark.conf.get(split))) or df)
    measure_queries._state(registry.Tables(spark, sf))
    assert seen == [8 << 20] * 2 and spark.conf.get(split) == before
