"""Tables that change together, upserts that write little, schemas that grow."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import commits, sinks
from millrace.sources.commits import Conflict, Store, Transaction


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_an_upsert_of_few_rows_writes_little(spark, tmp_path):
    path = str(tmp_path)
    big = spark.range(1_000_000).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    sinks.upsert_into(path, big, ["id"])
    before = size(path)
    few = spark.range(100).select((F.col("id") * 9973).alias("id"), F.lit("new").alias("v")).unionByName(spark.createDataFrame([(-1, "new")], "id long, v string")).coalesce(1)
    sinks.upsert_into(path, few, ["id"])
    assert size(path) - before < 0.05 * before
    got = sinks.read_upserted(spark, path)
    assert got.count() == 1_000_001 and got.filter("v = 'new'").count() == 101 and got.select("id").distinct().count() == 1_000_001
    assert Store(spark, path).read(sinks.ROWS, number=0).filter("v = 'new'").count() == 0  # the commit before is still there


def test_upserts_deletes_and_merges_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_DELTAS", 3)
    rnd, expected, store = random.Random(4), {}, Store(spark, str(tmp_path), keep=2)
    for step in range(9):
        keys = [(rnd.randint(0, 5), rnd.choice("ab")) for _ in range(rnd.randint(1, 4))]
        new = {k: step for k in keys if rnd.random() < 0.7}
        touched = spark.createDataFrame(keys, "k int, part string")
        with store.transaction() as t:
            t.upsert("t", spark.createDataFrame([(*k, v) for k, v in new.items()], "k int, part string, v int"), ["k", "part"], touched)
        expected = {k: v for k, v in expected.items() if k not in keys} | new
        assert rows(store.read("t")) == sorted(((*k, v) for k, v in expected.items()), key=str)
    named = {f for n in store.commits() for f in commits._folders(store.state(n)[1])}
    assert len(store.commits()) <= 3 and {f"t/{x}" for x in os.listdir(tmp_path / "t")} == named


def test_parents_and_children_change_together(spark, tmp_path, monkeypatch):
    names = [f"child{k}" for k in range(6)]
    frame = lambda *r: spark.createDataFrame(r, "k int, v string")
    write = lambda v: sinks.replace_children(frame((1, v)), {n: frame((1, n + v), (1, v)) for n in names}, "k", str(tmp_path))
    seen = lambda: {n: rows(Store(spark, str(tmp_path)).read(n)) for n in ["parents", *names]}
    write("a")
    before = seen()
    own = Transaction.upsert
    for stop in range(7):
        calls = []

        def failing(self, *args, stop=stop, calls=calls):
            calls.append(1)
            if len(calls) == stop + 1:
                raise OSError("stopped")
            return own(self, *args)

        monkeypatch.setattr(Transaction, "upsert", failing)
        with pytest.raises(OSError):
            write("b")
        monkeypatch.undo()
        assert seen() == before
    monkeypatch.setattr(commits, "put_file", lambda *a, **b: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        write("b")
    monkeypatch.undo()
    assert seen() == before
    write("b")
    assert seen() == {n: [(1, "b")] if n == "parents" else rows(frame((1, n + "b"), (1, "b"))) for n in before}


def test_two_writers_build_on_each_other(spark, tmp_path):
    store, one = Store(spark, str(tmp_path)), lambda v: spark.createDataFrame([(v,)], "v int")
    a, b = Transaction(store), Transaction(store)
    a.append("t", one(1))
    b.append("t", one(2))
    a.commit()
    b.commit()
    assert rows(store.read("t")) == [(1,), (2,)]
    own = Transaction.entry

    def slow(self, name, df):
        Transaction.entry = own
        with store.transaction() as t:  # comes first
            t.replace("t", one(9))
        return own(self, name, df)

    Transaction.entry = slow
    assert store.merge("t") is False
    assert rows(store.read("t")) == [(9,)]
    assert not commits.put_file(spark, f"{tmp_path}/_commits/{0:012}.json", "{}", overwrite=False)
    assert issubclass(Conflict, RuntimeError)


def test_parts_are_replaced_and_read_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = lambda *r: spark.createDataFrame(r, "day string, v int")
    for new, days in (((("a", 1), ("a", 2), ("b", 3)), ["a", "b"]), ((("b", 4), ("c", 5)), ["b", "c"]), ((), ["a"]), ((("c", 6), ("z", 7)), ["c"])):
        with store.transaction() as t:
            t.replace_parts("t", frame(*new), "day", days)
    assert rows(store.read("t")) == [("b", 4), ("c", 6)]
    assert rows(store.read("t", parts=["c"])) == [("c", 6)] and len(store.read("t", parts=["c"]).inputFiles()) == 1


def test_schemas_grow(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for schema, r in (("k int, v float", (1, 1.5)), ("k long, v double, more string", (1 << 40, 0.1, "x")), ("more string, k long, last array<int>", ("y", 3, [1]))):
        with store.transaction() as t:
            t.append("t", spark.createDataFrame([r], schema))
    got = store.read("t")
    assert [f"{n} {k}" for n, k in got.dtypes] == ["k bigint", "v double", "more string", "last array<int>"]
    assert rows(got) == rows(spark.createDataFrame([(1, 1.5, None, None), (1 << 40, 0.1, "x", None), (3, None, "y", [1])], got.schema))
    assert rows(got.filter("k > 2").select("more")) == [("x",), ("y",)]
    folders = set(os.listdir(tmp_path / "t"))
    for schema, r in (("k int", (1,)), ("k long, v float", (1, 1.0)), ("k string", ("a",)), ("k long, more int", (1, 1))):
        with pytest.raises(ValueError, match="can't become"), store.transaction() as t:
            t.append("t", spark.createDataFrame([r], schema))
    assert set(os.listdir(tmp_path / "t")) == folders and store.state()[0] == 2  # nothing was written
    with store.transaction() as t:
        t.upsert("u", spark.createDataFrame([(1, 1)], "k int, v int"), ["k"])
    with store.transaction() as t:
        t.upsert("u", spark.createDataFrame([(1, 2.5, "n"), (2, None, "m")], "k long, v double, w string"), ["k"])
    assert rows(store.read("u")) == [(1, 2.5, "n"), (2, None, "m")]
