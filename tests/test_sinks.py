"""Versions, inserts, upserts, parent and child tables, extracts and named tables."""

import json

import pytest

from millrace.sources import sinks
from millrace.sources.commits import Store


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_copies_are_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.read_version(spark, path, "k int, v string").count() == 0
    for rows in ([(1, "a")], [(2, "b")], [(1, "e"), (3, "d")]):
        sinks.write_version(pairs(spark, *rows), path)
    assert sinks.versions(spark, path) == [1, 2]
    (tmp_path / "t" / "version=9").mkdir()  # a write that failed
    assert {tuple(r) for r in sinks.read_version(spark, path, "k int, v string").collect()} == {(1, "e"), (3, "d")}


def test_upserts(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.read_upserted(spark, path, "k int, v string").count() == 0
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(1, "e")]):
        sinks.upsert_into(path, pairs(spark, *rows), ["k"])
    assert {tuple(r) for r in sinks.read_upserted(spark, path).collect()} == {(1, "e"), (2, "c"), (3, "d")}


def test_insert_absent(spark, tmp_path):
    for rows in ([(1, "a")], [(1, "b"), (2, "c")]):
        sinks.insert_absent(pairs(spark, *rows), f"{tmp_path}/t", ["k"])
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (2, "c")}


def test_children_are_replaced_with_their_parents(spark, tmp_path):
    child = lambda *rows: spark.createDataFrame(rows, "k int, lot string")
    sinks.replace_children(pairs(spark, (1, "a"), (2, "b")), {"lots": child((1, "x"), (1, "y"), (2, "z"))}, "k", str(tmp_path))
    sinks.replace_children(pairs(spark, (1, "c")), {"lots": child((1, "w"), (7, "stray"))}, "k", str(tmp_path))
    sinks.replace_children(pairs(spark, (2, "d")), {"lots": child()}, "k", str(tmp_path))
    assert {tuple(r) for r in Store(spark, str(tmp_path)).read("parents").collect()} == {(1, "c"), (2, "d")}
    assert {tuple(r) for r in Store(spark, str(tmp_path)).read("lots").collect()} == {(1, "w")}


def test_extracts(spark, tmp_path):
    df = pairs(spark, (2, "b"), (1, 'a,"ä"'))
    for _ in range(2):
        sinks.extract(df, f"{tmp_path}/x.json", ["k"])
        sinks.extract(df, f"{tmp_path}/x.csv", ["k"], "csv")
    assert json.loads((tmp_path / "x.json").read_text()) == [{"k": 1, "v": 'a,"ä"'}, {"k": 2, "v": "b"}]
    assert (tmp_path / "x.csv").read_text() == 'k,v\n1,"a,""ä"""\n2,b\n'
    assert not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        sinks.extract(df, f"{tmp_path}/y.json", ["k"], rows=1)


def test_named_tables(spark):
    for v in ("a", "b"):
        sinks.save_tables({"pairs": pairs(spark, (1, v))}, "millrace_test")
    assert [tuple(r) for r in spark.table("millrace_test.pairs").collect()] == [(1, "b")]
    spark.sql("DROP DATABASE millrace_test CASCADE")
