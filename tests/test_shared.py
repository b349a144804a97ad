"""Staged tables and the entry point."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from millrace.operators import ranking
from millrace.sources import shared, sinks

ROOT = Path(__file__).resolve().parents[1]


def test_stage_and_clear(spark):
    df = shared.stage(spark.range(5), "numbers")
    assert df.count() == 5
    folder = shared._written[-1].removeprefix("file://")
    assert os.path.isdir(folder)
    shared.clear(spark)
    assert not os.path.isdir(folder)


def test_empty_frames_keep_their_schema(spark):
    df = shared.stage(spark.range(0).selectExpr("id", "cast(null as array<string>) as a"), "none")
    assert df.count() == 0 and df.dtypes == [("id", "bigint"), ("a", "array<string>")]


def test_numbered_is_a_total_order(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "score int, id int").repartition(5)
    got = [(r.score, r.id) for r in ranking.numbered(df, "score", "id").orderBy("position").collect()]
    assert got == sorted(got)
    down = [(r.score, r.id) for r in ranking.numbered(df, "score", "id", descending=True).orderBy("position").collect()]
    assert down == sorted(down, key=lambda x: (-x[0], x[1]))


def test_replace_partitions_drops_dates_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "v int, day string")
    sinks.append(rows, path, ["day"])
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "v int, day string"), path, "day", ["a", "b"])
    assert {(r.v, r.day) for r in spark.read.parquet(path).collect()} == {(9, "a"), (3, "c")}


@pytest.mark.parametrize("with_llm", [True, False])
def test_entry_imports_from_anywhere(tmp_path, with_llm):
    """Without the subpackage and the pipeline the other queries are still there."""
    for name in ("__spark_entry__.py", "millrace", *(["corpus_pipeline.py"] if with_llm else [])):
        source = ROOT / name
        if source.is_dir():
            for f in source.rglob("*.py"):
                if with_llm or "llm" not in f.relative_to(ROOT).parts:
                    target = tmp_path / f.relative_to(ROOT)
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_text(f.read_text())
        elif source.exists():
            (tmp_path / name).write_text(source.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    n, ops, covered = out.stdout.split()[-3:]
    expected = with_llm and (ROOT / "millrace" / "llm").is_dir()
    assert int(n) > 150 and ops == str(expected) and covered == "True"
