"""Runs carried to both ends: every line or sentence of an accepted run that occurs earlier goes, its tail included."""

from collections import Counter

import duckdb
import pytest
from test_dedup import as_bag

from millrace.llm import line_dedup, queries, scratch, span_dedup, spans


def same_as_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = db.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    return as_bag(queries.QUERIES[name](spark, sf), *columns) == Counter(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op10_line_dedup_extended", "op1_substring_dedup_extended"}))
def test_query_against_its_sql(spark, sf, name):
    assert same_as_sql(spark, sf, name)


def test_a_fingerprint_with_one_place_goes_no_further(spark):
    texts = ["\n".join(f"line {k} of text {d} " + "x" * 20 for k in range(30)) for d in range(5)]
    docs = spark.createDataFrame([*enumerate(texts), (9, texts[0][:900])], "doc_id long, text string")
    prints = spans.fingerprints(docs, line_dedup.lines, line_dedup.RULE)
    kept = line_dedup.matched(prints)
    assert prints.count() < spans.places(docs, line_dedup.lines, line_dedup.RULE).count() / 2
    windows = spans.extended(docs, kept, line_dedup.lines, line_dedup.RULE)
    assert {r.doc_id for r in windows.select("doc_id").distinct().collect()} == {0, 9}
    assert {r.doc_id for r in kept.select("doc_id").distinct().collect()} == {0, 9}


def test_tail_of_a_repeated_run_of_lines_goes(spark):
    run = "\n".join(["first " * 30, "second", "third"])
    docs = spark.createDataFrame([(1, f"before\n{run}\nafter"), (2, f"other\n{run}\nend"), (3, run)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got == {1: f"before\n{run}\nafter", 2: "other\nend", 3: ""}


def test_pipeline_leaves_one_document_of_an_exact_copy(spark):
    import corpus_pipeline

    text = "\n".join(["a first line of many words that differ from one another " + " ".join(f"w{k}" for k in range(40)), "a short end"])
    rows = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    for name in ("lines", "near_duplicates"):
        rows = scratch.stage(steps[name](spark, rows, ""), name)
    assert [(r.doc_id, r.text) for r in rows.collect()] == [(1, text)]


def test_tail_of_a_repeated_passage_goes(spark):
    passage = "a" * 209 + ". " + "b" * 89 + ". " + "c" * 59 + ". "
    docs = spark.createDataFrame([(1, f"One. {passage}Two."), (2, f"Three. {passage}Four.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in span_dedup.remove_repeated_spans(docs).collect()}
    assert got == {1: f"One. {passage}Two.", 2: "Three. Four."}
