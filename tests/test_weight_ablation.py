"""Weights are compared over all documents, not over those of two short lists."""

import duckdb
import pytest

from millrace.operators import retrieval
from millrace.plans import registered
from millrace.plans.text_queries import _OWN, _VEC

#: The whole rankings, by the parts that other queries' SQL has.
SQL = f"""WITH {_OWN}, {_VEC}, lex AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM s),
    k AS (SELECT a, 1 - a AS b FROM (SELECT unnest([1, 0.75, 0.5, 0.25, 0])::DOUBLE AS a)), h AS (SELECT query, doc, coalesce(score, 0) AS score, coalesce(1 / place, 0) AS inverse FROM vs FULL JOIN lex USING (query, doc)),
    r AS (SELECT a, b, query, doc, row_number() OVER (PARTITION BY a, query ORDER BY round(score * a + inverse * b, 6) DESC, doc) AS place FROM h, k),
    j AS (SELECT a, b, x.vec_id AS query, y.vec_id AS doc FROM embeddings x JOIN embeddings y ON x.label = y.label, k WHERE x.vec_id % 50 = 0),
    m AS (SELECT a, b, query, count(*) AS rel, min(place) AS best, count(*) FILTER (WHERE place <= 5) AS found, sum(ln(2) / ln(place + 1)) FILTER (WHERE place <= 5) AS dcg FROM j LEFT JOIN r USING (a, b, query, doc) GROUP BY 1, 2, 3)
    SELECT a, b, round(avg(coalesce(1 / best, 0)), 6), round(avg(found / rel), 6), round(avg(coalesce(dcg, 0) / list_sum([ln(2) / ln(i + 1) for i in range(1, least(rel, 5) + 1)])), 6) FROM m GROUP BY 1, 2"""


@pytest.mark.parametrize("depth,pairs", [(50, 500_000), (2, 30)])
def test_all_documents_take_part(spark, sf, monkeypatch, depth, pairs):
    """Whatever the lists begin with, the rest is looked up."""
    monkeypatch.setattr(retrieval, "DEPTH", depth)
    monkeypatch.setattr(retrieval, "PAIRS", pairs)
    db = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    expected = sorted(db.execute(SQL).fetchall())
    got = sorted(tuple(r) for r in registered().QUERIES["weight_ablation"](spark, sf).collect())
    assert [x for row in got for x in row] == pytest.approx([x for row in expected for x in row], abs=1.1e-6)
