"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from millrace.plans import registered

REGISTRY = registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "None" if v != v else f"{float(v):.6g}" if abs(v) > 1e9 else f"{round(float(v), 5):g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def test_queries_without_sql_are_tested_by_name():
    """They are models and mixtures of rankings: see test_models."""
    assert set(REGISTRY.QUERIES) - set(REGISTRY.SQL) == {"logistic_model", "boosted_model", "model_search", "feature_ablation", "calibration_choice", "factor_sensitivity", "weight_ablation"}


@pytest.mark.parametrize("name", sorted(REGISTRY.SQL))
def test_query(spark, sf, db, name):
    df = REGISTRY.QUERIES[name](spark, sf)
    cursor = db.execute(REGISTRY.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == expected
