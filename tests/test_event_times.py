"""Times of events are taken to the nearest millisecond, as in the SQL."""

import datetime

import duckdb

from millrace.plans import registered

REGISTRY = registered()


def test_asof_one_key_has_the_milliseconds_of_its_sql(spark, tmp_path):
    at = lambda us: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us)
    kinds = [("view", 1_499), ("purchase", 2_500), ("view", 4_501), ("purchase", 60_004_400), ("view", 90_000_500), ("purchase", 150_000_499), ("purchase", 150_000_500), ("purchase", 150_001_500), ("view", 500_000_627), ("purchase", 499_999_999)]
    spark.createDataFrame([(i, at(us), 7, kind, float(i), None) for i, (kind, us) in enumerate(kinds)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    asked = f"SELECT event_id, matched_ts, value FROM ({REGISTRY.SQL['asof_one_key']})"
    got = REGISTRY.QUERIES["asof_one_key"](spark, str(tmp_path)).select("event_id", "matched_ts", "value").collect()
    assert sorted(tuple(r) for r in got) == sorted(db.execute(asked).fetchall())
    assert sum(r.matched_ts is not None for r in got) == 5
