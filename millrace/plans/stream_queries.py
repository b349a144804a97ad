"""Streaming queries: the tables read as streams of files, until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.tables import classify, latest_per_key
from millrace.plans.registry import Tables, query
from millrace.sources.shared import new_path
from millrace.streaming import live


def _typed(df: DataFrame) -> DataFrame:
    """Event time as a timestamp in UTC."""
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _stream(t: Tables) -> DataFrame:
    # a pattern, since a table may be one file or a folder of them
    return _typed(live.read_folder(t.spark, t.path("event[s]"), t.events.schema))


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_tumbling_daily(t: Tables) -> DataFrame:
    """Days that the watermark has passed; later ones are still open."""
    out = live.drain(live.tumbling_counts(_stream(t), "ts", ["event_type"]), new_path(t.spark, "daily"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * k for k in range(0, 4)]) AS start FROM events) GROUP BY ALL HAVING start + INTERVAL 24 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_sliding_24h(t: Tables) -> DataFrame:
    out = live.drain(live.sliding_counts(_stream(t), "ts", ["event_type"]), new_path(t.spark, "sliding"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_latest_state(t: Tables) -> DataFrame:
    """Every event comes twice; repeats go within the watermark, and the newest row per key is kept."""
    stream = live.deduplicated(_stream(t).unionByName(_stream(t)), "ts", ["event_id"], "40 days")
    return live.keep_latest(stream, ["user_id"], ["ts", "event_id"], new_path(t.spark, "state")).select("user_id", "event_id")


@query(
    """SELECT r_name AS region, event_type, count(*) AS users, count(*) FILTER (WHERE value < 50) AS low, round(avg(value), 6) AS mean_value
       FROM (SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1)
       LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
       WHERE ts BETWEEN TIMESTAMP '2024-01-30 20:30:00' - INTERVAL 12 HOURS AND TIMESTAMP '2024-01-30 20:30:00' + INTERVAL 12 HOURS GROUP BY 1, 2"""
)
def stream_live_snapshot(t: Tables) -> DataFrame:
    """Newest event per user within 12 hours of now, by the user's region."""
    state = live.keep_latest(_stream(t), ["user_id"], ["ts", "event_id"], new_path(t.spark, "state"))
    near = live.snapshot(state.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "2024-01-30 20:30:00", 720)
    regions = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region")))  # nations are a fixed dimension
    users = t.customer.select("c_custkey", "c_nationkey").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), "region")
    rows = near.join(users, "user_id", "left").groupBy("region", "event_type")
    return rows.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("value") < 50).alias("low"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_id, cast(cast(ts AS DATE) AS VARCHAR) AS day, CASE WHEN day(ts) <= 3 THEN round(value * 2, 2) ELSE value END AS value FROM events")
def stream_late_replace(t: Tables) -> DataFrame:
    """The first three days come again, corrected, as a second delivery and replace what was stored."""
    sink = new_path(t.spark, "days")
    events = _stream(t).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    live.replace_touched(events.withColumn("delivery", F.lit(1)), "day", "delivery", sink, f"{sink}-first")
    again = events.filter(F.col("day") <= "2024-01-03").withColumn("value", F.round(F.col("value") * 2, 2))
    return live.replace_touched(again.withColumn("delivery", F.lit(2)), "day", "delivery", sink, f"{sink}-second").select("event_id", "day", "value")


@query("SELECT round((epoch(TIMESTAMP '2024-02-01 12:00:00') - floor(epoch(max(ts)))) / 3600, 2) AS age_hours, CASE WHEN round((epoch(TIMESTAMP '2024-02-01 12:00:00') - floor(epoch(max(ts)))) / 3600, 2) > 30 THEN 'WARN' ELSE 'PASS' END AS status FROM events")
def freshness_status(t: Tables) -> DataFrame:
    return live.freshness(_typed(t.events), "ts", "2024-02-01 12:00:00")


@query("WITH o AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), n AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1) SELECT CASE WHEN o.user_id IS NULL THEN 'new' WHEN o.v <> n.v THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n FROM n LEFT JOIN o USING (user_id) GROUP BY 1")
def stream_watch_ingest(t: Tables) -> DataFrame:
    """Watched keys (users who ever bought) are ingested from a stream and classified against the state before it."""
    cut = F.lit("2024-01-20").cast("timestamp")
    rows = _typed(t.events)
    watch = rows.filter("event_type = 'purchase'").select("user_id").distinct()
    old = latest_per_key(rows.filter(F.col("ts") < cut), ["user_id"], ["ts", "event_id"])
    stream = _stream(t).filter(F.col("ts") >= cut).join(watch, "user_id", "left_semi")
    new = live.keep_latest(stream, ["user_id"], ["ts", "event_id"], new_path(t.spark, "watched"))
    return classify(old, new, ["user_id"], ["event_type"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
