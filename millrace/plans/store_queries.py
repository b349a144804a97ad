"""Tables of a store over several commits, growing schemas, grid joins, hot keys and resampled metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import asof, geo, ranking
from millrace.plans.registry import Tables, query
from millrace.sources.commits import Store
from millrace.sources.shared import new_path

_YEAR = "year(o_orderdate)"


def _order_store(t: Tables) -> Store:
    """Orders before 1999; then those from 1998 on at twice the price, for whose keys orders in state P go."""
    store = Store(t.spark, new_path(t.spark, "order-store"))
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year"))
    with store.transaction() as c:
        c.upsert("orders", rows.filter("year < 1999").drop("year"), ["o_orderkey"])
    late = rows.filter("year >= 1998").drop("year")
    with store.transaction() as c:
        c.upsert("orders", late.filter("o_orderstatus <> 'P'").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2)), ["o_orderkey"], late.select("o_orderkey"))
    return store


@query(f"SELECT o_orderkey, CASE WHEN {_YEAR} >= 1998 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE {_YEAR} < 1998 OR o_orderstatus <> 'P'")
def store_upsert(t: Tables) -> DataFrame:
    """Two upserts, the second with deletions."""
    return _order_store(t).read("orders")


@query(f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE {_YEAR} < 1999")
def store_time_travel(t: Tables) -> DataFrame:
    """The commit before the last one, read after it."""
    return _order_store(t).read("orders", number=0)


@query(
    """WITH n AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS again FROM orders)
    SELECT o_orderkey, again, count(l_orderkey) AS lines, coalesce(sum(cast(l_quantity AS DECIMAL(18,2))), 0)::DOUBLE AS quantity FROM n LEFT JOIN lineitem ON l_orderkey = o_orderkey AND (NOT again OR l_quantity > 25) GROUP BY ALL"""
)
def store_parent_children(t: Tables) -> DataFrame:
    """Orders with their lines; urgent ones come again with the lines over 25 alone, in one commit of both tables."""
    store = Store(t.spark, new_path(t.spark, "order-lines"))
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    with store.transaction() as c:
        c.append("orders", t.orders.select("o_orderkey", F.lit(False).alias("again")))
        c.append("lines", lines)
    with store.transaction() as c:
        c.upsert("orders", urgent.withColumn("again", F.lit(True)), ["o_orderkey"])
        c.upsert("lines", lines.filter("l_quantity > 25").join(urgent, "o_orderkey", "left_semi"), ["o_orderkey"], urgent)
    number = store.state()[0]  # both tables as of one commit
    per = store.read("lines", number=number).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    return store.read("orders", number=number).join(per, "o_orderkey", "left").fillna(0, ["lines", "quantity"])


@query("SELECT event_id, cast(user_id AS BIGINT) AS user_id, CASE WHEN day(ts) > 10 THEN event_type END AS event_type, CASE WHEN day(ts) > 20 THEN value END AS value FROM events")
def schema_growth(t: Tables) -> DataFrame:
    """Three deliveries: users as ints; then as longs, with a type; then with a value in another order of columns."""
    store = Store(t.spark, new_path(t.spark, "growing"))
    day = F.dayofmonth("ts")
    parts = [(day <= 10, ["event_id", F.col("user_id").cast("int").alias("user_id")]), ((day > 10) & (day <= 20), ["event_id", F.col("user_id").cast("long").alias("user_id"), "event_type"]), (day > 20, ["value", "event_type", F.col("user_id").cast("long").alias("user_id"), "event_id"])]
    for condition, columns in parts:
        with store.transaction() as c:
            c.append("events", t.events.filter(condition).select(*columns))
    return store.read("events")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (SELECT min(r_name) FROM region WHERE l_extendedprice + 0.005 BETWEEN r_regionkey * 18000.0 - 500 AND r_regionkey * 18000.0 + 24000 AND l_quantity + 0.5 BETWEEN 5 AND 45
    AND NOT (l_extendedprice + 0.005 BETWEEN r_regionkey * 18000.0 + 5000 AND r_regionkey * 18000.0 + 9000 AND l_quantity + 0.5 BETWEEN 20 AND 30)) AS region_code FROM lineitem"""
)
def grid_regions(t: Tables) -> DataFrame:
    """Lines as points of price and quantity in overlapping rectangles with a hole each, one for each region."""
    corner = lambda x, y: F.array(x.cast("double"), F.lit(float(y)))
    ring = lambda a, b, y0, y1: F.array(corner(a, y0), corner(b, y0), corner(b, y1), corner(a, y1), corner(a, y0))
    x = F.col("r_regionkey") * 18000.0
    regions = t.region.select(F.col("r_name").alias("code"), F.array(F.array(ring(x - 500, x + 24000, 5, 45), ring(x + 5000, x + 9000, 20, 30))).alias("polygons"))
    points = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_extendedprice") + 0.005).alias("longitude"), (F.col("l_quantity") + 0.5).alias("latitude"))
    return geo.assign_regions(points, regions).drop("longitude", "latitude")


@query(
    """WITH p AS (SELECT event_id, epoch_ms(ts) AS s FROM events WHERE event_type = 'purchase'), v AS (SELECT epoch_ms(ts) AS s, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
    b AS (SELECT event_id, p.s, v.s AS bs, v.value AS bv FROM p ASOF LEFT JOIN v ON p.s >= v.s), a AS (SELECT event_id, v.s AS fs, v.value AS fv FROM p ASOF LEFT JOIN v ON p.s <= v.s)
    SELECT event_id, CASE WHEN s - bs <= coalesce(fs - s, s - bs) THEN CASE WHEN s - bs <= 60000 THEN bs END WHEN fs - s <= 60000 THEN fs END AS matched_ts, CASE WHEN s - bs <= coalesce(fs - s, s - bs) THEN CASE WHEN s - bs <= 60000 THEN bv END WHEN fs - s <= 60000 THEN fv END AS value FROM b JOIN a USING (event_id)"""
)
def asof_one_key(t: Tables) -> DataFrame:
    """The nearest view of anyone within a minute of each purchase, times to the nearest millisecond: one key for all rows, split into slices of time."""
    nearest = F.unix_millis(F.col("ts").cast("timestamp") + F.expr("interval 500 microseconds"))
    rows = t.events.select("event_id", "event_type", "value", F.lit("all").alias("key"), nearest.alias("s"))
    views = rows.filter("event_type = 'view'").groupBy("key", "s").agg(F.max("value").alias("value"))
    return asof.asof_nearest(rows.filter("event_type = 'purchase'").select("event_id", "key", "s"), views, ["key"], "s", "s", 60_000, ["value"]).select("event_id", "matched_ts", "value")


_REPLICATES = 250


def _resampled(score: str) -> str:
    """SQL of the metrics of one score per replicate."""
    return f"""(WITH g AS (SELECT rep, {score} AS s, sum(k * y)::DOUBLE AS tp, sum(k * (1 - y))::DOUBLE AS fp FROM w GROUP BY 1, 2), c AS (SELECT *, sum(tp) OVER o AS ctp, sum(fp) OVER o AS cfp, sum(tp + fp) OVER (PARTITION BY rep) AS total FROM g WHERE tp + fp > 0 WINDOW o AS (PARTITION BY rep ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
    SELECT rep, sum(tp) AS p, sum(fp) AS q, sum(tp * ctp / (ctp + cfp)) / sum(tp) AS ap, (sum(tp) * sum(fp) - sum(tp * cfp) + sum(tp * fp) / 2) / (sum(tp) * sum(fp)) AS auc, sum(tp * greatest(0, least(1, (ceil(total * 0.1) - (ctp + cfp - tp - fp)) / (tp + fp)))) / sum(tp) AS capture FROM c GROUP BY 1)"""


_BOOTSTRAP = f"""WITH l AS (SELECT rep, 1 + ('0x' || substr(md5(cast(rep AS VARCHAR)), 1, 7))::BIGINT AS a, ('0x' || substr(md5(cast(rep AS VARCHAR)), 8, 7))::BIGINT AS b FROM (SELECT unnest(range(0, {_REPLICATES})) AS rep)),
    r AS (SELECT floor(o_totalprice / 1000) AS price, floor(o_totalprice / 1000) % 37 AS other, (o_orderstatus = 'F')::INT AS y, ('0x' || substr(md5(cast(o_orderkey AS VARCHAR)), 1, 7))::BIGINT AS h FROM orders),
    u AS (SELECT rep, price, other, y, (a * h + b) % {ranking.PRIME} / cast({ranking.PRIME} AS DOUBLE) AS u FROM r, l), w AS (SELECT rep, price, other, y, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 ELSE 4 END AS k FROM u WHERE u >= 0.36787944),
    m AS (SELECT cast(rep AS INTEGER) AS rep, cast(x.p + x.q AS BIGINT) AS n, cast(x.p AS BIGINT) AS positives, round(x.ap, 6) AS ap_a, round(z.ap, 6) AS ap_b, round(x.ap / (x.p / (x.p + x.q)), 6) AS lift_a, round(z.ap / (z.p / (z.p + z.q)), 6) AS lift_b, round(x.auc, 6) AS auc_a, round(z.auc, 6) AS auc_b, round(x.capture, 6) AS capture_a, round(z.capture, 6) AS capture_b
    FROM {_resampled("price")} x JOIN {_resampled("other")} z USING (rep))"""


def _two_scores(t: Tables) -> DataFrame:
    price = F.floor(F.col("o_totalprice") / 1000).cast("double")
    return t.orders.select("o_orderkey", price.alias("price"), (price % 37).alias("other"), (F.col("o_orderstatus") == "F").alias("y"))


@query(_BOOTSTRAP + " SELECT * FROM m")
def bootstrap_ranking(t: Tables) -> DataFrame:
    return ranking.bootstrap_metrics(_two_scores(t), "price", "other", "y", "o_orderkey", _REPLICATES)


@query(
    _BOOTSTRAP + ", d AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS metric, {k}_a - {k}_b AS d FROM m" for k in ranking.METRICS)
    + ") SELECT metric, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.5), 6) AS middle, round(quantile_cont(d, 0.975), 6) AS high, round(avg((d > 0)::INT), 6) AS share_above FROM d GROUP BY 1"
)
def bootstrap_differences(t: Tables) -> DataFrame:
    return ranking.bootstrap_intervals(bootstrap_ranking(t))
