"""Point-in-time features over orders: histories of groups, of sellers, and what needs the row alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.plans import features
from millrace.plans.registry import Tables, query


def _dataset(t: Tables) -> DataFrame:
    """Orders as the order dataset has them: suppliers are sellers, nations are states, and an outcome is known after ten days."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity").repartition("l_orderkey")  # for both sums and the orders
    by_seller = lines.groupBy("l_orderkey", "l_suppkey").agg(C.exact_sum("l_extendedprice").alias("value"), C.exact_sum("l_quantity").alias("grams"))
    seller = F.struct("l_suppkey", "value")
    items = by_seller.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(seller)).alias("s"), F.min_by("l_suppkey", F.struct((-F.col("value")).alias("v"), "l_suppkey")).alias("first"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.sum(F.col("grams").cast("decimal(18,2)")).cast("double").alias("grams"))
    text = lambda f: F.array_join(F.transform("s", lambda x: x[f].cast("string")), "|")
    state = lambda c: c.cast("string")
    rows = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("first") == F.col("s_suppkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.to_date("o_orderdate")
    days = (F.col("o_orderkey") % 30 + 1).cast("int")
    return rows.select(
        F.col("o_orderkey").alias("order_id"), start.cast("timestamp").alias("order_purchase_timestamp"), F.date_add(start, 10).cast("timestamp").alias("label_available_timestamp"), F.date_add(start, days).cast("timestamp").alias("order_estimated_delivery_date"),
        days.cast("double").alias("promised_delivery_days"), F.month(start).alias("purchase_month"), (F.col("o_orderstatus") == "F").cast("int").alias("late_1d"), text("l_suppkey").alias("seller_ids"), text("value").alias("seller_item_values"), F.col("first").cast("string").alias("primary_seller_id"),
        F.size("s").alias("seller_count"), state(F.col("s_nationkey")).alias("seller_state"), F.concat_ws(" ", state(F.col("s_nationkey")), state(F.col("c_nationkey"))).alias("route"), F.col("o_orderpriority").alias("primary_category"),
        F.col("total").alias("total_item_value"), (F.col("total") / 20).alias("total_freight_value"), F.col("grams").alias("total_weight_g"), (F.col("grams") * 3).alias("total_volume_cm3"),
        F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 1500).cast("double")).alias("distance_km"), (F.col("l_orderkey") * 13 % 99999).cast("string").alias("seller_zip"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 50000).cast("string")).alias("customer_zip"),
    )


_ROWS = """m AS (SELECT l_orderkey AS order_id, l_suppkey AS seller, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, cast(sum(cast(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS grams FROM lineitem GROUP BY 1, 2),
  i AS (SELECT order_id, count(*) AS sellers, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS total, cast(sum(cast(grams AS DECIMAL(18,2))) AS DOUBLE) AS grams FROM m GROUP BY 1),
  f AS (SELECT order_id, seller AS first FROM m QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY value DESC, seller) = 1),
  r AS (SELECT o_orderkey AS order_id, cast(o_orderdate AS DATE) AS day0, cast(epoch(cast(o_orderdate AS DATE)) / 86400 AS INTEGER) AS d, (o_orderstatus = 'F')::INT AS late, cast(s_nationkey AS VARCHAR) AS state, s_nationkey || ' ' || c_nationkey AS route, o_orderpriority AS category, first, sellers, total, i.grams,
        cast(o_orderkey % 30 + 1 AS INTEGER) AS promised FROM orders JOIN i ON i.order_id = o_orderkey JOIN f ON f.order_id = o_orderkey JOIN supplier ON first = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def _history(name: str, key: str, source: str) -> str:
    """Daily history of one key, with what came before each day."""
    total = lambda c, w: f"cast(coalesce(sum({c}) OVER {w}, 0) AS DOUBLE)"
    parts = [f"{total('b', f'w{k}')} AS o{k}" for k in (7, 30, 90)] + [f"{total('n', f'w{k}')} AS k{k}, {total('l', f'w{k}')} AS l{k}" for k in (30, 90)]
    windows = ", ".join(f"w{k} AS (PARTITION BY k ORDER BY day RANGE BETWEEN {k or 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)" for k in ("", 7, 30, 90))
    return f"""{name}_g AS (SELECT k, day, sum(b) AS b, sum(n) AS n, sum(l) AS l, min(CASE WHEN b = 1 THEN day END) AS fd FROM (SELECT {key} AS k, d AS day, 1 AS b, 0 AS n, 0 AS l FROM {source} UNION ALL SELECT {key}, d + 10, 0, 1, late FROM {source}) GROUP BY 1, 2),
  {name} AS (SELECT k, day, {total('b', 'w')} AS ob, coalesce(day - min(fd) OVER w, 0) AS od, {total('n', 'w')} AS kn, {total('l', 'w')} AS kl, {', '.join(parts)} FROM {name}_g WINDOW {windows})"""


def _value(name: str, h: str, prior: str = "prior") -> str:
    """SQL of one feature of history h."""
    if name == "prior_late_rate":
        return f"({h}.kl + 20 * {prior}) / ({h}.kn + 20)"
    if name.startswith("late_rate"):
        w = name.split("_")[2][:-1]
        return f"({h}.l{w} + 10 * {prior}) / ({h}.k{w} + 10)"
    if name.startswith("order_count"):
        return f"ln(1 + {h}.o{name.split('_')[2][:-1]})"
    if name == "workload_ratio_log":
        return f"ln(1 + least(greatest(({h}.o30 / 30 + cast(0.01 AS DOUBLE)) / ({h}.ob / greatest({h}.od, 30) + cast(0.01 AS DOUBLE)), 0), 20))"
    return f"ln(1 + {h}.{ {'prior_known_count_log': 'kn', 'prior_order_count_log': 'ob', 'experience_days_log': 'od'}[name] })"


_GLOBAL = _history("g", "0", "r") + ", p AS (SELECT *, CASE WHEN kn > 0 THEN kl / kn ELSE 0.05 END AS prior FROM g)"
_KEYS = {"seller_state": "state", "route": "route", "category": "category"}
_GROUP_COLUMNS = {f"global_{n}": _value(n, "p") for n in features.GLOBAL} | {f"{g}_{n}": _value(n, g) for g, (_, names) in features.GROUPS.items() for n in names}


@query(
    f"WITH {_ROWS}, {_GLOBAL}, {', '.join(_history(g, k, 'r') for g, k in _KEYS.items())} SELECT order_id, round(prior, 6) AS prior_global_late_rate, "
    + ", ".join(f"round({v}, 6) AS {k}" for k, v in _GROUP_COLUMNS.items())
    + " FROM r JOIN p ON p.day = r.d "
    + " ".join(f"JOIN {g} ON {g}.k = r.{k} AND {g}.day = r.d" for g, k in _KEYS.items())
)
def features_groups(t: Tables) -> DataFrame:
    out = features.group_features(_dataset(t))
    return out.select("order_id", *[F.round(c, 6).alias(c) for c in ("prior_global_late_rate", *_GROUP_COLUMNS)])


_SELLER_RATES = ["prior_late_rate", "late_rate_30d", "late_rate_90d"]
_SELLER_COLUMNS = (
    {f"primary_seller_{n}": f"max(CASE WHEN seller = first THEN {_value(n, 's')} END)" for n in features.PRIMARY}
    | {f"seller_{n}_weighted": f"sum(({_value(n, 's')}) * weight)" for n in [*_SELLER_RATES, "workload_ratio_log"]}
    | {f"seller_{n}_max": f"max({_value(n, 's')})" for n in [*_SELLER_RATES, "workload_ratio_log", "experience_days_log"]}
    | {"seller_experience_days_log_min": f"min({_value('experience_days_log', 's')})"}
    | {f"seller_order_count_{k}d_log_sum": f"ln(1 + sum(s.o{k}))" for k in (7, 30)}
)


@query(
    f"WITH {_ROWS}, {_GLOBAL}, mm AS (SELECT order_id, seller, first, d, late, CASE WHEN sum(value) OVER q > 0 THEN value / sum(value) OVER q ELSE 1 / count(*) OVER q END AS weight FROM m JOIN r USING (order_id) WINDOW q AS (PARTITION BY order_id)), {_history('s', 'seller', 'mm')} SELECT order_id, "
    + ", ".join(f"round({v}, 6) AS {k}" for k, v in _SELLER_COLUMNS.items())
    + " FROM mm JOIN s ON s.k = mm.seller AND s.day = mm.d JOIN p ON p.day = mm.d GROUP BY 1"
)
def features_sellers(t: Tables) -> DataFrame:
    out = features.seller_features(_dataset(t))
    return out.select("order_id", *[F.round(c, 6).alias(c) for c in _SELLER_COLUMNS])


_WEEK = "len(list_filter(range(0, promised + 1), lambda k: isodow(day0 + cast(k AS INTEGER)) < 6))"
_FREE = "len(list_filter(range(0, promised + 1), lambda k: isodow(day0 + cast(k AS INTEGER)) < 6 AND strftime(day0 + cast(k AS INTEGER), '%m-%d') IN (" + ", ".join(f"'{d}'" for d in C.HOLIDAYS) + ")))"
_KM = "CASE WHEN order_id % 7 > 0 THEN cast(order_id % 1500 AS DOUBLE) END"
_STATIC_COLUMNS = {
    "freight_item_ratio": "least(total / 20 / greatest(total, 1), 10)", "promised_days_per_500km": f"promised / greatest(coalesce({_KM}, 0) / 500, 1)", "distance_km_log": f"ln(1 + {_KM})", "distance_per_promised_day": f"{_KM} / greatest(promised, 1)",
    "freight_per_km": f"CASE WHEN {_KM} IS NOT NULL THEN least(total / 20 / greatest({_KM}, 10), 10) END", "freight_per_kg": "least(total / 20 / greatest(grams / 1000, 0.1), 500)", "freight_per_item_value": "least(total / 20 / greatest(total, 1), 10)", "weight_per_volume": "least(grams / greatest(grams * 3, 1), 100)",
}
_STATIC_COUNTS = {
    "promised_delivery_weekday": "isodow(day0 + promised)", "promised_delivery_month": "month(day0 + promised)", "promised_delivery_near_weekend": "(isodow(day0 + promised) >= 5)::INT", "weekends_in_promise_window": f"promised + 1 - {_WEEK}",
    "business_days_in_promise_window": f"{_WEEK} - {_FREE}", "national_holidays_in_promise_window": _FREE, "multi_seller": "(sellers > 1)::INT",
}
_REGIONS = ("order_id * 13 % 99999 // 1000", "order_id % 50000 // 1000")


@query(
    f"WITH {_ROWS} SELECT order_id, " + ", ".join(f"round(cast({v} AS DOUBLE), 6) AS {k}" for k, v in _STATIC_COLUMNS.items()) + ", " + ", ".join(f"cast({v} AS INTEGER) AS {k}" for k, v in _STATIC_COUNTS.items())
    + f""", CASE WHEN month(day0) IN (12, 1, 2) THEN 'summer' WHEN month(day0) IN (3, 4, 5) THEN 'autumn' WHEN month(day0) IN (6, 7, 8) THEN 'winter' ELSE 'spring' END AS season,
    cast({_REGIONS[0]} AS VARCHAR) || ' -> ' || CASE WHEN order_id % 5 > 0 THEN cast({_REGIONS[1]} AS VARCHAR) ELSE '__missing__' END AS zip_region_route,
    CASE WHEN order_id % 7 = 0 THEN 'nan' WHEN order_id % 1500 <= 50 THEN '0-50' WHEN order_id % 1500 <= 150 THEN '50-150' WHEN order_id % 1500 <= 300 THEN '150-300' WHEN order_id % 1500 <= 600 THEN '300-600' WHEN order_id % 1500 <= 1000 THEN '600-1000' ELSE '1000+' END AS distance_bucket FROM r"""
)
def features_static(t: Tables) -> DataFrame:
    out = features.static_features(_dataset(t))
    return out.select("order_id", *[F.round(c, 6).alias(c) for c in _STATIC_COLUMNS], *[F.col(c).cast("int").alias(c) for c in _STATIC_COUNTS], "season", "zip_region_route", "distance_bucket")
