"""Features of orders from what was known when each was placed.

Purchases count on the day of purchase, outcomes on the day on which they became known, and an order sees both strictly
before its own day. The histories of all kinds of an order's keys are one table: an order is an event of each of its keys,
events are added up to (kind, key, day), and one sort of these rows gives every total and window. So orders are read once
and shuffled once however many kinds there are, a hot key has no more rows than days, and orders meet histories by key and
day. Sellers, of which an order has several, have a table of their own whose daily totals are written.

Rates are smoothed towards the global rate known before the day, with strength 20 for all that came before and 10 for
trailing windows. Counts are logarithms of 1 + n. Keys that are null are one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators.tables import bounded
from millrace.plans.orders import seller_shares
from millrace.sources.shared import stage

MISSING = "__missing__"
#: The kinds of keys beside those of GROUPS: all orders, and the sellers of an order.
ALL, SELLER = "all", "seller"
STRENGTH, WINDOW_STRENGTH, DEFAULT_PRIOR = 20.0, 10.0, 0.05
ORDER_WINDOWS, OUTCOME_WINDOWS = (7, 30, 90), (30, 90)
#: Rows of daily histories that are broadcast.
HISTORY_ROWS = 200_000


def order_days(orders: DataFrame) -> DataFrame:
    """orders with the day of purchase, the day on which the outcome was known, and the first one as a number."""
    return orders.withColumns({"bought_on": F.to_date("order_purchase_timestamp"), "known_on": F.to_date("label_available_timestamp"), "day": F.unix_date(F.to_date("order_purchase_timestamp"))})


def key_pairs(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, key, bought_on, known_on, late_1d): a row for each order and kind, and one of the kind ALL; null keys are MISSING."""
    keys = [F.struct(F.lit(ALL).alias("kind"), F.lit("").alias("key")), *[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("key")) for k, c in kinds.items()]]
    return rows.select(F.inline(F.array(*keys)), "bought_on", "known_on", "late_1d")


def daily_totals(pairs: DataFrame) -> DataFrame:
    """(kind, key, day, b, n, late): purchases, known outcomes and late ones of each key and day. What scoring needs later."""
    one = lambda day, b, n, late: F.struct(F.unix_date(day).alias("day"), F.lit(b).alias("b"), F.lit(n).alias("n"), late.cast("int").alias("late"))
    events = pairs.select("kind", "key", F.inline(F.array(one("bought_on", 1, 0, F.lit(0)), one("known_on", 0, 1, F.coalesce("late_1d", F.lit(0)))))).filter("day is not null")
    return events.groupBy("kind", "key", "day").agg(*[F.sum(c).cast("long").alias(c) for c in ("b", "n", "late")])


def key_histories(daily: DataFrame, asked: DataFrame | None = None, written: bool = True) -> DataFrame:
    """Per (kind, key) and day of `asked` (by default the days of purchase): totals and trailing windows, strictly before
    the day, of purchases (o_*) and of known outcomes (k_*). Unless they are used once, they are written."""
    if asked is None:
        rows, wanted = daily, F.col("b") > 0
    else:
        more = asked.select("kind", "key", "day").distinct().select("*", *[F.lit(0).cast("long").alias(c) for c in ("b", "n", "late")], F.lit(1).alias("asked"))
        both = daily.withColumn("asked", F.lit(0)).unionByName(more)
        rows, wanted = both.groupBy("kind", "key", "day").agg(*[F.sum(c).alias(c) for c in ("b", "n", "late")], F.max("asked").alias("asked")), F.col("asked") > 0
    order = Window.partitionBy("kind", "key").orderBy("day")
    before = lambda c, days=None: F.coalesce(F.sum(c).over(order.rangeBetween(Window.unboundedPreceding if days is None else -days, -1)), F.lit(0))
    columns = {"o_prior": before("b"), "k_prior": before("n"), "k_late": before("late")} | {f"o_{w}": before("b", w) for w in ORDER_WINDOWS}
    columns |= {f"k_{w}": before("n", w) for w in OUTCOME_WINDOWS} | {f"k_late_{w}": before("late", w) for w in OUTCOME_WINDOWS}
    first = F.min(F.when(F.col("b") > 0, F.col("day"))).over(order.rangeBetween(Window.unboundedPreceding, -1))
    columns["o_days"] = F.coalesce(F.col("day") - first, F.lit(0)).cast("int")
    out = rows.withColumns(columns).filter(wanted).select("kind", "key", "day", *columns)
    return stage(out, "histories") if written else out


def history_features(prior: Column | str = "prior") -> dict[str, Column]:
    """All that a key's history gives, under the names without a prefix."""
    p = C.col(prior)
    rates = {"prior_late_rate": C.smoothed_rate("k_late", "k_prior", p, STRENGTH)} | {f"late_rate_{w}d": C.smoothed_rate(f"k_late_{w}", f"k_{w}", p, WINDOW_STRENGTH) for w in OUTCOME_WINDOWS}
    counts = {f"order_count_{w}d_log": F.log1p(f"o_{w}") for w in ORDER_WINDOWS}
    return rates | counts | {
        "prior_known_count_log": F.log1p("k_prior"), "prior_order_count_log": F.log1p("o_prior"), "experience_days_log": F.log1p(F.greatest(F.col("o_days"), F.lit(0))),
        "workload_ratio_log": C.workload_ratio("o_30", "o_prior", "o_days"),
    }


#: What is kept of each key's history.
GROUPS = {
    "seller_state": ("seller_state", ["prior_late_rate", "prior_order_count_log", "late_rate_30d", "late_rate_90d", "experience_days_log"]),
    "route": ("route", ["prior_late_rate", "order_count_7d_log", "order_count_30d_log", "order_count_90d_log", "workload_ratio_log", "late_rate_30d", "late_rate_90d"]),
    "category": ("primary_category", ["prior_late_rate", "order_count_7d_log", "order_count_30d_log", "order_count_90d_log", "workload_ratio_log"]),
}
GLOBAL = ["order_count_7d_log", "order_count_30d_log", "order_count_90d_log", "workload_ratio_log"]
PRIMARY = ["prior_late_rate", "prior_known_count_log", "prior_order_count_log", "late_rate_30d", "late_rate_90d", "order_count_7d_log", "order_count_30d_log", "order_count_90d_log", "experience_days_log", "workload_ratio_log"]


def _days(histories: DataFrame) -> DataFrame:
    """One row per day of purchase: prior, and the global counts and workload."""
    prior = F.coalesce(F.try_divide(F.col("k_late").cast("double"), F.col("k_prior").cast("double")), F.lit(DEFAULT_PRIOR))
    found = history_features(prior)
    rows = histories.filter(F.col("kind") == ALL).select("day", prior.alias("prior"), *[found[n].alias(f"global_{n}") for n in GLOBAL])
    return bounded(rows, HISTORY_ROWS)


def _kind(histories: DataFrame, kind: str, days: DataFrame) -> DataFrame:
    """The histories of one kind with the prior of each day."""
    return histories.filter(F.col("kind") == kind).drop("kind").join(days.select("day", "prior"), "day")


def _with_groups(rows: DataFrame, histories: DataFrame) -> DataFrame:
    days, found = _days(histories), history_features()
    out = rows.join(days, "day").withColumn("prior_global_late_rate", F.col("prior")).drop("prior")
    for kind, (column, names) in GROUPS.items():
        history = _kind(histories, kind, days).select(F.col("key").alias("__key"), "day", *[found[n].alias(f"{kind}_{n}") for n in names])
        key = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
        out = out.withColumn("__key", key).join(bounded(history, HISTORY_ROWS), ["__key", "day"]).drop("__key")
    return out.drop("bought_on", "known_on", "day")


def _members(rows: DataFrame) -> DataFrame:
    return seller_shares(rows, "primary_seller_id", "bought_on", "known_on", "day", "late_1d")


def _with_sellers(members: DataFrame, histories: DataFrame, days: DataFrame) -> DataFrame:
    """Members meet their sellers' counts by key and day, and go to their order with these; features, which are more and
    wider, are made where they are added up."""
    found = history_features()
    counts = histories.filter(F.col("kind") == SELLER).select(F.col("key").alias("seller_id"), "day", *[c for c in histories.columns if c not in ("kind", "key", "day")])
    each = members.select("order_id", "seller_id", "day", "weight", (F.col("seller_id") == F.col("primary_seller_id")).alias("first")).join(counts, ["seller_id", "day"])
    each = each.drop("seller_id").repartition("order_id").join(days.select("day", "prior"), "day").select("order_id", "weight", "first", "o_7", "o_30", *[c.alias(n) for n, c in found.items()])
    w, first = F.col("weight"), F.col("first")
    rates = ["prior_late_rate", "late_rate_30d", "late_rate_90d"]
    return each.groupBy("order_id").agg(
        *[F.max(F.when(first, F.col(n))).alias(f"primary_seller_{n}") for n in PRIMARY],
        *[F.sum(F.col(n) * w).alias(f"seller_{n}_weighted") for n in [*rates, "workload_ratio_log"]], *[F.max(n).alias(f"seller_{n}_max") for n in [*rates, "workload_ratio_log", "experience_days_log"]],
        F.min("experience_days_log").alias("seller_experience_days_log_min"), *[F.log1p(F.sum(f"o_{k}")).alias(f"seller_order_count_{k}d_log_sum") for k in (7, 30)],
    )


def _few(daily: DataFrame, histories: DataFrame) -> DataFrame:
    """histories with a broadcast hint if the written daily totals that they are made of are few."""
    return F.broadcast(histories) if daily.limit(HISTORY_ROWS + 1).count() <= HISTORY_ROWS else histories


_COLUMNS = {kind: column for kind, (column, _) in GROUPS.items()}


def _staged(orders: DataFrame, *columns: str) -> DataFrame:
    """The order days, written once: they are read for the histories and again to meet them."""
    rows = order_days(orders)
    return stage(rows.select(*columns) if columns else rows, "order-days")


def _seller_pairs(members: DataFrame) -> DataFrame:
    return members.select(F.lit(SELLER).alias("kind"), F.coalesce("seller_id", F.lit(MISSING)).alias("key"), "bought_on", "known_on", "late_1d")


def group_features(orders: DataFrame) -> DataFrame:
    """orders with the global, seller-state, route and category histories."""
    rows = _staged(orders)
    return _with_groups(rows, key_histories(daily_totals(key_pairs(rows, _COLUMNS))))


def group_totals(orders: DataFrame) -> DataFrame:
    """The daily totals that group_features of later orders need, to be exported with a model."""
    return daily_totals(key_pairs(_staged(orders), _COLUMNS))


def later_group_features(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """group_features of orders that are scored later, against exported totals: the orders themselves are no history."""
    rows = _staged(orders.withColumns({"label_available_timestamp": F.lit(None).cast("timestamp"), "late_1d": F.lit(None).cast("int")}))
    asked = key_pairs(rows, _COLUMNS).select("kind", "key", F.unix_date("bought_on").alias("day"))
    return _with_groups(rows, key_histories(totals, asked))


def seller_features(orders: DataFrame) -> DataFrame:
    """One row per order: the history of its primary seller, and sums, weighted means and extremes over its sellers."""
    rows = _staged(orders, "order_id", "seller_ids", "seller_item_values", "primary_seller_id", "bought_on", "known_on", "day", "late_1d")
    members = _members(rows)
    days = _days(key_histories(daily_totals(key_pairs(rows, {}))))
    daily = stage(daily_totals(_seller_pairs(members)), "daily")
    return _with_sellers(members, _few(daily, key_histories(daily, written=False)), days)


def static_features(orders: DataFrame) -> DataFrame:
    """orders with ratios and calendar counts that need the row alone."""
    start, end = F.to_date("order_purchase_timestamp"), F.to_date("order_estimated_delivery_date")
    weekdays, holidays = C.business_days(start, end), C.holidays_between(start, end, weekdays=True)
    at_least = lambda c, low: F.greatest(F.col(c), F.lit(low))
    floor = lambda c, low: F.when(C.col(c).isNotNull(), F.greatest(C.col(c), F.lit(low)))
    freight, grams, km = (floor(c, 0.0) for c in ("total_freight_value", "total_weight_g", "distance_km"))
    regions = [C.zip_region("seller_zip"), C.zip_region("customer_zip")]
    return orders.withColumns(
        {
            "freight_item_ratio": F.least(F.col("total_freight_value") / at_least("total_item_value", 1.0), F.lit(10.0)),
            "promised_days_per_500km": F.col("promised_delivery_days") / F.greatest(F.coalesce("distance_km", F.lit(0.0)) / 500, F.lit(1.0)),
            "season": C.season("purchase_month"),
            "promised_delivery_weekday": F.weekday(end) + 1,
            "promised_delivery_month": F.month(end),
            "promised_delivery_near_weekend": (F.weekday(end) >= 4).cast("int"),
            "weekends_in_promise_window": F.datediff(end, start) + 1 - weekdays,
            "business_days_in_promise_window": weekdays - holidays,
            "national_holidays_in_promise_window": holidays,
            "distance_km_log": F.log1p(km),
            "distance_per_promised_day": km / at_least("promised_delivery_days", 1.0),
            "freight_per_km": F.when(km.isNotNull(), F.least(freight / floor(km, 10.0), F.lit(10.0))),
            "freight_per_kg": F.when(grams.isNotNull(), F.least(freight / floor(grams / 1000, 0.1), F.lit(500.0))),
            "freight_per_item_value": F.least(freight / at_least("total_item_value", 1.0), F.lit(10.0)),
            "weight_per_volume": F.when(grams.isNotNull() & F.col("total_volume_cm3").isNotNull(), F.least(grams / at_least("total_volume_cm3", 1.0), F.lit(100.0))),
            "multi_seller": (F.col("seller_count") > 1).cast("int"),
            "seller_zip_region": regions[0],
            "customer_zip_region": regions[1],
            "zip_region_route": F.concat_ws(" -> ", *regions),
            "distance_bucket": C.bucket(km, [50, 150, 300, 600, 1000], ["0-50", "50-150", "150-300", "300-600", "600-1000", "1000+"], "nan"),
        }
    )


def feature_table(orders: DataFrame) -> DataFrame:
    """Orders as orders.order_dataset makes them, with every feature; the histories of all kinds are made together."""
    rows = _staged(orders)
    members = _members(rows)
    histories = key_histories(daily_totals(key_pairs(rows, _COLUMNS)))
    daily = stage(daily_totals(_seller_pairs(members)), "daily")
    sellers = _with_sellers(members, _few(daily, key_histories(daily, written=False)), _days(histories))
    return static_features(_with_groups(rows, histories)).join(sellers, "order_id")
