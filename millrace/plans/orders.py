"""Order-level dataset from the eight order tables: one row per delivered order, with its label and what was known at purchase.

Wide tables are aggregated to the order before they meet it; ZIP medians are one row per prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators.tables import require_unique


def zip_coordinates(geolocation: DataFrame) -> DataFrame:
    """Median coordinates per ZIP prefix, of points inside the country."""
    sane = geolocation.filter(F.col("geolocation_lat").between(-35, 6) & F.col("geolocation_lng").between(-75, -30))
    return sane.groupBy(F.col("geolocation_zip_code_prefix").alias("zip")).agg(F.median("geolocation_lat").alias("lat"), F.median("geolocation_lng").alias("lng"))


def item_rows(t: dict[str, DataFrame]) -> DataFrame:
    """Items with their product's category, weight and volume and their seller's place."""
    names = t["category_translation"].dropDuplicates(["product_category_name"])
    products = t["products"].join(names, "product_category_name", "left")
    category = F.coalesce("product_category_name_english", "product_category_name").alias("category")
    volume = (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")).alias("volume")
    products = products.select("product_id", category, F.col("product_weight_g").alias("weight"), volume)
    return t["order_items"].join(products, "product_id", "left").join(t["sellers"], "seller_id", "left")


def order_items(items: DataFrame) -> DataFrame:
    """Totals, seller composition and primary item per order: sums per (order, seller) first, then one row per order.

    The primary item is that with the highest price, then freight, then the least ids.
    """
    best = F.struct((-F.col("price")).alias("p"), (-F.col("freight_value")).alias("f"), "order_item_id", "seller_id", "product_id")
    chosen = F.struct("seller_id", "seller_state", "seller_zip_code_prefix", "category")
    per_seller = items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("value"), F.sum("freight_value").alias("freight"), F.sum("weight").alias("weight"), F.sum("volume").alias("volume"),
        F.collect_set("category").alias("categories"), F.min(best).alias("best"), F.min_by(chosen, best).alias("chosen"),
    )
    text = lambda v: F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
    out = per_seller.groupBy("order_id").agg(
        F.sum("n").alias("item_count"), F.sum("value").alias("total_item_value"), F.sum("freight").alias("total_freight_value"), F.sum("weight").alias("total_weight_g"), F.sum("volume").alias("total_volume_cm3"),
        F.count(F.lit(1)).alias("seller_count"), F.size(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("category_count"),
        F.array_sort(F.collect_list(F.struct("seller_id", "value"))).alias("sellers"), F.min_by("chosen", "best").alias("primary"),
    )
    return out.select(
        "order_id", "item_count", "total_item_value", "total_freight_value", "total_weight_g", "total_volume_cm3", "seller_count", "category_count", F.col("primary.seller_id").alias("primary_seller_id"),
        F.array_join(F.transform("sellers", lambda s: s["seller_id"]), "|").alias("seller_ids"), F.array_join(F.transform("sellers", lambda s: text(s["value"])), "|").alias("seller_item_values"),
        F.col("primary.seller_zip_code_prefix").alias("seller_zip"), F.col("primary.seller_state").alias("seller_state"), F.coalesce("primary.category", F.lit("__missing__")).alias("primary_category"),
    )


def order_payments(payments: DataFrame) -> DataFrame:
    """Total, most instalments, and the type of the largest payment (then the earliest)."""
    order = F.struct((-F.col("payment_value")).alias("v"), "payment_sequential", "payment_type")
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("payment_value"), F.max("payment_installments").alias("payment_installments"), F.min_by("payment_type", order).alias("primary_payment_type"))


def order_dataset(t: dict[str, DataFrame]) -> DataFrame:
    require_unique(t["customers"], ["customer_id"])
    require_unique(t["orders"], ["order_id"])
    times = ["order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"]
    bought, arrived, promised = (F.col(c) for c in times)
    days = (F.unix_micros(promised) - F.unix_micros(bought)) / F.lit(86400e6)
    orders = t["orders"].filter("order_status = 'delivered'").dropna(subset=times).filter(days > 0)
    customers = t["customers"].select("customer_id", "customer_state", F.col("customer_zip_code_prefix").alias("customer_zip"))
    rows = orders.join(customers, "customer_id").join(order_items(item_rows(t)), "order_id").join(order_payments(t["order_payments"]), "order_id", "left")
    places = zip_coordinates(t["geolocation"])
    for side in ("seller", "customer"):
        rows = rows.join(places.select(F.col("zip").alias(f"{side}_zip"), F.col("lat").alias(f"{side}_lat"), F.col("lng").alias(f"{side}_lng")), f"{side}_zip", "left")
    return rows.select(
        "order_id", bought, promised, arrived.alias("label_available_timestamp"), F.year(bought).alias("purchase_year"), F.month(bought).alias("purchase_month"), (F.weekday(bought) + 1).alias("purchase_day_of_week"), F.hour(bought).alias("purchase_hour"),
        days.alias("promised_delivery_days"), F.coalesce(F.col("seller_state") == F.col("customer_state"), F.lit(False)).cast("int").alias("same_state"),
        C.haversine_km(F.col("seller_lat"), F.col("seller_lng"), F.col("customer_lat"), F.col("customer_lng")).alias("distance_km"), "item_count", "total_item_value", "total_freight_value", "total_weight_g", "total_volume_cm3",
        "payment_installments", "primary_seller_id", "seller_ids", "seller_item_values", "seller_count", "category_count", "seller_zip", "customer_zip", "seller_state", "customer_state",
        F.concat_ws(" → ", "seller_state", "customer_state").alias("route"), "primary_category", F.coalesce("primary_payment_type", F.lit("__missing__")).alias("primary_payment_type"),
        (arrived > promised + F.expr("interval 1 day")).cast("int").alias("late_1d"),
    )


def seller_shares(orders: DataFrame, *keep: str) -> DataFrame:
    """(order_id, seller_id, weight, kept columns) from the pipe-joined composition: value shares, or equal ones where no
    value is positive. An order is one row, so its own arrays hold all that a share needs."""
    pairs = F.arrays_zip(F.split("seller_ids", r"\|").alias("seller_id"), F.split("seller_item_values", r"\|").alias("value"))
    number = F.transform(pairs, lambda p: F.struct(p["seller_id"].alias("seller_id"), p["value"].try_cast("double").alias("value")))
    rows = orders.select("order_id", *keep, number.alias("__p"))
    rows = rows.withColumn("__total", F.aggregate("__p", F.lit(0.0), lambda x, p: x + F.coalesce(p["value"], F.lit(0.0))))
    rows = rows.select("order_id", *keep, "__total", F.size("__p").alias("__n"), F.inline("__p"))
    return rows.select("order_id", "seller_id", F.when(F.col("__total") > 0, F.col("value") / F.col("__total")).otherwise(1 / F.col("__n")).alias("weight"), *keep)


#: Checks whose failures do not stop a build: such measurements are imputed.
HARMLESS = ("negative_weight", "negative_volume")


def row_checks() -> dict[str, Column]:
    """What is wrong with a row of the order dataset, by name."""
    bought, known, promised = (F.col(c) for c in ("order_purchase_timestamp", "label_available_timestamp", "order_estimated_delivery_date"))
    ids, values = (F.split(F.coalesce(c, F.lit("")), r"\|") for c in ("seller_ids", "seller_item_values"))
    flag = lambda c: ~F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    below = {"negative_distance": "distance_km", "negative_item_value": "total_item_value", "negative_freight_value": "total_freight_value", "negative_weight": "total_weight_g", "negative_volume": "total_volume_cm3", "negative_installments": "payment_installments", "negative_category_count": "category_count"}
    not_above = {"non_positive_promised_days": "promised_delivery_days", "non_positive_item_count": "item_count", "non_positive_seller_count": "seller_count"}
    days = (F.unix_micros(promised) - F.unix_micros(bought)) / F.lit(86400e6)
    same = F.coalesce(F.col("seller_state") == F.col("customer_state"), F.lit(False)).cast("int")
    near = F.abs(F.col("promised_delivery_days") - days) <= 1e-8 + 1e-5 * F.abs(days)
    return (
        {"missing_order_id": F.col("order_id").isNull(), "invalid_target": flag("late_1d"), "invalid_timestamp": bought.isNull(), "invalid_label_available_timestamp": known.isNull(), "invalid_estimated_delivery_timestamp": promised.isNull(), "label_available_before_purchase": known < bought}
        | {k: F.col(c) < 0 for k, c in below.items()}
        | {k: F.col(c) <= 0 for k, c in not_above.items()}
        | {
            "seller_count_mismatch": differs("seller_count", F.size(ids)), "seller_value_count_mismatch": F.size(ids) != F.size(values), "primary_seller_missing_from_order": ~F.coalesce(F.array_contains(ids, F.col("primary_seller_id")), F.lit(False)),
            "invalid_same_state": flag("same_state"), "same_state_mismatch": differs("same_state", same), "route_mismatch": differs("route", F.concat(F.col("seller_state"), F.lit(" → "), F.col("customer_state"))),
            "purchase_year_mismatch": differs("purchase_year", F.year(bought)), "purchase_month_mismatch": differs("purchase_month", F.month(bought)), "purchase_day_of_week_mismatch": differs("purchase_day_of_week", F.weekday(bought) + 1), "purchase_hour_mismatch": differs("purchase_hour", F.hour(bought)),
            "promised_delivery_days_mismatch": ~F.coalesce(near, F.lit(False)),
        }
    )


def audit_orders(orders: DataFrame, position: str | None = None) -> DataFrame:
    """(check_name, errors, blocking) of every named check; position, if there is one, is the order that rows came in.

    Row checks are one aggregate; duplicates are counted per key.
    """
    checks = row_checks()
    sums = orders.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("errors")) for k in checks])))
    again = lambda keys, name: orders.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.lit(name).alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors"))
    own = [c for c in orders.columns if c != position]
    rows = rows.unionByName(again(["order_id"], "duplicate_order_id")).unionByName(again(own, "duplicate_rows"))
    if position:
        from millrace.operators.ranking import numbered

        # each row against its predecessor, which is one place before it
        placed = numbered(orders.select(position, F.col("order_purchase_timestamp").alias("ts")), position)
        late = placed.join(placed.select((F.col("position") + 1).alias("position"), F.col("ts").alias("before")), "position").filter("ts < before")
        rows = rows.unionByName(late.agg(F.lit("non_monotonic_timestamp").alias("check_name"), F.least(F.count(F.lit(1)), F.lit(1)).alias("errors")))
    return rows.withColumn("blocking", (F.col("errors") > 0) & ~F.col("check_name").isin(*HARMLESS))
