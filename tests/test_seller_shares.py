"""Sellers of an order: shares within the order's own row, and features made after the shuffle to the order."""

import math
from datetime import datetime

import pytest

from millrace.plans import features, orders


def test_shares_need_no_shuffle(spark):
    rows = [("a", "s1|s2", "80|20"), ("b", "s1", "0"), ("c", "s1|s2|s3", "x|30|10"), ("d", None, None), ("e", "s1|s2", "-1|0"), ("f", "s1|s2", "x|y")]
    found = orders.seller_shares(spark.createDataFrame(rows, "order_id string, seller_ids string, seller_item_values string").repartition(2))
    assert [tuple(r) for r in found.orderBy("order_id", "seller_id").collect()] == [
        ("a", "s1", 0.8), ("a", "s2", 0.2), ("b", "s1", 1.0), ("c", "s1", None), ("c", "s2", 0.75), ("c", "s3", 0.25), ("e", "s1", 0.5), ("e", "s2", 0.5), ("f", "s1", 0.5), ("f", "s2", 0.5),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("rows", [0, 200_000])
def test_orders_get_counts_and_make_features(spark, monkeypatch, rows):
    """With and without a broadcast of the histories."""
    monkeypatch.setattr(features, "HISTORY_ROWS", rows)
    day = lambda k: datetime(2020, 1, 1 + k)
    data = [(str(k), day(k % 9), day(k % 9 + 2), k % 2, "s1|s2" if k % 3 else "s2", "3|1" if k % 3 else "5", "s1" if k % 3 else "s2") for k in range(60)]
    df = spark.createDataFrame(data, "order_id string, order_purchase_timestamp timestamp, label_available_timestamp timestamp, late_1d int, seller_ids string, seller_item_values string, primary_seller_id string")
    found = features.seller_features(df)
    got = {r.order_id: r for r in found.collect()}
    assert len(got) == 60
    for k, bought, *_ in data:
        before = [x for x in data if x[1] < bought]
        known = [x for x in data if x[2] < bought]
        prior = sum(x[3] for x in known) / len(known) if known else features.DEFAULT_PRIOR
        own = [x for x in known if "s2" in x[4]]
        rate = (sum(x[3] for x in own) + 20 * prior) / (len(own) + 20)
        one = [x for x in known if "s1" in x[4]]
        other = (sum(x[3] for x in one) + 20 * prior) / (len(one) + 20)
        weighted = rate if int(k) % 3 == 0 else 0.75 * other + 0.25 * rate
        assert got[k].seller_prior_late_rate_weighted == pytest.approx(weighted)
        assert got[k].primary_seller_prior_order_count_log == pytest.approx(math.log1p(sum(("s1" if int(k) % 3 else "s2") in x[4] for x in before)))
