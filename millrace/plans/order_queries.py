"""Point-in-time features, ranking metrics and models over orders."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import history, metrics, models, ranking
from millrace.plans.registry import Tables, facts, query
from millrace.sources.shared import stage

_ORDER_LATE = """ol AS (SELECT o_orderkey, o_custkey, cast(o_orderdate AS DATE) AS day, cast(epoch(o_orderdate) / 86400 AS INTEGER) AS d, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus = 'F' AS late FROM orders)"""


def _orders(t: Tables) -> DataFrame:
    """Orders with their epoch day; status F stands for a late delivery."""
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", day.alias("day"), F.unix_date(day).alias("d"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("late"))


_HISTORY = "h AS (SELECT o_custkey, d AS day, count(*) AS n, count(*) FILTER (WHERE late) AS late FROM ol GROUP BY ALL)"


@query(f"WITH {_ORDER_LATE}, {_HISTORY} SELECT * FROM h")
def daily_history(t: Tables) -> DataFrame:
    return history.daily_history(_orders(t), ["o_custkey"], F.col("day"), F.col("late"))


_PRIOR = "PARTITION BY o_custkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"WITH {_ORDER_LATE}, {_HISTORY} SELECT o_custkey, day, cast(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, cast(coalesce(sum(late) OVER w, 0) AS BIGINT) AS prior_late, coalesce(day - min(day) OVER w, 0) AS experience_days FROM h WINDOW w AS ({_PRIOR})")
def prior_cumulative(t: Tables) -> DataFrame:
    h = history.daily_history(_orders(t), ["o_custkey"], F.col("day"), F.col("late"))
    return history.prior_history(h, ["o_custkey"], windows=())


@query(f"WITH {_ORDER_LATE}, {_HISTORY} SELECT o_custkey, day, " + ", ".join(f"cast(coalesce(sum(n) OVER w{k}, 0) AS BIGINT) AS n_{k}, cast(coalesce(sum(late) OVER w{k}, 0) AS BIGINT) AS late_{k}" for k in (7, 30, 90)) + " FROM h WINDOW " + ", ".join(f"w{k} AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (7, 30, 90)))
def trailing_windows(t: Tables) -> DataFrame:
    h = history.daily_history(_orders(t), ["o_custkey"], F.col("day"), F.col("late"))
    return history.prior_history(h, ["o_custkey"]).select("o_custkey", "day", *[f"{x}_{k}" for k in (7, 30, 90) for x in ("n", "late")])


@query(
    f"""WITH {_ORDER_LATE}, known AS (SELECT o_custkey, d + 10 AS day, late::INT AS late FROM ol), q AS (SELECT DISTINCT o_custkey, d AS day FROM ol)
    SELECT q.o_custkey, q.day, count(k.day) AS prior_n, cast(coalesce(sum(k.late), 0) AS BIGINT) AS prior_late FROM q LEFT JOIN known k ON q.o_custkey = k.o_custkey AND k.day < q.day GROUP BY ALL"""
)
def pit_prior_counts(t: Tables) -> DataFrame:
    """Outcomes known ten days after the order; each query day sees those strictly before it."""
    o = _orders(t)
    known = history.daily_history(o, ["o_custkey"], F.date_add("day", 10), F.col("late"))
    return history.prior_history(known, ["o_custkey"], o.select("o_custkey", F.col("d").alias("day")), ()).select("o_custkey", "day", "prior_n", "prior_late")


@query(f"WITH {_ORDER_LATE} SELECT d AS day, count(*) AS n, count(*) FILTER (WHERE late) AS late FROM ol GROUP BY 1")
def global_history(t: Tables) -> DataFrame:
    return history.daily_history(_orders(t), [], F.col("day"), F.col("late"))


@query(f"WITH {_ORDER_LATE}, {_HISTORY}, p AS (SELECT o_custkey, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(late) OVER w, 0) AS late FROM h WINDOW w AS ({_PRIOR})) SELECT o_custkey, day, round((late + 20 * 0.05) / (n + 20), 6) AS rate FROM p")
def smoothed_rate(t: Tables) -> DataFrame:
    p = prior_cumulative(t)
    return p.select("o_custkey", "day", F.round(C.smoothed_rate("prior_late", "prior_n"), 6).alias("rate"))


@query(f"WITH {_ORDER_LATE}, {_HISTORY}, p AS (SELECT o_custkey, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(day - min(day) OVER w, 0) AS x, coalesce(sum(n) OVER w30, 0) AS n30 FROM h WINDOW w AS ({_PRIOR}), w30 AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT o_custkey, day, round(ln(1 + least(greatest((n30 / 30.0 + 0.01) / (n / greatest(x, 30) + 0.01), 0), 20)), 6) AS ratio FROM p")
def workload_ratio(t: Tables) -> DataFrame:
    h = history.daily_history(_orders(t), ["o_custkey"], F.col("day"), F.col("late"))
    p = history.prior_history(h, ["o_custkey"], windows=(30,))
    return p.select("o_custkey", "day", F.round(C.workload_ratio("n_30", "prior_n", "experience_days"), 6).alias("ratio"))


_TOTALS = """it AS (SELECT l_orderkey, count(*) AS items, count(DISTINCT l_suppkey) AS sellers, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, cast(sum(cast(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1)"""


def order_totals_of(items: DataFrame) -> DataFrame:
    """Items are shuffled once, by order, and each as one row: two distinct counts in one aggregate would make three of it.
    The first item of each of an order's sellers counts as one."""
    rows = items.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag").repartition("l_orderkey")
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_returnflag")) == 1
    rows = rows.withColumn("seller", (first & F.col("l_suppkey").isNotNull()).cast("int"))
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.sum("seller").alias("sellers"), C.exact_sum("l_extendedprice").alias("value"), C.exact_sum("l_quantity").alias("quantity"), F.count_distinct("l_returnflag").alias("kinds"))


@query(f"WITH {_TOTALS} SELECT * FROM it")
def order_totals(t: Tables) -> DataFrame:
    return order_totals_of(t.lineitem)


@query("WITH s AS (SELECT l_orderkey, l_suppkey, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(cast(l_suppkey AS VARCHAR), '|' ORDER BY l_suppkey) AS sellers, string_agg(cast(cast(v AS DECIMAL(20,2)) AS VARCHAR), '|' ORDER BY l_suppkey) AS vals FROM s GROUP BY 1")
def order_composition(t: Tables) -> DataFrame:
    """Seller ids and their values, both in order of the id; an order has few sellers."""
    s = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(20,2)").alias("v"))
    parts = s.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "v"))).alias("p"))
    return parts.select("l_orderkey", F.array_join(F.transform("p", lambda x: x["l_suppkey"].cast("string")), "|").alias("sellers"), F.array_join(F.transform("p", lambda x: x["v"].cast("string")), "|").alias("vals"))


@query("SELECT l_suppkey, median(l_quantity) AS quantity, median(l_extendedprice) AS price FROM lineitem GROUP BY 1")
def group_median(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.median("l_quantity").alias("quantity"), F.median("l_extendedprice").alias("price"))


_ITEM_ORDER = "l_extendedprice DESC, l_tax DESC, l_linenumber, l_suppkey, l_partkey"


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM_ORDER}) = 1")
def primary_item(t: Tables) -> DataFrame:
    """An aggregate with a full tie-break; no sort of the order's items."""
    best = F.min_by(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"), F.struct((-F.col("l_extendedprice")).alias("a"), (-F.col("l_tax")).alias("b"), "l_linenumber", "l_suppkey", "l_partkey"))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("x")).select("l_orderkey", "x.*")


@query(f"WITH {_TOTALS} SELECT l_orderkey, items, value, (SELECT 1) AS one, p.l_suppkey AS primary_seller FROM it JOIN (SELECT l_orderkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM_ORDER}) = 1) p USING (l_orderkey)")
def primary_row_totals(t: Tables) -> DataFrame:
    return order_totals_of(t.lineitem).select("l_orderkey", "items", "value", F.lit(1).alias("one")).join(primary_item(t).select("l_orderkey", F.col("l_suppkey").alias("primary_seller")), "l_orderkey")


_MEMBERS = "m AS (SELECT l_orderkey, l_suppkey, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY ALL), mw AS (SELECT l_orderkey, l_suppkey, CASE WHEN sum(v) OVER w > 0 THEN cast(v AS DOUBLE) / cast(sum(v) OVER w AS DOUBLE) ELSE 1.0 / count(*) OVER w END AS weight FROM m WINDOW w AS (PARTITION BY l_orderkey))"


def memberships(items: DataFrame) -> DataFrame:
    """Each seller's share of an order's value, or equal shares where the value is not positive."""
    v = items.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))
    w = Window.partitionBy("l_orderkey")
    total = F.round(F.sum("v").over(w), 2)
    return v.select("l_orderkey", "l_suppkey", F.when(total > 0, F.col("v") / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(w)).alias("weight"))


@query(f"WITH {_MEMBERS} SELECT l_orderkey, l_suppkey, round(weight, 6) AS weight FROM mw")
def membership_weights(t: Tables) -> DataFrame:
    return memberships(t.lineitem).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_MEMBERS}, s AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS rate, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, round(sum(weight * rate), 6) AS mean_rate, round(max(rate), 6) AS max_rate, round(min(rate), 6) AS min_rate, round(ln(1 + sum(n)), 6) AS log_n FROM mw JOIN s USING (l_suppkey) GROUP BY 1")
def weighted_rollup(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("rate"), F.count(F.lit(1)).alias("n"))
    m = memberships(t.lineitem).join(s, "l_suppkey")
    return m.groupBy("l_orderkey").agg(F.round(F.sum(F.col("weight") * F.col("rate")), 6).alias("mean_rate"), F.round(F.max("rate"), 6).alias("max_rate"), F.round(F.min("rate"), 6).alias("min_rate"), F.round(F.log1p(F.sum("n")), 6).alias("log_n"))


@query(
    f"""WITH {_ORDER_LATE}, {_TOTALS}, {_HISTORY}, p AS (SELECT o_custkey, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(late) OVER w, 0) AS late FROM h WINDOW w AS ({_PRIOR}))
    SELECT o_orderkey, cast(year(ol.day) AS INTEGER) AS year, cast(month(ol.day) AS INTEGER) AS month, cast(isodow(ol.day) AS INTEGER) AS weekday_number, items, sellers, value, coalesce(sellers > 1, false) AS multi_seller, round(ln(1 + p.n), 6) AS log_prior,
    round((p.late + 1.0) / (p.n + 20), 6) AS prior_rate, cast(ol.late AS INTEGER) AS label FROM ol LEFT JOIN it ON o_orderkey = l_orderkey JOIN p ON p.o_custkey = ol.o_custkey AND p.day = ol.d"""
)
def pit_feature_table(t: Tables) -> DataFrame:
    return _pit_rows(t).select(*_PIT, F.col("late").cast("int").alias("label"))


_PIT = ["o_orderkey", "year", "month", "weekday_number", "items", "sellers", "value", "multi_seller", "log_prior", "prior_rate"]


def _pit_rows(t: Tables) -> DataFrame:
    """The orders (as _orders has them) with the columns _PIT."""
    o = _orders(t)
    p = history.prior_history(history.daily_history(o, ["o_custkey"], F.col("day"), F.col("late")), ["o_custkey"], windows=()).withColumnRenamed("day", "d")
    rows = o.join(order_totals_of(t.lineitem).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").join(p, ["o_custkey", "d"])
    return rows.withColumns({
        "year": F.year("day"), "month": F.month("day"), "weekday_number": F.weekday("day") + 1, "multi_seller": F.coalesce(F.col("sellers") > 1, F.lit(False)),
        "log_prior": F.round(F.log1p("prior_n"), 6), "prior_rate": F.round(C.smoothed_rate("prior_late", "prior_n"), 6),
    })


_SCORED = "sc AS (SELECT o_orderkey, floor(o_totalprice / 1000) AS score, o_orderstatus = 'F' AS y FROM orders)"


def _scored(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"), (F.col("o_orderstatus") == "F").alias("y"))


@query(f"WITH {_SCORED} SELECT o_orderkey, score, y, round((row_number() OVER (ORDER BY score, o_orderkey) - 1) / greatest(count(*) OVER () - 1, 1), 9) AS rank_fraction FROM sc")
def rank_fraction(t: Tables) -> DataFrame:
    return ranking.rank_fraction(_scored(t), "score", "o_orderkey").withColumn("rank_fraction", F.round("rank_fraction", 9))


@query(
    f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) - 1 AS pos, count(*) OVER () AS n, cast(sum(y::INT) OVER () AS BIGINT) AS positives FROM sc)
    SELECT fraction, n, positives, count(*) AS taken, cast(sum(y::INT) AS BIGINT) AS found, cast(count(*) - sum(y::INT) AS BIGINT) AS false_warnings, round(sum(y::INT) / count(*), 6) AS precision, round(sum(y::INT) / positives, 6) AS recall
    FROM r, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS fraction) WHERE pos < ceil(n * fraction) GROUP BY fraction, n, positives"""
)
def top_fraction_capture(t: Tables) -> DataFrame:
    return ranking.top_capture(_scored(t), "score", "y", "o_orderkey", [0.05, 0.1, 0.2])


_AP = f"""WITH {_SCORED}, per AS (SELECT score, sum(y::INT) AS tp, sum(1 - y::INT) AS fp FROM sc GROUP BY 1), c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM per WINDOW w AS (ORDER BY score DESC)), tot AS (SELECT sum(tp) AS p, sum(fp) AS n FROM per),
    m AS (SELECT p, n, sum(tp / p * (ct / (ct + cf))) AS ap, sum(tp * (n - cf) + tp * fp / 2) / (p * n) AS auc FROM c, tot GROUP BY p, n)
    SELECT cast(p AS BIGINT) AS positives, cast(n AS BIGINT) AS negatives, round(ap, 6) AS average_precision, round(ap / (p / (p + n)), 6) AS lift, round(auc, 6) AS roc_auc FROM m"""


@query(_AP)
def average_precision(t: Tables) -> DataFrame:
    return ranking.ranking_metrics(_scored(t), "score", "y")


@query(_AP)
def roc_auc(t: Tables) -> DataFrame:
    return ranking.ranking_metrics(_scored(t), "score", "y")


_SPLIT = "sp AS (SELECT o_orderkey, o_orderdate, o_orderstatus = 'F' AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), spl AS (SELECT *, CASE WHEN pos < floor(n * 0.70) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM sp)"


def cut_rows(df: DataFrame, ts: str, tie: str, cuts: tuple[float, ...] = (0.70, 0.85)) -> DataFrame:
    """One row: for each cut the (ts, tie) at place int(n * cut) of df in order of both, null where no row is there.

    Days and their numbers tell on which day a cut falls; only that day's rows are put in order.
    """
    day = F.to_date(ts)
    days = [(r["day"], r["n"]) for r in df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()]  # a row for each day
    total, out = sum(n for _, n in days), df.sparkSession.range(1).select()
    for k, cut in enumerate(cuts):
        at, before = math.floor(total * cut), 0
        found = None
        for d, n in days:
            if before <= at < before + n:
                own = ranking.numbered(df.filter(day.eqNullSafe(F.lit(d).cast("date"))).select(ts, tie), ts, tie)
                found = own.filter(F.col("position") == at - before).select(F.struct(F.col(ts).alias("a"), F.col(tie).alias("b")).alias(f"__cut{k}"))
            before += n
        out = out.crossJoin(found) if found is not None else out.withColumn(f"__cut{k}", F.lit(None))
    return stage(out, "cuts")


def chronological(df: DataFrame, ts: str, tie: str, cuts: tuple[float, ...] = (0.70, 0.85), names: tuple[str, ...] = ("train", "validation", "test"), among: DataFrame | None = None) -> DataFrame:
    """Splits at int(n * cut) rows in order of (ts, tie), of df itself or of the rows `among`, by comparison with the rows there."""
    place, split = F.struct(F.col(ts).alias("a"), F.col(tie).alias("b")), F.lit(names[-1])
    for k, name in reversed(list(enumerate(names[:-1]))):
        split = F.when(F.col(f"__cut{k}").isNull() | (place < F.col(f"__cut{k}")), name).otherwise(split)
    rows = df.crossJoin(F.broadcast(cut_rows(df if among is None else among, ts, tie, cuts)))  # one row
    return rows.withColumn("split", split).drop(*[f"__cut{k}" for k in range(len(cuts))])


@query(f"WITH {_SPLIT} SELECT o_orderkey, split FROM spl")
def chrono_split(t: Tables) -> DataFrame:
    return chronological(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n, count(*) FILTER (WHERE y) AS positives, round(count(*) FILTER (WHERE y) / count(*), 6) AS rate, cast(min(o_orderdate) AS DATE) AS first_day, cast(max(o_orderdate) AS DATE) AS last_day FROM spl GROUP BY 1")
def split_summary(t: Tables) -> DataFrame:
    rows = chronological(t.orders.select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("y")), "o_orderdate", "o_orderkey")
    out = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("positives"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return out.withColumn("rate", C.safe_rate("positives", "n"))


_FOLDS = [("f1", "1998-01-01", "1999-01-01"), ("f2", "1999-01-01", "2000-01-01"), ("f3", "2000-01-01", "2001-01-01"), ("f4", "2001-01-01", "2002-01-01")]
_FOLD_SQL = "(VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in _FOLDS) + ") f(fold, start, stop)"


@query(f"SELECT fold, CASE WHEN o_orderdate < start THEN 'train' ELSE 'validate' END AS part, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS positives FROM orders, {_FOLD_SQL} WHERE o_orderdate < stop GROUP BY ALL")
def expanding_folds(t: Tables) -> DataFrame:
    """Counts per day first; then four folds of days."""
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("p"))
    folds = F.broadcast(t.spark.createDataFrame(_FOLDS, "fold string, start string, stop string").select("fold", F.to_date("start").alias("start"), F.to_date("stop").alias("stop")))
    rows = per_day.join(folds, F.col("day") < F.col("stop"))
    return rows.groupBy("fold", F.when(F.col("day") < F.col("start"), "train").otherwise("validate").alias("part")).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"))


@query(
    f"""WITH {_SCORED}, g AS (SELECT cast(o_orderkey % 5 AS INTEGER) AS candidate, cast(o_orderkey % 4 AS INTEGER) AS fold, avg(y::INT) AS m FROM sc GROUP BY ALL), s AS (SELECT candidate, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS spread, round(avg(m) - stddev_pop(m), 6) AS stability FROM g GROUP BY 1)
    SELECT *, cast(row_number() OVER (ORDER BY stability DESC, mean DESC, candidate) AS INTEGER) AS place FROM s"""
)
def stability_select(t: Tables) -> DataFrame:
    g = _scored(t).groupBy((F.col("o_orderkey") % 5).cast("int").alias("candidate"), (F.col("o_orderkey") % 4).cast("int").alias("fold")).agg(F.avg(F.col("y").cast("int")).alias("m"))
    s = g.groupBy("candidate").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("spread"), F.round(F.avg("m") - F.stddev_pop("m"), 6).alias("stability"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("stability"), F.desc("mean"), "candidate")))  # one row per candidate


_P = "pr AS (SELECT o_orderkey, 1 / (1 + exp(-(o_totalprice - 250000) / 100000)) AS p, cast(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"


def _probabilities(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C.sigmoid((F.col("o_totalprice") - 250000) / 100000).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query(f"WITH {_P}, e AS (SELECT list_distinct(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges FROM pr), b AS (SELECT cast(len(list_filter(edges, lambda x: x < p)) AS INTEGER) AS bin, p, y FROM pr, e) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(abs(round(avg(p), 6) - round(avg(y), 6)), 6) AS gap FROM b GROUP BY 1")
def calibration_bins(t: Tables) -> DataFrame:
    return metrics.calibration_bins(_probabilities(t), "p", "y")


@query(f"WITH {_P} SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(greatest(1 - p, 1e-15)))), 6) AS log_loss FROM pr")
def brier_logloss(t: Tables) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    loss = -(y * F.ln(F.greatest(p, F.lit(1e-15))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(1e-15))))
    return _probabilities(t).agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))


_XS, _YS = [0.0, 0.2, 0.5, 0.8, 1.0], [0.02, 0.1, 0.3, 0.55, 0.9]
_PIECES = "CASE WHEN p <= 0 THEN 0.02 " + " ".join(f"WHEN p <= {b} THEN {c} + (p - {a}) * ({d} - {c}) / ({b} - {a})" for a, b, c, d in zip(_XS, _XS[1:], _YS, _YS[1:], strict=False)) + " ELSE 0.9 END"


@query(f"WITH {_P} SELECT o_orderkey, round({_PIECES}, 6) AS isotonic, round(1 / (1 + exp(-(1.5 * ln(p / (1 - p)) - 0.3))), 6) AS platt FROM pr")
def calibrate_scores(t: Tables) -> DataFrame:
    p = F.col("p")
    return _probabilities(t).select("o_orderkey", F.round(C.interpolate("p", _XS, _YS), 6).alias("isotonic"), F.round(C.sigmoid(1.5 * F.ln(p / (1 - p)) - 0.3), 6).alias("platt"))


@query(f"WITH {_P}, s AS (SELECT o_orderkey, {_PIECES} * 100 AS score FROM pr) SELECT o_orderkey, round(score, 4) AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM s")
def risk_level(t: Tables) -> DataFrame:
    s = _probabilities(t).select("o_orderkey", (C.interpolate("p", _XS, _YS) * 100).alias("score"))
    return s.select("o_orderkey", F.round("score", 4).alias("score"), F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("low").alias("level"))


@query("SELECT o_orderkey, cast(date_diff('day', o_orderdate, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 30)) + 1 AS INTEGER) AS days, cast(len(list_filter(range(0, o_orderkey % 30 + 1), lambda k: isodow(cast(o_orderdate AS DATE) + cast(k AS INTEGER)) < 6)) AS INTEGER) AS business FROM orders")
def business_days(t: Tables) -> DataFrame:
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 30).cast("int"))
    return t.orders.select("o_orderkey", (F.datediff(end, start) + 1).alias("days"), C.business_days(start, end).alias("business"))


_PROFILE = "SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd, median(o_totalprice) AS med FROM orders"


@query(f"WITH s AS ({_PROFILE}), c AS (SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1) SELECT category, n, n >= 5 AS kept, round(mean, 2) AS mean, round(sd, 2) AS sd, round(med, 2) AS med FROM c, s")
def fit_preprocess(t: Tables) -> DataFrame:
    """Statistics of a numeric column and the categories that are frequent enough for a slot of their own."""
    s = F.broadcast(t.orders.agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 2).alias("sd")))
    s = s.crossJoin(F.broadcast(ranking.quantiles(t.orders, "o_totalprice", [0.5]).select(F.round(F.col("q")[0], 2).alias("med"))))
    c = t.orders.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("kept", F.col("n") >= 5).crossJoin(s)


_WEIGHTS = {"1-URGENT": 0.8, "2-HIGH": 0.4, "3-MEDIUM": 0.1, "4-NOT SPECIFIED": -0.1, "5-LOW": -0.4}
_LINEAR = "-0.5 + 0.3 * (o_totalprice - 250000) / 140000 + CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items()) + " ELSE 0 END"


def linear_logit(price: Column, priority: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in _WEIGHTS.items() for x in kv])
    return F.lit(-0.5) + 0.3 * (price - 250000) / 140000 + F.coalesce(F.try_element_at(weights, priority), F.lit(0.0))


@query(f"SELECT o_orderkey, round(1 / (1 + exp(-({_LINEAR}))), 6) AS p FROM orders")
def linear_score(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(C.sigmoid(linear_logit(F.col("o_totalprice"), F.col("o_orderpriority"))), 6).alias("p"))


@query(
    f"""WITH b AS (SELECT o_orderkey, 1 / (1 + exp(-({_LINEAR}))) AS p, 1 / (1 + exp(-({_LINEAR.replace("o_totalprice - 250000", "0")}))) AS p_price, 1 / (1 + exp(-(-0.5 + 0.3 * (o_totalprice - 250000) / 140000))) AS p_priority FROM orders),
    c AS (SELECT o_orderkey, 'price' AS factor, round(100 * (p - p_price), 4) AS change FROM b UNION ALL SELECT o_orderkey, 'priority', round(100 * (p - p_priority), 4) FROM b)
    SELECT o_orderkey, factor, change FROM c QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(change) DESC, factor) = 1"""
)
def sensitivity_top3(t: Tables) -> DataFrame:
    """The factor whose reset to its reference value changes the score most, from one row's own array."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    p = C.sigmoid(linear_logit(price, priority))
    effects = {"price": C.sigmoid(linear_logit(F.lit(250000.0), priority)), "priority": C.sigmoid(linear_logit(price, F.lit("none")))}
    changes = F.array(*[F.struct((-F.abs(F.round(100 * (p - q), 4))).alias("size"), F.lit(k).alias("factor"), F.round(100 * (p - q), 4).alias("change")) for k, q in effects.items()])
    return t.orders.select("o_orderkey", F.slice(F.array_sort(changes), 1, 1)[0].alias("x")).select("o_orderkey", "x.factor", "x.change")


@query(
    """WITH b AS (SELECT rep, o_orderkey, o_orderstatus = 'F' AS y, (('0x' || substr(md5(cast(o_orderkey AS VARCHAR) || ':' || cast(rep AS VARCHAR)), 1, 7))::BIGINT / 268435456.0) AS u FROM orders, (SELECT unnest(range(0, 20)) AS rep)),
    w AS (SELECT rep, y, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 ELSE 4 END AS k FROM b) SELECT cast(rep AS BIGINT) AS rep, cast(sum(k) AS BIGINT) AS n, round(sum(k * y::INT) / sum(k), 6) AS rate FROM w GROUP BY 1"""
)
def poisson_bootstrap(t: Tables) -> DataFrame:
    """Weights drawn from a hash of row and replicate: any task can make them again. Replicates are columns of one row, not copies of rows."""

    def weight(rep: int) -> Column:
        return ranking.poisson_weight(F.col("o_orderkey"), F.lit(rep))

    y = (F.col("o_orderstatus") == "F").cast("int")
    sums = t.orders.agg(*[x for r in range(20) for x in (F.sum(weight(r)).alias(f"n{r}"), F.sum(weight(r) * y).alias(f"y{r}"))])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("rep"), F.col(f"n{r}").alias("n"), F.round(F.col(f"y{r}") / F.col(f"n{r}"), 6).alias("rate")) for r in range(20)])).alias("x"))
    return long.select("x.*")


def _weighted_auc(score: str) -> str:
    """SQL of (rep, p, q, won) for one score."""
    inner = f"SELECT rep, {score} AS s, sum(k * y) AS tp, sum(k * (1 - y)) AS fp FROM w GROUP BY 1, 2"
    return f"SELECT rep, sum(tp) AS p, sum(fp) AS q, sum(tp * below + tp * fp / 2) AS won FROM (SELECT *, coalesce(sum(fp) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({inner})) GROUP BY 1"


@query(
    f"""WITH b AS (SELECT rep, o_orderkey, floor(o_totalprice / 1000) AS price, floor(o_totalprice / 1000) % 37 AS other, (o_orderstatus = 'F')::INT AS y, (('0x' || substr(md5(cast(o_orderkey AS VARCHAR) || ':' || cast(rep AS VARCHAR)), 1, 7))::BIGINT / 268435456.0) AS u FROM orders, (SELECT unnest(range(0, 250)) AS rep)),
    w AS (SELECT rep, price, other, y, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 ELSE 4 END AS k FROM b WHERE u >= 0.36787944), sa AS ({_weighted_auc("price")}), sb AS ({_weighted_auc("other")})
    SELECT cast(rep AS INTEGER) AS rep, cast(sa.p + sa.q AS BIGINT) AS n, round(sa.won / (sa.p * sa.q), 6) AS auc_a, round(sb.won / (sb.p * sb.q), 6) AS auc_b, round(sa.won / (sa.p * sa.q) - sb.won / (sb.p * sb.q), 6) AS difference FROM sa JOIN sb USING (rep)"""
)
def bootstrap_pairs(t: Tables) -> DataFrame:
    """ROC-AUC of two scores and their difference over 250 resamples of all orders."""
    price = F.floor(F.col("o_totalprice") / 1000)
    rows = t.orders.select("o_orderkey", price.alias("a"), (price % 37).alias("b"), (F.col("o_orderstatus") == "F").alias("y"))
    return ranking.bootstrap_pairs(rows, "a", "b", "y", "o_orderkey")


_NUMERIC = ["month", "weekday_number", "items", "sellers", "value", "log_prior", "prior_rate"]


def _labelled(t: Tables) -> DataFrame:
    """Order features with a label that the order's priority and value decide in part, its day and priority."""
    rows = _pit_rows(t).select(*_PIT, "o_orderdate", "day", "priority", F.col("price").alias("o_totalprice"))
    noise = F.pmod(F.xxhash64("o_orderkey"), F.lit(1000)) / 1000
    return rows.withColumn("label", (C.sigmoid(linear_logit(F.col("o_totalprice"), F.col("priority")) * 3) > noise).cast("double"))


def _with_split(t: Tables) -> DataFrame:
    """The labelled orders with their part of chrono_split."""
    return chronological(stage(_labelled(t), "labelled"), "o_orderdate", "o_orderkey", among=t.orders.select("o_orderdate", "o_orderkey"))


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = _with_split(t)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    prep = models.fit_preprocess(train, [*_NUMERIC, "o_totalprice"], ["priority"])
    rate = train.agg(F.avg("label")).first()[0] or 0.0
    weight = F.when(F.col("label") == 1, 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6))
    return prep.apply(train).withColumn("weight", weight), prep.apply(test)


@query()
def logistic_model(t: Tables) -> DataFrame:
    """A class-weighted logistic baseline on the training split, scored on the test split."""
    train, test = _split(t)
    model = models.fit(models.Candidate("baseline", "logistic", {"weightCol": "weight", "regParam": 0.01, "elasticNetParam": 0.5}), train)
    return models.score(model, test).select("o_orderkey", "label", F.round("p", 6).alias("p"))


@query()
def boosted_model(t: Tables) -> DataFrame:
    """Boosted trees as the challenger of the baseline."""
    train, test = _split(t)
    model = models.fit(models.Candidate("challenger", "boosted", {"maxIter": 5, "maxDepth": 3}), train)
    return models.score(model, test).select("o_orderkey", "label", F.round("p", 6).alias("p"))


def _model_folds(t: Tables, n: int = 2) -> list[models.Fold]:
    """Expanding folds over the later part of the orders' days; the last 15 % stay unseen."""
    first, last = t.orders.agg(F.unix_date(F.min(F.to_date("o_orderdate"))), F.unix_date(F.max(F.to_date("o_orderdate")))).first()
    at = [first + int((last - first) * (0.5 + 0.35 * k / n)) for k in range(n + 1)]
    days = [str(date(1970, 1, 1) + timedelta(days=d)) for d in at]
    return [(f"fold-{k + 1}", days[k], days[k + 1]) for k in range(n)]


_CANDIDATES = [models.Candidate("logistic-0.001", "logistic", {"regParam": 0.001}), models.Candidate("logistic-0.1", "logistic", {"regParam": 0.1}), models.Candidate("logistic-l1", "logistic", {"regParam": 0.01, "elasticNetParam": 1.0}), models.Candidate("boosted", "boosted", {"maxIter": 5, "maxDepth": 3})]


@query()
def model_search(t: Tables) -> DataFrame:
    """Candidates over expanding folds; the most stable one is locked before the last rows are looked at."""
    found, lock = models.search(stage(_labelled(t), "labelled"), "day", "o_orderkey", _model_folds(t), [*_NUMERIC, "o_totalprice"], ["priority"], _CANDIDATES)
    rows = [(r["name"], r["family"], *[round(r[k], 6) for k in ("top_recall", "stability", "average_precision", "lift", "roc_auc")], r["name"] == lock["selected"]) for r in found]
    return t.spark.createDataFrame(rows, "candidate string, family string, top_recall double, stability double, average_precision double, lift double, roc_auc double, selected boolean")


@query()
def feature_ablation(t: Tables) -> DataFrame:
    """The baseline with one group of features after the other."""
    groups = {"calendar": (["month", "weekday_number"], []), "order": (["items", "sellers", "value", "o_totalprice"], []), "service": ([], ["priority"]), "history": (["log_prior", "prior_rate"], [])}
    found = models.ablation(stage(_labelled(t), "labelled"), "day", "o_orderkey", _model_folds(t), groups, _CANDIDATES[0])
    rows = [(r["stage"], r["features"], *[round(r[k], 6) for k in ("top_recall", "stability", "average_precision", "roc_auc")]) for r in found]
    return t.spark.createDataFrame(rows, "stage string, features int, top_recall double, stability double, average_precision double, roc_auc double")


@query()
def calibration_choice(t: Tables) -> DataFrame:
    """Methods fitted on the first 60 % of orders by day and compared on the rest, for scores that are twice too extreme."""
    rows = _labelled(t).select("day", "o_orderkey", (linear_logit(F.col("o_totalprice"), F.col("priority")) * 6).alias("score"), "label")
    parameters, found = models.choose_calibration(rows, ["day", "o_orderkey"])
    return t.spark.createDataFrame([(r["method"], round(r["brier"], 6), round(r["log_loss"], 6), r["method"] == parameters["type"]) for r in found], "method string, brier double, log_loss double, selected boolean")


@query()
def factor_sensitivity(t: Tables) -> DataFrame:
    """The three groups of factors that move each test row's probability most from that of the reference row."""
    rows = _with_split(t)
    train = rows.filter("split = 'train'")
    prep = models.fit_preprocess(train, [*_NUMERIC, "o_totalprice"], ["priority"])
    model = models.fit(_CANDIDATES[0], prep.apply(train))
    groups = {"calendar": ["month", "weekday_number"], "size": ["items", "sellers", "value", "o_totalprice"], "service": ["priority"], "history": ["log_prior", "prior_rate"]}
    top = models.sensitivity(prep, list(model.coefficients.toArray()), float(model.intercept), groups)
    return rows.filter("split = 'test'").select("o_orderkey", F.posexplode(top).alias("place", "x")).select("o_orderkey", "place", "x.factor", "x.change")


@query("WITH {facts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * power(sin(radians(d - c) / 2), 2)))), 3) AS km FROM (SELECT *, l_suppkey % 60 - 30 AS a, o_custkey % 60 - 30 AS b, l_suppkey % 40 - 60 AS c, o_custkey % 40 - 60 AS d FROM facts)")
def haversine(t: Tables) -> DataFrame:
    """Coordinates that keys stand for."""
    place = lambda key, n, low: (F.col(key) % n + low).cast("double")
    km = C.haversine_km(place("l_suppkey", 60, -30), place("l_suppkey", 40, -60), place("o_custkey", 60, -30), place("o_custkey", 40, -60))
    return facts(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(km, 3).alias("km"))


_QUANTILES = "[" + ", ".join(str(k / 100) for k in range(101)) + "]"


@query(f"WITH {_P}, q AS (SELECT quantile_cont(p, {_QUANTILES}) AS q FROM pr), k AS (SELECT o_orderkey, p, q, len(list_filter(q, lambda x: x < p)) AS k FROM pr, q) SELECT o_orderkey, round(CASE WHEN k = 0 THEN 0 ELSE k - 1 + (p - q[k]) / (q[k + 1] - q[k]) END, 3) AS score FROM k")
def risk_score(t: Tables) -> DataFrame:
    """Place among 101 quantiles of the reference scores, linear inside a step. The quantiles are one row."""
    rows = _probabilities(t)
    q = F.broadcast(ranking.quantiles(rows, "p", [k / 100 for k in range(101)]))
    k = F.size(F.filter("q", lambda x: x < F.col("p")))
    low, high = F.get("q", k - 1), F.get("q", k)
    return rows.crossJoin(q).select("o_orderkey", F.round(F.when(k == 0, 0.0).otherwise(k - 1 + (F.col("p") - low) / (high - low)), 3).alias("score"))


@query(f"WITH {_TOTALS}, pi AS (SELECT l_orderkey, l_suppkey AS primary_seller FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM_ORDER}) = 1) SELECT o_orderkey, items, sellers, value, quantity, primary_seller, s_nationkey = c_nationkey AS same_nation, c_mktsegment, cast(month(o_orderdate) AS INTEGER) AS month, cast(o_orderstatus = 'F' AS INTEGER) AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN it ON o_orderkey = it.l_orderkey JOIN pi ON o_orderkey = pi.l_orderkey JOIN supplier ON primary_seller = s_suppkey WHERE o_totalprice > 0")
def order_dataset(t: Tables) -> DataFrame:
    """One row per order: totals, primary seller, whether both sides share a nation, label. Lines are aggregated before the joins."""
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    rows = t.orders.filter("o_totalprice > 0").join(customers, "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    rows = rows.join(order_totals_of(t.lineitem), "l_orderkey").join(primary_item(t).select("l_orderkey", F.col("l_suppkey").alias("primary_seller")), "l_orderkey")
    rows = rows.join(t.supplier.select(F.col("s_suppkey").alias("primary_seller"), "s_nationkey"), "primary_seller")
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "items", "sellers", "value", "quantity", "primary_seller", (F.col("s_nationkey") == F.col("c_nationkey")).alias("same_nation"), "c_mktsegment", F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
