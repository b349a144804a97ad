"""Scans, sinks, joins, sets, scalars and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import asof, eforms
from millrace.operators import tables as T
from millrace.operators import tenders
from millrace.plans.registry import Tables, facts, query
from millrace.sources import sinks
from millrace.sources.shared import new_path


@query("SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scan_nested_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dim_scan(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").dropDuplicates(["n_nationkey"])


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT cast(ts AS DATE) AS day, " + ", ".join(f"max_by(value, (ts, event_id)) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY 1")
def pivot_long_to_wide(t: Tables) -> DataFrame:
    """The last value wins per day and kind; the kinds are known, so no pass finds them."""
    return t.events.groupBy(F.to_date("ts").alias("day")).pivot("event_type", _KINDS).agg(F.max_by("value", F.struct("ts", "event_id")))


@query("SELECT 'orders' AS name, count(*) AS n, cast(sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)), 1, 8))::BIGINT) AS BIGINT) AS fingerprint FROM orders UNION ALL SELECT 'customer', count(*), cast(sum(('0x' || substr(md5(concat_ws('|', c_custkey, c_name, c_nationkey)), 1, 8))::BIGINT) AS BIGINT) FROM customer")
def source_fingerprint(t: Tables) -> DataFrame:
    """Row count and an order-free hash of canonical row strings."""
    one = lambda df, name, *c: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *c)), 1, 8), 16, 10).cast("long")).alias("fingerprint"))
    return one(t.orders, "orders", "o_orderkey", "o_custkey", "o_orderstatus").union(one(t.customer, "customer", "c_custkey", "c_name", "c_nationkey"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-05-01'")
def date_pruned_scan(t: Tables) -> DataFrame:
    days = (F.col("o_orderdate") >= F.lit("1996-02-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-05-01").cast("timestamp_ntz"))
    return t.orders.filter(days).select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate AS DATE) AS day FROM orders")
def typed_load_orders(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    T.check_columns(rows, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "day": "date"})
    return rows


@query("SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') AS year FROM orders")
def sink_roundtrip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "orders")
    sinks.append(t.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year")), path, ["year"])
    return t.spark.read.schema("o_orderkey long, o_totalprice double, year string").parquet(path)


@query("SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y') = '1997' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, strftime(o_orderdate, '%Y') AS year FROM orders WHERE strftime(o_orderdate, '%Y') <> '1998'")
def replace_partitions(t: Tables) -> DataFrame:
    """1997 is rewritten; 1998 is asked for without rows, so it goes; the others stay."""
    path = new_path(t.spark, "by-year")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"))
    sinks.append(rows, path, ["year"])
    sinks.replace_partitions(rows.filter("year = '1997'").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2)), path, "year", ["1997", "1998"])
    return t.spark.read.schema("o_orderkey long, o_totalprice double, year string").parquet(path)


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def upsert_latest(t: Tables) -> DataFrame:
    """The first half of the month is the target, the second the source; the newest row of a user wins."""
    rows = t.events.select("user_id", "event_id", "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    target = T.latest_per_key(rows.filter(F.col("ts") < cut), ["user_id"], ["ts", "event_id"])
    source = T.latest_per_key(rows.filter(F.col("ts") >= cut), ["user_id"], ["ts", "event_id"])
    return sinks.upsert(target, source, ["user_id"])


@query("SELECT sha256(coalesce(text, '')) AS content_sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def content_addressed_docs(t: Tables) -> DataFrame:
    return t.documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), "doc_id").groupBy("content_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def explode_children(t: Tables) -> DataFrame:
    """Orders with an array of lines, taken apart into the child table again."""
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("lines"))
    return nested.select("l_orderkey", F.inline("lines"))


@query("SELECT cast(o_orderdate AS DATE) AS partition_date, count(*) AS observed, CASE WHEN count(*) >= 3 THEN 'PASS' ELSE 'WARN' END AS status FROM orders GROUP BY 1")
def audit_rows(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.to_date("o_orderdate").alias("partition_date")).agg(F.count(F.lit(1)).alias("observed"))
    path = new_path(t.spark, "audit")
    sinks.append(rows.withColumn("status", F.when(F.col("observed") >= 3, "PASS").otherwise("WARN")), path)
    return t.spark.read.schema("partition_date date, observed long, status string").parquet(path)


@query("SELECT event_id FROM events WHERE try_cast(json_extract(props, '$.k') AS BIGINT) IS NULL UNION ALL SELECT -count(*) FROM events WHERE json_valid(props)")
def corrupt_json_count(t: Tables) -> DataFrame:
    parsed = t.events.select("event_id", F.from_json("props", "k bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    return parsed.filter("p.k is null").select("event_id").union(parsed.agg((-F.count_if(F.expr("p._bad is null"))).cast("long")))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(html) AS n_chars, length(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) AS n_text FROM pages")
def html_enrich_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.length("html").cast("long").alias("n_chars"), F.length(F.regexp_replace("html", r"(?s)<[^>]*>", "")).cast("long").alias("n_text"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND coalesce(CASE WHEN l_linestatus = 'F' THEN true WHEN l_quantity > 25 THEN false END, true)")
def tri_state_filter(t: Tables) -> DataFrame:
    stopping = F.when(F.col("l_linestatus") == "F", True).when(F.col("l_quantity") > 25, False)
    return t.lineitem.filter(C.commercial_stop(F.col("l_returnflag") == "A", stopping, strict=False)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND s_acctbal > 0")
def dim_scope_filter(t: Tables) -> DataFrame:
    scope = F.broadcast(dim_scan(t).filter(F.col("r_name").isin("ASIA", "EUROPE")))
    return t.supplier.filter("s_acctbal > 0").join(scope, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, l_quantity FROM lineitem")
def business_key(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), "l_quantity")


@query("SELECT p_partkey, regexp_replace(p_name, '(?i) ring$', '') AS label FROM part")
def suffix_strip(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace("p_name", "(?i) ring$", "").alias("label"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_shipdate >= DATE '1998-01-01'")
def exists_filter(t: Tables) -> DataFrame:
    """One line must meet all three conditions together."""
    lots = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", F.to_date("l_shipdate").alias("d"))).alias("lots"))
    return lots.filter(F.exists("lots", lambda x: (x["l_quantity"] >= 10) & (x["l_quantity"] <= 20) & (x["d"] >= F.lit("1998-01-01").cast("date")))).select("l_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' AND p_brand LIKE 'Brand#1%' AND p_type IN ('ECONOMY', 'PROMO') ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def catalog_search(t: Tables) -> DataFrame:
    return T.catalog(t.part, {"p_name": "RING"}, {"p_brand": "Brand#1"}, {"p_type": ["ECONOMY", "PROMO"]}).orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey", "p_name")


@query("WITH {facts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM facts WHERE service <> '5-LOW' AND delay >= 0 AND (delay IS NULL OR ship_day < DATE '2000-01-01')")
def null_asymmetric_filter(t: Tables) -> DataFrame:
    """A missing minimum fails, a missing deadline would pass."""
    keep = (F.col("service") != "5-LOW") & (F.col("delay") >= 0) & (F.col("delay").isNull() | (F.col("ship_day") < F.lit("2000-01-01").cast("date")))
    return facts(t).filter(keep).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15")
def between_filter(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_acctbal").between(0, 5000) & F.col("c_nationkey").between(5, 15)).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL AND o_totalprice > 0")
def delivered_orders(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F' and o_totalprice > 0").dropna(subset=["o_orderdate", "o_custkey"]).select("o_orderkey")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def having_floor(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 600")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderdate >= DATE '2000-01-01' - INTERVAL 90 DAY AND o_orderdate <= DATE '2000-01-01' AND o_totalprice >= 1000")
def built_predicate(t: Tables) -> DataFrame:
    return t.orders.filter(T.predicate(t.orders, {"prefix": {"o_orderpriority": "1"}, "date": ("o_orderdate", None, None), "min": {"o_totalprice": 1000}}, as_of="2000-01-01")).select("o_orderkey")


_RULES = {"quantity": "l_quantity < 5 OR l_quantity > 45", "discount": "l_discount > 0.08", "tax": "l_tax < 0.01"}


@query("SELECT issue, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS issue FROM lineitem WHERE {v}" for k, v in _RULES.items()) + ") GROUP BY 1")
def validate_rows(t: Tables) -> DataFrame:
    _, bad = T.validate(t.lineitem, {k: F.expr(v) for k, v in _RULES.items()})
    return bad.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {facts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN cancelled THEN 'cancelled' WHEN delay > 30 THEN 'late' WHEN delay > 0 THEN 'behind' ELSE 'on time' END AS status, coalesce(CASE WHEN NOT cancelled THEN ship_day END, day) AS expected FROM facts")
def status_ladder(t: Tables) -> DataFrame:
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("delay") > 30, "late").when(F.col("delay") > 0, "behind").otherwise("on time")
    return facts(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"), F.coalesce(C.unless("cancelled", "ship_day"), "day").alias("expected"))


@query("SELECT doc_id, substr(text, 1, 1000) AS excerpt, length(text) > 1000 AS cut FROM documents")
def truncate_text(t: Tables) -> DataFrame:
    """The excerpt is the feature; the text itself stays whole."""
    return t.documents.select("doc_id", F.substring("text", 1, 1000).alias("excerpt"), (F.length("text") > 1000).alias("cut"))


_LISTS = "a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS supp FROM lineitem GROUP BY 1)"


def _lists(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("x"))
    return a.select("l_orderkey", F.transform("x", lambda v: v["l_partkey"]).alias("parts"), F.transform("x", lambda v: v["l_suppkey"]).alias("supp"))


@query(f"WITH {_LISTS} SELECT l_orderkey, [coalesce(parts[i], parts[1], -1) for i in range(1, 5)] AS parts FROM a")
def positional_fallback(t: Tables) -> DataFrame:
    """The i-th value, else the first, else a default, for four places."""
    return _lists(t).select("l_orderkey", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get("parts", i), F.get("parts", F.lit(0)), F.lit(-1))).alias("parts"))


@query(f"WITH {_LISTS} SELECT l_orderkey, CASE WHEN len(list_distinct(supp)) = 1 THEN supp[1] WHEN len(supp) = 3 THEN supp[2] END AS lot FROM a")
def lot_attribution(t: Tables) -> DataFrame:
    return _lists(t).select("l_orderkey", F.when(F.size(F.array_distinct("supp")) == 1, F.get("supp", F.lit(0))).when(F.size("supp") == 3, F.get("supp", F.lit(1))).alias("lot"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def broadcast_join(t: Tables) -> DataFrame:
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def left_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def m2o_join(t: Tables) -> DataFrame:
    """Fails if the right key repeats."""
    return T.many_to_one(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice, items FROM orders JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def o2o_join(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    T.require_unique(t.orders, ["o_orderkey"])
    return t.orders.select("o_orderkey", "o_totalprice").join(items, "o_orderkey")


@query("WITH {facts} SELECT origin, destination, count(*) AS n FROM facts GROUP BY ALL")
def role_playing_dim(t: Tables) -> DataFrame:
    return facts(t).groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT event_id, user_id, cast(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, cast(epoch(date_trunc('second', ts)) AS BIGINT) AS s, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
    j AS (SELECT p.event_id, p.user_id, v.s AS vs, v.value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.s - p.s), v.s) AS k FROM p JOIN v ON p.user_id = v.user_id AND abs(v.s - p.s) <= 21600) SELECT p.event_id, p.user_id, j.vs AS matched_ts, j.value FROM p LEFT JOIN j ON p.event_id = j.event_id AND j.k = 1"""
)
def asof_nearest(t: Tables) -> DataFrame:
    """The user's nearest view within six hours of each purchase."""
    rows = t.events.select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    views = rows.filter("event_type = 'view'").groupBy("user_id", "s").agg(F.max("value").alias("value"))
    purchases = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "s")
    return asof.asof_nearest(purchases, views, ["user_id"], "s", "s", 21600, ["value"]).select("event_id", "user_id", "matched_ts", "value")


_BANDS = [("low", -1000.0, 0.0), ("middle", 0.0, 5000.0), ("high", 5000.0, 1e9)]


@query("SELECT c_custkey, band FROM customer JOIN (VALUES ('low', -1000.0, 0.0), ('middle', 0.0, 5000.0), ('high', 5000.0, 1e9)) b(band, lo, hi) ON c_acctbal > lo AND c_acctbal <= hi")
def bbox_theta_join(t: Tables) -> DataFrame:
    bands = F.broadcast(t.spark.createDataFrame(_BANDS, "band string, lo double, hi double"))  # a fixed table of three
    return t.customer.join(bands, (F.col("c_acctbal") > F.col("lo")) & (F.col("c_acctbal") <= F.col("hi"))).select("c_custkey", "band")


@query("SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS view_ts, min(ts) FILTER (WHERE event_type = 'purchase') AS purchase_ts, min(ts) FILTER (WHERE event_type = 'view') < min(ts) FILTER (WHERE event_type = 'purchase') AS forward FROM events GROUP BY 1")
def ordered_pair(t: Tables) -> DataFrame:
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    return t.events.groupBy("user_id").agg(first("view").alias("view_ts"), first("purchase").alias("purchase_ts")).withColumn("forward", F.col("view_ts") < F.col("purchase_ts"))


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE 'PRO%') ON o_orderkey = l_orderkey")
def left_semi(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part.filter(F.col("p_type").startswith("PRO")), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT vec_id, embeddings.label, count(*) OVER (PARTITION BY embeddings.label) AS peers FROM embeddings")
def embedding_attrs(t: Tables) -> DataFrame:
    groups = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("peers"))
    return t.embeddings.select("vec_id", "label").join(groups, "label").select("vec_id", "label", "peers")


_LOT_RULES = "lots AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), rules AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS lot, l_returnflag AS kind FROM lineitem)"


@query(f"WITH {_LOT_RULES} SELECT l_orderkey, l_linenumber, kind FROM lots JOIN rules ON k = l_orderkey AND lot = l_linenumber UNION ALL SELECT l_orderkey, l_linenumber, kind FROM lots JOIN rules ON k = l_orderkey WHERE lot IS NULL")
def null_matches_all_join(t: Tables) -> DataFrame:
    """Rules of an order hold for the line that they name, or for all lines of the order: two equi-joins, no OR."""
    lots = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    rules = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("l_linenumber"), F.col("l_returnflag").alias("kind")).distinct()
    own = lots.join(rules.filter("l_linenumber is not null"), ["l_orderkey", "l_linenumber"])
    shared = lots.join(rules.filter("l_linenumber is null").drop("l_linenumber"), "l_orderkey")
    return own.select("l_orderkey", "l_linenumber", "kind").unionByName(shared.select("l_orderkey", "l_linenumber", "kind"))


@query("SELECT c_custkey, count(s_suppkey) AS rules, min(s_suppkey) AS first_rule FROM (SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal >= 0 UNION ALL SELECT c_custkey, s_suppkey FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON cn.n_regionkey = sn.n_regionkey JOIN supplier ON s_nationkey = sn.n_nationkey WHERE s_acctbal < 0) GROUP BY 1")
def null_matches_all_join_region(t: Tables) -> DataFrame:
    """How many rules reach each customer: those of its nation, and those without a key of its region. Rules are added up
    per nation and region before customers meet them, so no pairs of customer and rule are made."""
    rules = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    region = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))  # nations are a fixed dimension
    sums = [F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("first")]
    own = rules.filter("s_acctbal >= 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(*sums)
    shared = rules.filter("s_acctbal < 0").join(region, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(*sums)
    shared = region.join(shared, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "n", "first")
    both = own.unionByName(shared).groupBy("c_nationkey").agg(F.sum("n").alias("rules"), F.min("first").alias("first_rule"))
    return t.customer.join(F.broadcast(both), "c_nationkey", "left").select("c_custkey", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"), "first_rule")  # a row for each nation


@query("SELECT p_partkey, profile, p_size <= max_size AND p_retailprice <= max_price AS fits FROM part, (VALUES ('small', 10, 1000.0), ('medium', 25, 1500.0), ('large', 50, 1e9)) p(profile, max_size, max_price)")
def profile_cross(t: Tables) -> DataFrame:
    profiles = F.broadcast(t.spark.createDataFrame([("small", 10, 1000.0), ("medium", 25, 1500.0), ("large", 50, 1e9)], "profile string, max_size int, max_price double"))
    return t.part.crossJoin(profiles).select("p_partkey", "profile", ((F.col("p_size") <= F.col("max_size")) & (F.col("p_retailprice") <= F.col("max_price"))).alias("fits"))


@query("SELECT * FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value, event_type AS new_value FROM events) WHERE old_value <> new_value")
def version_diff(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.lag("event_type").over(w).alias("old_value"), F.col("event_type").alias("new_value")).filter("old_value <> new_value")


_DAY_HASH = "h AS (SELECT cast(o_orderdate AS DATE) AS day, md5(string_agg(cast(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS sha FROM orders GROUP BY 1)"


@query(f"WITH {_DAY_HASH} SELECT h.day, CASE WHEN day(h.day) % 4 = 0 THEN 'no successful watermark' WHEN day(h.day) % 4 = 1 THEN 'source content changed' ELSE 'same source hash already committed' END AS reason, day(h.day) % 4 < 2 AS process FROM h WHERE h.day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def partition_plan(t: Tables) -> DataFrame:
    keys = F.array_sort(F.collect_list("o_orderkey"))
    sources = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.md5(F.array_join(keys.cast("array<string>"), ",")).alias("sha"))
    kind = F.dayofmonth("day") % 4
    committed = sources.filter(kind != 0).select("day", F.when(kind == 1, F.lit("other")).otherwise(F.col("sha")).alias("sha"))
    plan = T.plan_partitions(sources, committed, "1996-01-01", "1996-12-31")
    return plan.filter("reason <> 'missing source'").select("day", "reason", (F.col("action") == "process").alias("process"))


@query("SELECT cast(d AS DATE) AS day, cast(year(d) AS INTEGER) AS year, cast(month(d) AS INTEGER) AS month, cast(isodow(d) AS INTEGER) AS weekday FROM (SELECT unnest(range(min(cast(o_orderdate AS DATE)), max(cast(o_orderdate AS DATE)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders)")
def dim_date_sequence(t: Tables) -> DataFrame:
    span = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).select("day", F.year("day").alias("year"), F.month("day").alias("month"), (F.weekday("day") + 1).alias("weekday"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey)")
def supersede_anti(t: Tables) -> DataFrame:
    newer = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct()
    return t.lineitem.join(newer, ["l_orderkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY n DESC, category LIMIT 3")
def market_counts(t: Tables) -> DataFrame:
    return t.part.filter("p_size > 10").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(3)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS unknown_order, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS early, count(*) FILTER (WHERE date_diff('day', o_orderdate, l_shipdate) > 90) AS long, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def quality_counters(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("o_orderkey is null")).alias("unknown_order"), F.count_if(F.expr("l_shipdate < o_orderdate")).alias("early"), F.count_if(F.datediff("l_shipdate", "o_orderdate") > 90).alias("long"))
    return c.crossJoin(T.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("duplicate_keys")))  # one row each


@query("SELECT 'o_totalprice' AS name, count(*) AS n, count(*) - count(o_totalprice) AS missing, count(DISTINCT o_totalprice) AS n_distinct, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey), cast(min(o_custkey) AS DOUBLE), cast(max(o_custkey) AS DOUBLE) FROM orders")
def data_audit(t: Tables) -> DataFrame:
    return T.audit(t.orders, ["o_totalprice", "o_custkey"])


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def nearest_rank_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.count_distinct("user_id").alias("users"))


@query(" UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in ("orders", "lineitem", "customer", "part", "supplier", "events", "documents")))
def table_counts(t: Tables) -> DataFrame:
    out = None
    for name in ("orders", "lineitem", "customer", "part", "supplier", "events", "documents"):
        one = getattr(t, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return T.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("WITH c AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), e AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL) SELECT cast(sum(least(c.n, e.n)) AS BIGINT) AS common, round(sum(least(c.n, e.n)) / (SELECT sum(n) FROM c), 6) AS precision, round(sum(least(c.n, e.n)) / (SELECT sum(n) FROM e), 6) AS recall FROM c JOIN e USING (l_orderkey, l_suppkey)")
def multiset_precision(t: Tables) -> DataFrame:
    return T.multiset_pr(t.lineitem.filter("l_linenumber <= 4"), t.lineitem.filter("l_linenumber >= 3"), ["l_orderkey", "l_suppkey"])


_LATEST = "SELECT {c} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts {o}, event_id {o}) = 1"


@query(_LATEST.format(c="user_id, event_id, event_type", o=""))
def rn_first(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", "event_type", F.row_number().over(w).alias("k")).filter("k = 1").drop("k")


@query(_LATEST.format(c="user_id, event_id, event_type", o="DESC"))
def rn_last(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("user_id", "event_id", "event_type", F.row_number().over(w).alias("k")).filter("k = 1").drop("k")


@query(_LATEST.format(c="user_id, event_id, event_type, value", o="DESC"))
def latest_per_key(t: Tables) -> DataFrame:
    return T.latest_per_key(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') AS previous, min_by(event_id, (ts, event_id)) FILTER (WHERE ts > TIMESTAMP '2024-01-15 12:00:00') AS next FROM events GROUP BY 1")
def prev_next_around(t: Tables) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.max_by(F.when(F.col("ts") <= now, F.col("event_id")), F.when(F.col("ts") <= now, order)).alias("previous"), F.min_by(F.when(F.col("ts") > now, F.col("event_id")), F.when(F.col("ts") > now, order)).alias("next"))


_VOLUME = "d AS (SELECT cast(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT day, n, median(n) OVER f AS med, count(*) OVER f AS k FROM d WINDOW f AS (ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))"


@query(f"WITH {_VOLUME} SELECT day, n, CASE WHEN k >= 7 THEN round(n / med, 4) END AS ratio, CASE WHEN k >= 7 AND (n / med < 0.2 OR n / med > 5) THEN 'FAIL' ELSE 'PASS' END AS status FROM w")
def volume_anomaly(t: Tables) -> DataFrame:
    return T.volume_gate(t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY user_id) AS latest FROM events")
def version_number(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    return t.events.select("event_id", "user_id", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("version"), F.count(F.lit(1)).over(w).alias("latest"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_global(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice DESC)[1:3] AS top FROM lineitem GROUP BY 1")
def top3_in_array(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list("l_extendedprice"), asc=False), 1, 3).alias("top"))


@query("SELECT c_custkey AS k, c_acctbal AS balance, 'customer' AS side FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("side"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("side"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS dropped FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def dedup_keep_first(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return first.select("l_orderkey", "l_linenumber", "x.l_partkey", "x.l_suppkey", "dropped")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedup_keep_last(t: Tables) -> DataFrame:
    return T.latest_per_key(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(f"WITH {_LISTS}, x AS (SELECT l_orderkey, v, i FROM (SELECT l_orderkey, unnest(supp) AS v, generate_subscripts(supp, 1) AS i FROM a)) SELECT l_orderkey, list(v ORDER BY f) AS sellers FROM (SELECT l_orderkey, v, min(i) AS f FROM x GROUP BY ALL) GROUP BY 1")
def array_distinct(t: Tables) -> DataFrame:
    return _lists(t).select("l_orderkey", F.array_distinct("supp").alias("sellers"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.select("s_nationkey"))


_BRANDS = "b AS (SELECT p_size, list(DISTINCT p_type) AS kinds FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY 1), o AS (SELECT p_size, list(DISTINCT p_type) AS kinds FROM part WHERE p_brand LIKE 'Brand#2%' GROUP BY 1)"


def _kinds(t: Tables, brand: str, name: str) -> DataFrame:
    return t.part.filter(F.col("p_brand").startswith(brand)).groupBy("p_size").agg(F.collect_set("p_type").alias(name))


@query(f"WITH {_BRANDS} SELECT b.p_size, cast(len(list_intersect(b.kinds, o.kinds)) AS INTEGER) AS common, list_has_all(o.kinds, b.kinds) AS subset FROM b JOIN o USING (p_size)")
def array_overlap(t: Tables) -> DataFrame:
    rows = _kinds(t, "Brand#1", "a").join(_kinds(t, "Brand#2", "b"), "p_size")
    return rows.select("p_size", F.size(F.array_intersect("a", "b")).alias("common"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@query(f"WITH {_BRANDS} SELECT b.p_size, list_has_any(b.kinds, o.kinds) AS overlap FROM b JOIN o USING (p_size)")
def arrays_overlap(t: Tables) -> DataFrame:
    return _kinds(t, "Brand#1", "a").join(_kinds(t, "Brand#2", "b"), "p_size").select("p_size", F.arrays_overlap("a", "b").alias("overlap"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'summer' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'autumn' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'winter' ELSE 'spring' END AS season FROM orders")
def season(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C.season(F.month("o_orderdate")).alias("season"))


@query("SELECT event_id, cast(year(ts) AS INTEGER) AS year, cast(month(ts) AS INTEGER) AS month, cast(isodow(ts) AS INTEGER) AS weekday_number, cast(hour(ts) AS INTEGER) AS hour, isodow(ts) >= 5 AS near_weekend FROM events")
def calendar_parts(t: Tables) -> DataFrame:
    d = F.weekday("ts") + 1
    return t.events.select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), d.alias("weekday_number"), F.hour("ts").alias("hour"), (d >= 5).alias("near_weekend"))


@query("SELECT event_id, round(epoch_us(ts) / 86400e6, 6) AS days FROM events")
def fractional_days(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6), 6).alias("days"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate > o_orderdate + INTERVAL 46 DAY AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def late_label(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 46 days")).alias("late"))


@query("SELECT p_partkey, round(least(greatest(p_retailprice / p_size, 0), 200), 4) AS price_by_size, CASE WHEN p_size <= 10 THEN 'to 10' WHEN p_size <= 25 THEN 'to 25' ELSE 'over 25' END AS bucket FROM part")
def clipped_ratios(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(C.clipped_ratio("p_retailprice", "p_size", 0.0, 200.0), 4).alias("price_by_size"), C.bucket("p_size", [10, 25], ["to 10", "to 25", "over 25"]).alias("bucket"))


@query("SELECT c_custkey, cast(c_custkey // 1000 AS VARCHAR) || ' to ' || cast(c_nationkey // 10 AS VARCHAR) AS route FROM customer")
def zip_region(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat_ws(" to ", C.zip_region("c_custkey"), F.floor(F.col("c_nationkey") / 10).cast("string")).alias("route"))


@query("SELECT c_custkey, c_acctbal AS amount, cast(NULL AS DOUBLE) AS bad FROM customer")
def parse_money(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(",")), F.lit(" "))
    return t.customer.select("c_custkey", C.parse_money(text).alias("amount"), C.parse_money("c_name").alias("bad"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' OR p_name LIKE '%widget%' THEN 'hardware' ELSE 'other' END AS category FROM part")
def keyword_category(t: Tables) -> DataFrame:
    name = F.lower("p_name")
    return t.part.select("p_partkey", F.when(name.rlike("ring"), "ring").when(name.rlike("bolt|widget"), "hardware").otherwise("other").alias("category"))


_SAID = [w for words in eforms.CATEGORY_WORDS.values() for w in words]
_SAID_SQL = "['" + "', '".join(_SAID) + "'][p_partkey % " + str(len(_SAID) + 3) + " + 1]"
_CASES = " ".join("WHEN " + " OR ".join(f"contains(said, '{w}')" for w in words) + f" THEN '{k}'" for k, words in eforms.CATEGORY_WORDS.items())


@query(f"SELECT p_partkey, CASE {_CASES} ELSE 'technical' END AS category FROM (SELECT p_partkey, lower(p_type || ' ' || p_name || ' ' || coalesce({_SAID_SQL}, '')) AS said FROM part)")
def requirement_category(t: Tables) -> DataFrame:
    """The rule of requirements' categories, on parts whose text names one of its words, or none."""
    words = F.array(*map(F.lit, _SAID))
    text = F.concat_ws(" ", "p_name", F.get(words, (F.col("p_partkey") % (len(_SAID) + 3)).cast("int")))
    return t.part.select("p_partkey", F.col("p_type").alias("code"), text.alias("text")).select("p_partkey", eforms.category().alias("category"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def row_fingerprint(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C.fingerprint("o_orderkey", "o_custkey", "o_orderstatus").alias("fingerprint"))


@query("SELECT conv_id, turn, substr(sha256(text), 1, 12) AS hash, length(text) AS n_chars FROM conversations")
def privacy_hash(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 12).alias("hash"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT event_id, strftime(timezone('Europe/Helsinki', timezone('UTC', ts)), '%Y-%m') AS month, cast(isodow(timezone('Europe/Helsinki', timezone('UTC', ts))) - 1 AS INTEGER) AS weekday, cast(hour(timezone('Europe/Helsinki', timezone('UTC', ts))) AS INTEGER) AS hour FROM events")
def local_calendar(t: Tables) -> DataFrame:
    local = C.local_time("ts")
    return t.events.select("event_id", F.date_format(local, "yyyy-MM").alias("month"), F.weekday(local).alias("weekday"), F.hour(local).alias("hour"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("SELECT cast(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 0) AS valid, CASE WHEN count(*) FILTER (WHERE o_orderpriority = '1-URGENT') >= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders GROUP BY 1")
def partition_gate(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("o_totalprice > 0")).alias("valid"), F.count_if(F.expr("o_orderpriority = '1-URGENT'")).alias("urgent"))
    return g.select("day", "n", "valid", F.when(F.col("urgent") >= 1, "PASS").otherwise("FAIL").alias("status"))


@query("SELECT 'unique_key' AS check_name, CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status UNION ALL SELECT 'required_columns', 'PASS' UNION ALL SELECT 'freshness', CASE WHEN date_diff('day', max(l_shipdate), DATE '2001-11-10') > 30 THEN 'WARN' ELSE 'PASS' END FROM lineitem")
def contract_check(t: Tables) -> DataFrame:
    return T.contract_check(t.lineitem, required=["l_orderkey", "l_linenumber", "l_shipdate"], key=["l_orderkey", "l_linenumber"], freshness=("l_shipdate", "2001-11-10", 30))


@query("WITH {facts} SELECT (SELECT count(*) FROM (SELECT 1 FROM facts GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1)) AS duplicates, count(*) FILTER (WHERE day IS NULL OR ship_day IS NULL) AS critical_nulls, count(*) FILTER (WHERE abs(delay) > 60) AS extreme, count(*) > 0 AS not_empty FROM facts")
def silver_gates(t: Tables) -> DataFrame:
    """Facts are read once: a key's rows are added up where their order lies, and the sums of all keys are the gates."""
    per = facts(t).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("day is null or ship_day is null")).alias("nulls"), F.count_if(F.expr("abs(delay) > 60")).alias("far"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("nulls").alias("critical_nulls"), total("far").alias("extreme"), (F.count(F.lit(1)) > 0).alias("not_empty"), F.count_if(F.col("n") > 1).alias("duplicates"))


@query("WITH {facts} SELECT count(*) FILTER (WHERE NOT ((delay <= 5)::INT <= (delay <= 10)::INT AND (delay <= 10)::INT <= (delay <= 15)::INT AND (delay <= 15)::INT <= (delay <= 30)::INT)) AS violations FROM facts")
def gold_monotonic(t: Tables) -> DataFrame:
    flags = [F.when(F.col("delay") <= x, 1).otherwise(0) for x in (5, 10, 15, 30)]
    broken = F.lit(False)
    for a, b in zip(flags, flags[1:], strict=False):
        broken = broken | (a > b)
    return facts(t).agg(F.count_if(broken).alias("violations"))


@query("SELECT 'orders without lines' AS check_name, count(*) AS observed, CASE WHEN count(*) > 1000 THEN 'FAIL' WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def gate_verdict(t: Tables) -> DataFrame:
    """The verdict as a row, FAIL too: whoever builds on the orders raises on it by require_pass."""
    n = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("observed"))
    return n.select(F.lit("orders without lines").alias("check_name"), "observed", F.when(F.col("observed") > 1000, "FAIL").when(F.col("observed") > 0, "WARN").otherwise("PASS").alias("status"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def mart_rebuild(t: Tables) -> DataFrame:
    """A cross-partition mart from stored facts after one partition was replaced by itself."""
    path = new_path(t.spark, "facts")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"))
    sinks.append(rows, path, ["year"])
    sinks.replace_partitions(rows.filter("year = '1999'"), path, "year", ["1999"])
    stored = t.spark.read.schema("o_orderkey long, o_totalprice double, year string").parquet(path)
    return stored.groupBy("year").agg(F.count(F.lit(1)).alias("n"), C.exact_sum("o_totalprice").alias("total"))


@query("WITH {facts} SELECT count(*) AS scheduled, count(*) FILTER (WHERE cancelled) AS cancelled, count(delay) AS completed, count(*) - count(*) FILTER (WHERE cancelled) - count(delay) AS missing, count(*) = count(*) FILTER (WHERE cancelled) + count(delay) AS balanced FROM facts")
def reconcile_counts(t: Tables) -> DataFrame:
    c = facts(t).agg(F.count(F.lit(1)).alias("scheduled"), F.count_if("cancelled").alias("cancelled"), F.count("delay").alias("completed"))
    return c.withColumns({"missing": F.expr("scheduled - cancelled - completed"), "balanced": F.expr("scheduled = cancelled + completed")})


@query("WITH {facts}, a AS (SELECT region, count(*) AS n FROM facts WHERE year(day) = 1996 GROUP BY 1), b AS (SELECT region, count(*) AS n FROM facts WHERE year(day) = 1997 GROUP BY 1) SELECT coalesce(a.region, b.region) AS region, a.n AS approved, b.n AS observed, abs(coalesce(b.n, 0) - coalesce(a.n, 0)) <= 0.02 * coalesce(a.n, 0) AS ok FROM a FULL JOIN b ON a.region = b.region")
def kpi_diff(t: Tables) -> DataFrame:
    f = facts(t)
    side = lambda y, name: f.filter(F.year("day") == y).groupBy("region").agg(F.count(F.lit(1)).alias(name))
    return T.kpi_diff(side(1996, "approved"), side(1997, "observed"), ["region"], 0.02)


_BATCH = "o AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), n AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1)"


def _batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-12"))
    last = lambda df: T.latest_per_key(df.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")
    return last(t.events.filter(F.col("ts") < a)), last(t.events.filter((F.col("ts") >= a) & (F.col("ts") < b)))


@query(f"WITH {_BATCH} SELECT n.user_id, CASE WHEN o.user_id IS NULL THEN 'new' WHEN o.v <> n.v THEN 'updated' ELSE 'unchanged' END AS status FROM n LEFT JOIN o USING (user_id)")
def ingest_classify(t: Tables) -> DataFrame:
    old, new = _batches(t)
    return T.classify(old, new, ["user_id"], ["event_type"]).select("user_id", "status")


@query(f"WITH {_BATCH} SELECT user_id, 'event_type' AS field, o.v AS old_value, n.v AS new_value, 'MATERIAL' AS materiality FROM n JOIN o USING (user_id) WHERE o.v <> n.v")
def field_diff(t: Tables) -> DataFrame:
    old, new = _batches(t)
    return T.field_diff(old, new, ["user_id"], ["event_type"], {"event_type"})


@query("SELECT event_id FROM events WHERE value IS NULL OR props NOT LIKE '%1%'")
def pending_filter(t: Tables) -> DataFrame:
    return t.events.filter(F.col("value").isNull() | ~F.col("props").contains("1")).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount < 0 OR l_quantity = 50 THEN '__missing__' WHEN l_quantity <= 5 THEN 'to 5' WHEN l_quantity <= 15 THEN 'to 15' ELSE 'over 15' END AS bucket FROM lineitem")
def bucketize(t: Tables) -> DataFrame:
    """Right-closed buckets; a missing value gets a label of its own."""
    q = F.when((F.col("l_discount") < 0) | (F.col("l_quantity") == 50), None).otherwise(F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.bucket(q, [5, 15], ["to 5", "to 15", "over 15"]).alias("bucket"))


@query("WITH g AS (SELECT source, lang, [min(doc_id), max(doc_id)] AS ids FROM documents GROUP BY ALL) SELECT source, coalesce(max(ids) FILTER (WHERE lang = 'fr'), max(ids) FILTER (WHERE lang = 'de'), max(ids) FILTER (WHERE lang = 'en'), max(ids) FILTER (WHERE lang = 'es')) AS ids FROM g GROUP BY 1")
def localized_pick(t: Tables) -> DataFrame:
    """A source's first and last document in the first language that it has."""
    per = t.documents.groupBy("source", "lang").agg(F.array(F.min("doc_id"), F.max("doc_id")).alias("ids"))
    maps = per.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "ids"))).alias("m"))  # an entry per language
    return maps.select("source", C.localized("m", ("fr", "de", "en", "es")).alias("ids"))


_CATEGORY = "CASE c_mktsegment WHEN 'BUILDING' THEN 'turnover' WHEN 'MACHINERY' THEN 'references' WHEN 'HOUSEHOLD' THEN 'certification' WHEN 'FURNITURE' THEN 'language' ELSE 'technical' END"


@query(f"SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'NOT_APPLICABLE' WHEN {_CATEGORY} = 'turnover' THEN CASE WHEN 5000 >= c_acctbal THEN 'PASS' ELSE 'FAIL' END WHEN {_CATEGORY} = 'references' THEN CASE WHEN 300 >= c_acctbal THEN 'PASS' ELSE 'FAIL' END WHEN {_CATEGORY} = 'certification' THEN CASE WHEN c_nationkey IN (3, 4) THEN 'PASS' ELSE 'FAIL' END WHEN {_CATEGORY} = 'language' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END ELSE 'UNKNOWN' END AS outcome FROM customer")
def check_outcome(t: Tables) -> DataFrame:
    """Customers stand for requirements: their segment is the category and their balance the value."""
    text = F.when(F.expr(_CATEGORY) == "language", F.when(F.col("c_nationkey") % 2 == 0, "ENG").otherwise("swe")).otherwise(F.concat(F.lit("ISO "), F.col("c_nationkey").cast("string")))
    asked = t.customer.select("c_custkey", F.expr(_CATEGORY).alias("category"), F.col("c_acctbal").alias("value_num"), text.alias("value_str"), F.lit(None).cast("array<string>").alias("value_list"), F.when(F.col("c_nationkey") == 0, "NOT_REQUIRED").otherwise("UNKNOWN").alias("stage"))
    profile = asked.withColumns({"annual_turnover": F.lit(5000.0), "reference_count": F.lit(300), "certifications": F.array(F.lit("iso 3"), F.lit("Iso 4")), "languages": F.array(F.lit("English"))})
    return profile.select("c_custkey", tenders.check_outcome().alias("outcome"))


@query("SELECT p_partkey, least(50, 10 * ((p_name LIKE '%ring%')::INT + (p_name LIKE '%widget%' OR p_type ILIKE '%promo%')::INT)) + CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 20 ELSE 0 END + CASE WHEN p_retailprice BETWEEN 950 AND 1500 THEN 20 ELSE 0 END + CASE WHEN p_size > 20 THEN 10 ELSE 0 END AS fit FROM part")
def fit_score(t: Tables) -> DataFrame:
    """Parts stand for lots: name and type are the text, the brand is the place, the price the value."""
    deadline = F.when(F.col("p_size") > 20, "2027-01-01T00:00").otherwise("2026-01-01")
    lots = t.part.select("p_partkey", F.col("p_name").alias("title"), F.when(F.lower("p_type").contains("promo"), "widget").otherwise(F.lower("p_type")).alias("description"), F.col("p_retailprice").alias("value"), deadline.alias("deadline"), F.array("p_brand").alias("place_of_performance"))
    profile = lots.withColumns({"capabilities": F.array(F.lit("Ring"), F.lit("widget")), "countries_served": F.array(F.lit("Brand#1"), F.lit("Brand#2")), "min_contract_value": F.lit(950.0), "max_contract_value": F.lit(1500.0)})
    return profile.select("p_partkey", tenders.fit_score("2026-06-01").alias("fit"))


@query(f"WITH {_BATCH}, c AS (SELECT n.user_id, n.v AS v, o.v AS ov FROM n LEFT JOIN o USING (user_id)) SELECT user_id FROM c WHERE ov IS NULL OR ov <> v")
def reassess_trigger(t: Tables) -> DataFrame:
    """New keys, and known ones with a change in a material field, are assessed again."""
    old, new = _batches(t)
    fresh = T.classify(old, new, ["user_id"], ["event_type"]).filter("status = 'new'").select("user_id")
    changed = T.field_diff(old, new, ["user_id"], ["event_type"], {"event_type"}).filter("materiality = 'MATERIAL'").select("user_id").distinct()
    return fresh.unionByName(changed)
