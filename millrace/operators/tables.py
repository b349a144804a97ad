"""Keyed tables: latest rows, versions, plans, contracts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order per key, as an aggregate."""
    own = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("__x")).select(*keys, *[F.col("__x")[c].alias(c) for c in own])


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    if not duplicates(df, keys).isEmpty():
        raise ValueError(f"{', '.join(keys)} must be unique")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    require_unique(right, keys)
    return left.join(right, keys, "left")


def check_columns(df: DataFrame, types: dict[str, str]) -> None:
    have = dict(df.dtypes)
    wrong = {c: have.get(c) for c, kind in types.items() if have.get(c) != kind}
    if wrong:
        raise ValueError(f"columns differ from the contract: {wrong}")


def catalog(df: DataFrame, contains: dict[str, str], prefix: dict[str, str], among: dict[str, list[str]]) -> DataFrame:
    """Rows that contain texts (in any case), start with codes and have listed values."""
    for c, v in contains.items():
        df = df.filter(F.lower(c).contains(v.lower()))
    for c, v in prefix.items():
        df = df.filter(F.col(c).startswith(v))
    for c, v in among.items():
        df = df.filter(F.col(c).isin(v))
    return df


def predicate(df: DataFrame, spec: dict, as_of: str, days: int = 90) -> Column:
    """A filter from prefix, date and min conditions; without dates the last `days` before as_of."""
    unknown = set(spec) - {"prefix", "date", "min"}
    named = {*spec.get("prefix", {}), *spec.get("min", {}), *([spec["date"][0]] if "date" in spec else [])}
    if unknown or named - set(df.columns):
        raise ValueError(f"unknown condition or column: {unknown | (named - set(df.columns))}")
    out = F.lit(True)
    for c, v in spec.get("prefix", {}).items():
        out = out & F.col(c).startswith(v)
    for c, v in spec.get("min", {}).items():
        out = out & (F.col(c) >= v)
    if "date" in spec:
        c, start, stop = spec["date"]
        stop = F.lit(stop or as_of).cast("date")
        start = F.date_sub(F.lit(as_of).cast("date"), days) if start is None else F.lit(start).cast("date")
        kind = df.schema[c].dataType  # the bounds take the column's type, so that the scan can use them
        out = out & (F.col(c) >= start.cast(kind)) & (F.col(c) <= stop.cast(kind))
    return out


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their issues)."""
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("issues", issues)
    return marked.filter(F.size("issues") == 0).drop("issues"), marked.filter(F.size("issues") > 0)


def plan_partitions(sources: DataFrame, committed: DataFrame, start: str, end: str, force: bool = False) -> DataFrame:
    """(day, action, reason) per day of the range, from (day, sha) of sources and of the watermark."""
    days = sources.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    rows = days.join(sources.select("day", F.col("sha").alias("s")), "day", "left").join(committed.select("day", F.col("sha").alias("c")), "day", "left")
    reason = F.when(F.col("s").isNull(), "missing source").when(F.lit(force), "forced backfill/recovery").when(F.col("c").isNull(), "no successful watermark").when(F.col("c") != F.col("s"), "source content changed").otherwise("same source hash already committed")
    return rows.select("day", reason.alias("reason")).withColumn("action", F.when(F.col("reason") == "missing source", "error").when(F.col("reason").startswith("same"), "skip").otherwise("process"))


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, missing and distinct values and the range of each column, from one pass, as long rows."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.count_distinct(F.col(c)).alias("n_distinct"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def multiset_pr(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of multisets: per key the lesser count is common."""
    both = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")).join(expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("e")), keys, "full_outer").fillna(0, ["a", "e"])
    sums = both.agg(F.sum(F.least("a", "e")).alias("common"), F.sum("a").alias("a"), F.sum("e").alias("e"))
    return sums.select("common", F.round(F.col("common") / F.col("a"), 6).alias("precision"), F.round(F.col("common") / F.col("e"), 6).alias("recall"))


def volume_gate(days: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Each day's count against the median of the 28 dates before it; fewer than 7 positive ones are no baseline."""
    w = Window.orderBy("day").rowsBetween(-28, -1)  # one row per day
    past = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("n"))).over(w))  # 28 counts at most
    rows = days.select("day", "n", past.alias("past")).withColumn("k", F.size("past"))
    middle = lambda i: F.get("past", F.floor(i).cast("int"))
    rows = rows.withColumn("med", (middle((F.col("k") - 1) / 2) + middle(F.col("k") / 2)) / 2)
    ratio = F.when(F.col("k") >= 7, F.col("n") / F.col("med"))
    return rows.select("day", "n", F.round(ratio, 4).alias("ratio"), F.when((ratio < low) | (ratio > high), "FAIL").otherwise("PASS").alias("status"))


def not_monotonic(facts: DataFrame, flags: list[str]) -> DataFrame:
    """Rows in which a flag holds and one after it does not."""
    return facts.filter(F.exists(F.array(*[F.col(a) & ~F.col(b) for a, b in zip(flags, flags[1:], strict=False)]), lambda x: x))


def contract_check(df: DataFrame, required: list[str], key: list[str], freshness: tuple[str, str, int]) -> DataFrame:
    """Required columns, unique key, and age of the newest row in days (a warning only)."""
    missing = [c for c in required if c not in df.columns]
    spark = df.sparkSession
    columns = spark.range(1).select(F.lit("required_columns").alias("check_name"), F.lit("FAIL" if missing else "PASS").alias("status"))
    unique = duplicates(df, key).agg(F.lit("unique_key").alias("check_name"), F.when(F.count(F.lit(1)) == 0, "PASS").otherwise("FAIL").alias("status"))
    column, today, days = freshness
    fresh = df.agg(F.lit("freshness").alias("check_name"), F.when(F.datediff(F.lit(today).cast("date"), F.max(column)) > days, "WARN").otherwise("PASS").alias("status"))
    return columns.unionByName(unique).unionByName(fresh)


def require_pass(results: DataFrame, stage: str) -> None:
    """Raises on any FAIL; warnings pass. results has one row per check."""
    failed = [r["check_name"] for r in results.filter("status = 'FAIL'").collect()]
    if failed:
        raise ValueError(f"{stage}: {', '.join(failed)} failed")


def kpi_diff(approved: DataFrame, observed: DataFrame, dims: list[str], tolerance: float) -> DataFrame:
    both = approved.join(observed, dims, "full_outer")
    a, b = F.coalesce("approved", F.lit(0)), F.coalesce("observed", F.lit(0))
    return both.select(*dims, "approved", "observed", (F.abs(b - a) <= tolerance * a).alias("ok"))


def classify(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """new with status new, updated or unchanged against the state, by content."""
    h = lambda: F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    state = old.select(*keys, h().alias("__old"))
    rows = new.withColumn("__new", h()).join(state, keys, "left")
    return rows.withColumn("status", F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("__new"), "updated").otherwise("unchanged")).drop("__old", "__new")


def field_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], material: set[str]) -> DataFrame:
    """One row per changed field, as strings, with its materiality."""
    a, b = old.alias("a"), new.alias("b")
    changes = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("old_value"), F.col(f"b.{f}").cast("string").alias("new_value"), F.lit("MATERIAL" if f in material else "INFORMATIONAL").alias("materiality"))) for f in fields]
    return a.join(b, keys).select(*keys, F.inline(F.filter(F.array(*changes), lambda x: x.isNotNull())))
