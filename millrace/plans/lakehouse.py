"""Incremental lakehouse over Parquet: content-hash planning, one plan for all selected dates, gates on staged rows,
partition replacement, watermark last. The manifest has one row per date and content that was ever ingested.

Folders below the root: bronze, silver, gold and control. Facts are replaced by date and marts across dates rebuilt from
them; silver, gold and the watermark are tables of one commits.Store, so a run changes all of them in one commit, and a
reader (`table`) sees them before it or after it. A run that fails leaves a FAILED row and everything else as it was.

Planning lists the landed files of the dates asked for and opens only those whose size or time of change differ from the
manifest's, or all of them if forced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import THRESHOLDS
from millrace.operators.tables import bounded, duplicates, latest_per_key, not_monotonic, plan_partitions, require_pass, volume_gate
from millrace.plans import rail
from millrace.sources import feeds
from millrace.sources.commits import Store
from millrace.sources.shared import stage
from millrace.sources.sinks import append, insert_absent, read_or_empty

WATERMARK = "departure_date string, source_content_sha256 string, committed_run_id string, committed_at timestamp"
RUNS = "run_id string, status string, requested_start string, requested_end string, processed int, skipped int, detail string, recorded_at timestamp"
MANIFEST = "departure_date string, content_sha256 string, source_path string, source_row_count long, source_bytes long, source_changed_at timestamp, ingested_at timestamp, run_id string"
COMMITTED = "control/watermark"
QUALITY = "departure_date string, check_name string, status string, observed long, run_id string"


@dataclass(frozen=True)
class Conf:
    source: str  # <date>.json.gz files of trains
    stations: str
    root: str


@dataclass
class Report:
    run_id: str
    processed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def table(spark: SparkSession, conf: Conf, name: str, days: list[str] | None = None) -> DataFrame:
    """A table of silver or gold as of the last commit; of a table by date, the files of these dates alone."""
    return Store(spark, conf.root).read(name, parts=days)


def source_hashes(spark: SparkSession, conf: Conf, start: str, end: str, force: bool = False) -> DataFrame:
    """(day, sha, bytes, changed_at) of the landed files of these dates; content is read where the manifest does not know it."""
    files = feeds.list_files(spark, conf.source, "*.json.gz").withColumn("day", F.substring("name", 1, 10).try_cast("date"))
    wanted = files.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    manifest = read_or_empty(spark, f"{conf.root}/control/manifest", MANIFEST).filter(F.col("departure_date").between(start, end))
    if force:
        manifest = manifest.limit(0)
    known = latest_per_key(manifest, ["departure_date", "source_bytes", "source_changed_at"], ["ingested_at", "content_sha256"])
    known = known.select(F.to_date("departure_date").alias("day"), F.col("source_bytes").alias("bytes"), F.col("source_changed_at").alias("changed_at"), F.col("content_sha256").alias("sha"))
    planned = stage(wanted.join(bounded(known), ["day", "bytes", "changed_at"], "left").select("day", "bytes", "changed_at", "path", "sha"), "landed")
    paths = [r["path"] for r in planned.filter("sha is null").select("path").collect()]  # one for each date asked for
    read = feeds.fingerprint_paths(spark, paths)
    return planned.join(read.select("path", F.col("sha256").alias("new")), "path", "left").select("day", F.coalesce("sha", "new").alias("sha"), "bytes", "changed_at")


def watermark(spark: SparkSession, conf: Conf) -> DataFrame:
    """(day, sha) of the last commit per date."""
    log = Store(spark, conf.root).read(COMMITTED, WATERMARK)
    return log.groupBy(F.to_date("departure_date").alias("day")).agg(F.max_by("source_content_sha256", "committed_at").alias("sha"))


def silver_gates(raw: DataFrame, journeys: DataFrame, arrivals: DataFrame, stations: DataFrame) -> DataFrame:
    """(departure_date, check_name, status, observed), from one aggregate per frame."""
    def gate(df: DataFrame, name: str, date) -> DataFrame:
        return df.groupBy(date.cast("string").alias("departure_date")).agg(F.count(F.lit(1)).alias("observed")).select("departure_date", F.lit(name).alias("check_name"), F.lit("FAIL").alias("status"), "observed")

    day = F.col("departure_date")
    out = gate(duplicates(raw, ["departureDate", "trainNumber"]), "duplicate_source_business_keys", F.col("departureDate"))
    out = out.union(gate(duplicates(journeys, ["departure_date", "journey_key"]), "duplicate_journey_keys", day)).union(gate(duplicates(arrivals, ["departure_date", "arrival_key"]), "duplicate_arrival_keys", day))
    out = out.union(gate(journeys.filter("abs(final_delay_minutes) > 1440"), "impossible_delay_over_24h", day)).union(gate(journeys.filter("origin_code is null or destination_code is null or scheduled_departure_utc is null"), "missing_critical_fields", day))
    stops = raw.select("departureDate", F.inline("timeTableRows")).filter("commercialStop and trainStopping and countryCode = 'FI'").select("departureDate", F.col("stationShortCode").alias("station_code")).distinct()
    out = out.union(gate(stops.join(bounded(stations.select("station_code")), "station_code", "left_anti"), "station_referential_integrity", F.col("departureDate")))
    asked = raw.select("departureDate").distinct().join(journeys.select(F.col("departure_date").cast("string").alias("departureDate")).distinct(), "departureDate", "left_anti")
    return out.union(gate(asked, "nonempty_modelled_partition", F.col("departureDate")))


def volume_gates(manifest: DataFrame, days: list[str]) -> DataFrame:
    """Of the named days: the number of rows against the median of the 28 dates before, from the newest row of each date."""
    counts = latest_per_key(manifest, ["departure_date"], ["ingested_at", "content_sha256"]).select(F.col("departure_date").alias("day"), F.col("source_row_count").alias("n"))
    rows = volume_gate(counts).filter(F.col("day").isin(days))
    return rows.select(F.col("day").alias("departure_date"), F.lit("row_count_anomaly").alias("check_name"), "status", F.col("n").alias("observed"))


def gold_gates(facts: DataFrame) -> DataFrame:
    """Whoever is on time by a limit is so by every longer one, and has completed."""
    wrong = not_monotonic(facts, [*[f"on_time_{t}" for t in THRESHOLDS], "completed"])
    return facts.select("departure_date").distinct().join(wrong.groupBy("departure_date").agg(F.count(F.lit(1)).alias("n")), "departure_date", "left").select(
        F.col("departure_date").cast("string"), F.lit("metric_monotonicity").alias("check_name"), F.when(F.col("n").isNull(), "PASS").otherwise("FAIL").alias("status"), F.coalesce("n", F.lit(0)).alias("observed")
    )


def run(spark: SparkSession, conf: Conf, start: str, end: str, now: str, force: bool = False) -> Report:
    """Brings the dates from start to end up to their landed content; now stamps the run."""
    report = Report(uuid.uuid4().hex)
    stamp = F.lit(now).cast("timestamp")

    def record(status: str, detail: str = "") -> None:
        row = spark.createDataFrame([(report.run_id, status, start, end, len(report.processed), len(report.skipped), detail[:1000])], RUNS.rsplit(",", 1)[0])
        append(row.withColumn("recorded_at", stamp), f"{conf.root}/control/runs")

    try:
        sources = stage(source_hashes(spark, conf, start, end, force), "sources")
        plan = plan_partitions(sources, watermark(spark, conf), start, end, force).collect()  # one row per date
        lost = [str(r["day"]) for r in plan if r["action"] == "error"]
        if lost:
            raise FileNotFoundError(f"no landed file for {', '.join(lost[:5])}")
        todo = [str(r["day"]) for r in plan if r["action"] == "process"]
        report.skipped = [str(r["day"]) for r in plan if r["action"] == "skip"]
        if todo:
            _process(spark, conf, todo, sources, report, now)
        report.processed = todo
        record("SUCCEEDED")
    except Exception as error:
        record("FAILED", str(error))
        raise
    return report


def _process(spark: SparkSession, conf: Conf, todo: list[str], sources: DataFrame, report: Report, now: str) -> None:
    hashes = sources.filter(F.col("day").cast("string").isin(todo)).select(F.col("day").cast("string").alias("departure_date"), F.col("sha").alias("source_content_sha256"), "bytes", "changed_at")
    landed_files, hashes = hashes, hashes.drop("bytes", "changed_at")
    raw = stage(feeds.read_trains(spark, [f"{conf.source}/{d}.json.gz" for d in todo]), "trains")
    quality, stamp = f"{conf.root}/control/quality", F.lit(now).cast("timestamp")
    first = feeds.gate_partitions(raw, todo).withColumn("run_id", F.lit(report.run_id))
    append(first, quality)
    require_pass(first, "bronze")
    counts = raw.groupBy(F.col("departureDate").alias("departure_date")).agg(F.count(F.lit(1)).alias("source_row_count"))
    landed = F.concat(F.lit(f"{conf.root}/bronze/trains/departure_date="), F.col("departure_date"), F.lit("/source_content_sha256="), F.col("source_content_sha256"))
    entries = landed_files.join(counts, "departure_date").select("departure_date", F.col("source_content_sha256").alias("content_sha256"), landed.alias("source_path"), "source_row_count", F.col("bytes").alias("source_bytes"), F.col("changed_at").alias("source_changed_at"), stamp.alias("ingested_at"), F.lit(report.run_id).alias("run_id"))
    insert_absent(entries, f"{conf.root}/control/manifest", ["departure_date", "content_sha256"])
    volume = volume_gates(spark.read.schema(MANIFEST).parquet(f"{conf.root}/control/manifest"), todo).withColumn("run_id", F.lit(report.run_id))
    append(volume, quality)
    # a folder is named for its content: to write it again changes nothing
    bronze = raw.join(bounded(hashes), F.col("departureDate") == F.col("departure_date")).drop("departureDate")
    bronze.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("departure_date", "source_content_sha256").parquet(f"{conf.root}/bronze/trains")
    require_pass(volume, "bronze")
    stations = feeds.read_stations(spark, conf.stations)
    journeys, arrivals = (stage(x, "silver") for x in rail.normalize(raw, stations, hashes, report.run_id, now))
    gates = silver_gates(raw, journeys, arrivals, stations).withColumn("run_id", F.lit(report.run_id))
    append(gates, quality)
    require_pass(gates, "silver")
    facts = rail.journey_fact(journeys)
    monotonic = gold_gates(facts).withColumn("run_id", F.lit(report.run_id))
    append(monotonic, quality)
    require_pass(monotonic, "gold")
    by_day = lambda df: df.withColumn("departure_date", F.col("departure_date").cast("string"))
    commit = hashes.select("departure_date", "source_content_sha256", F.lit(report.run_id).alias("committed_run_id"), stamp.alias("committed_at"))
    with Store(spark, conf.root).transaction() as t:
        for name, df in (("silver/journeys", journeys), ("silver/arrivals", arrivals), ("gold/facts", facts), ("gold/regional", rail.regional_daily(arrivals)), ("gold/network", rail.network_daily(facts))):
            t.replace_parts(name, by_day(df), "departure_date", todo)
        t.replace("gold/routes", rail.route_performance(t.read("gold/facts")))
        t.replace("gold/stations", rail.station_performance(t.read("silver/arrivals")))
        t.append(COMMITTED, commit)
