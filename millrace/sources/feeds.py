"""Readers of raw feeds, each with an explicit schema: inference would change with the day's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import stage

#: Categories of trains that carry passengers (fixed values).
PASSENGER = ("Long-distance", "Commuter")

EVENT = "struct<type string, stationShortCode string, countryCode string, commercialStop boolean, trainStopping boolean, cancelled boolean, scheduledTime string, actualTime string, liveEstimateTime string, differenceInMinutes int>"
TRAIN = f"trainNumber bigint, departureDate string, trainType string, trainCategory string, commuterLineID string, cancelled boolean, runningCurrently boolean, timeTableRows array<{EVENT}>"
STATION = "station_code string, station_name string, passenger_traffic boolean, country_code string, region_code string, latitude double, longitude double"
TRACE = "timestamp string, event string, trace_id string, model string, prompt_version string, tool_calls array<struct<name string, success boolean, latency_ms double>>, tool_failures array<string>, metrics struct<total_latency_ms double, fallback_used boolean>, _corrupt string"
WEATHER_PARAMETERS = ["t2m", "r_1h", "ws_10min", "vis"]


def read_trains(spark: SparkSession, paths: list[str] | str, partitions: int | None = None) -> DataFrame:
    """JSON arrays of trains. A compressed array is one task's work to read, so rows are dealt out right after."""
    df = spark.read.schema(TRAIN).option("multiLine", True).json(paths)
    return df.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def gate_partitions(trains: DataFrame, dates: list[str]) -> DataFrame:
    """(departure_date, check_name, status, observed) of the requested dates, from one aggregate: rows, dates that were
    not asked for, and at least one passenger train."""
    per = trains.groupBy("departureDate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trainCategory").isin(*PASSENGER)).alias("p"))
    asked = trains.sparkSession.createDataFrame([(d,) for d in dates], "departureDate string")
    rows = asked.withColumn("asked", F.lit(True)).join(per, "departureDate", "full_outer")
    checks = F.array(
        F.when(F.col("asked"), F.struct(F.lit("not_empty").alias("check_name"), F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("status"), F.coalesce("n", F.lit(0)).alias("observed"))),
        F.when(F.col("asked"), F.struct(F.lit("passenger_trains").alias("check_name"), F.when(F.col("p") > 0, "PASS").otherwise("FAIL").alias("status"), F.coalesce("p", F.lit(0)).alias("observed"))),
        F.when(F.col("asked").isNull(), F.struct(F.lit("unexpected_date").alias("check_name"), F.lit("FAIL").alias("status"), F.col("n").alias("observed"))),
    )
    return rows.select(F.coalesce("departureDate", F.lit("<missing>")).alias("departure_date"), F.inline(F.filter(checks, lambda x: x.isNotNull())))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object code -> station, as one row per station."""
    value = "struct<name string, passengerTraffic boolean, countryCode string, regionCode string, latitude double, longitude double>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("m"))
    s = raw.select(F.explode("m").alias("station_code", "s"))
    return s.select(
        "station_code", F.regexp_replace(F.coalesce("s.name", "station_code"), "(?i) asema$", "").alias("station_name"), F.coalesce("s.passengerTraffic", F.lit(False)).alias("passenger_traffic"),
        F.col("s.countryCode").alias("country_code"), F.col("s.regionCode").alias("region_code"), F.col("s.latitude").alias("latitude"), F.col("s.longitude").alias("longitude"),
    ).dropDuplicates(["station_code"])


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Long XML elements as wide observations; the last value wins per time, place and parameter."""
    schema = "Location struct<Point struct<pos string>>, Time string, ParameterName string, ParameterValue string"
    raw = spark.read.format("xml").option("rowTag", "BsWfsElement").option("ignoreNamespace", True).schema(schema).load(path)
    rows = raw.withColumn("order", F.monotonically_increasing_id()).select(F.split(F.trim("Location.Point.pos"), r"\s+").alias("pos"), F.to_timestamp("Time").alias("timestamp"), F.col("ParameterName").alias("name"), F.col("ParameterValue").try_cast("double").alias("value"), "order")
    rows = rows.select("timestamp", F.get("pos", F.lit(0)).try_cast("double").alias("latitude"), F.get("pos", F.lit(1)).try_cast("double").alias("longitude"), "name", "value", "order")
    good = rows.filter(F.col("name").isin(*WEATHER_PARAMETERS) & F.col("value").isNotNull() & ~F.isnan("value") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("timestamp").isNotNull())
    return good.groupBy("timestamp", "latitude", "longitude").pivot("name", WEATHER_PARAMETERS).agg(F.max_by("value", "order"))


def read_notice_pages(spark: SparkSession, path: str, notice: str, multiline: bool = True) -> DataFrame:
    """Landing pages {notices: [...]} as one row per notice; `notice` is the DDL of its struct. A file is a page, or a page a line."""
    return spark.read.schema(f"notices array<struct<{notice}>>").option("multiLine", multiline).json(path).select(F.inline("notices"))


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good trace lines, number of corrupt lines as one row)."""
    raw = spark.read.schema(TRACE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = stage(raw, "traces")  # a corrupt column can't be read alone
    return raw.filter("_corrupt is null").drop("_corrupt"), raw.agg(F.count("_corrupt").alias("corrupt_lines"))


def read_regions(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """GeoJSON features: code, name and polygons (polygon, ring, point, coordinate); single polygons become lists of one."""
    ring = "array<array<array<double>>>"
    multi = spark.read.option("multiLine", True).schema(f"features array<struct<properties struct<code string, name string>, geometry struct<type string, coordinates array<{ring}>>>>").json(path)
    single = spark.read.option("multiLine", True).schema(f"features array<struct<properties struct<code string, name string>, geometry struct<type string, coordinates {ring}>>>").json(path)
    pick = lambda df, kind, polygons: df.select(F.explode("features").alias("f")).filter(F.col("f.geometry.type") == kind).select("f.properties.code", "f.properties.name", polygons.alias("polygons"))
    out = pick(multi, "MultiPolygon", F.col("f.geometry.coordinates")).unionByName(pick(single, "Polygon", F.array("f.geometry.coordinates")))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} regions instead of {expected}")
    return out


#: The order tables and their columns, as DDL.
ORDER_TABLES = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp",
    "customers": "customer_id string, customer_state string, customer_zip_code_prefix int",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double",
    "products": "product_id string, product_category_name string, product_weight_g double, product_length_cm double, product_height_cm double, product_width_cm double",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_state string",
    "order_payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double",
    "category_translation": "product_category_name string, product_category_name_english string",
}


def read_order_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One CSV per table, by header; columns beyond the schema are not read."""
    out = {}
    for name, ddl in ORDER_TABLES.items():
        wanted = [c.split()[0] for c in ddl.split(", ")]
        types = dict(c.split() for c in ddl.split(", "))
        text = spark.read.option("header", True).csv(f"{folder}/{name}.csv")
        missing = set(wanted) - set(text.columns)
        if missing:
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        out[name] = text.select(*[F.col(c).try_cast(types[c]).alias(c) for c in wanted])
    return out


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, bytes, changed_at) of files; none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed_at"))


def fingerprint_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, bytes, sha256) of files, hashed by the tasks that read them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], schema)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of a folder's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_pins(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, status) of files (name, sha256) against pinned ones: same, changed, missing or unexpected."""
    both = files.select("name", F.col("sha256").alias("found")).join(pins.select("name", F.col("sha256").alias("pinned")), "name", "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("pinned").isNull(), "unexpected").when(F.col("found") == F.col("pinned"), "same").otherwise("changed")
    return both.select("name", status.alias("status"))


def require_pins(files: DataFrame, pins: DataFrame) -> None:
    """Raises if a pinned file is missing or has other content; files without a pin pass. There are as many rows as files."""
    wrong = sorted((r["name"], r["status"]) for r in compare_pins(files, pins).filter("status in ('missing', 'changed')").collect())
    if wrong:
        kind = FileNotFoundError if any(status == "missing" for _, status in wrong) else ValueError
        raise kind(", ".join(f"{name} is {status}" for name, status in wrong))
