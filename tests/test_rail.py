"""Train feeds, normalisation, marts and the incremental lakehouse on small fixtures."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import geo, metrics
from millrace.plans import lakehouse, rail
from millrace.sources import feeds


def event(kind, code, at, late=None, actual=None, **more):
    return {"type": kind, "stationShortCode": code, "countryCode": "FI", "commercialStop": True, "trainStopping": True, "cancelled": False, "scheduledTime": at, "actualTime": actual, "differenceInMinutes": late} | more


def train(number, events, day="2026-07-31", **more):
    return {"trainNumber": number, "departureDate": day, "trainType": "IC", "trainCategory": "Long-distance", "commuterLineID": "", "cancelled": False, "timeTableRows": events} | more


def base(number=1, day="2026-07-31", **more):
    return train(number, [event("DEPARTURE", "HKI", f"{day}T08:00:00Z", 2), event("ARRIVAL", "LH", f"{day}T09:00:00Z", 12)], day, **more)


@pytest.fixture(scope="module")
def stations(spark):
    rows = [("HKI", "Helsinki", True, "FI", "01", 60.2, 24.9), ("LH", "Lahti", True, "FI", "07", 61.0, 25.7), ("ILR", "Ilmala depot", False, "FI", "01", 60.2, 24.9)]
    return spark.createDataFrame(rows, feeds.STATION)


def frame(spark, trains):
    return spark.read.schema(feeds.TRAIN).json(spark.sparkContext.parallelize([json.dumps(t) for t in trains]))


def normal(spark, stations, trains):
    hashes = spark.createDataFrame([("2026-07-31", "abc")], "departure_date string, source_content_sha256 string")
    return rail.normalize(frame(spark, trains), stations, hashes, "r", "2026-08-01 00:00:00")


def test_base_train(spark, stations):
    journeys, arrivals = normal(spark, stations, [base()])
    row = rail.journey_fact(journeys).first()
    assert (row.final_delay_minutes, row.on_time_5, row.on_time_15, row.route_key, row.source_content_sha256) == (12, False, True, "HKI--LH", "abc")
    assert [(a.station_code, a.delay_minutes) for a in arrivals.collect()] == [("LH", 12)]


def test_depot_missing_flags_and_local_hour(spark, stations):
    t = train(5, [event("DEPARTURE", "HKI", "2026-01-15T21:30:00Z"), event("ARRIVAL", "LH", "2026-01-15T22:30:00Z", cancelled=None), event("ARRIVAL", "ILR", "2026-01-15T23:00:00Z", 20)], cancelled=None)
    row = normal(spark, stations, [t])[0].first()
    assert (row.departure_hour, row.final_delay_minutes, row.destination_code, row.cancelled, row.partial_cancelled) == (23, None, "LH", False, False)


def test_delay_is_rounded_half_to_even(spark, stations):
    t = [train(n, [event("DEPARTURE", "HKI", "2026-07-31T08:00:00Z"), event("ARRIVAL", "LH", "2026-07-31T09:00:00Z", None, f"2026-07-31T09:0{m}:30Z")]) for n, m in ((1, 2), (2, 3))]
    got = {r.train_number: r.final_delay_minutes for r in normal(spark, stations, t)[0].collect()}
    assert got == {1: 2, 2: 4}


def test_segment_in_longer_train(spark):
    t = train(9, [event("ARRIVAL", "LH", "2026-07-31T07:55:00Z", 1), event("DEPARTURE", "LH", "2026-07-31T08:00:00Z", 2), event("ARRIVAL", "HKI", "2026-07-31T09:00:00Z", 8)])
    row = rail.ordered_pair(frame(spark, [t]), "HKI", "LH").first()
    assert (row.direction, row.arrival_delay, row.departure_delay) == ("LH-HKI", 8, 2)


def test_weather_within_tolerance(spark):
    segments = spark.createDataFrame([(1, "HKI", "2026-01-15 10:40:00"), (2, "HKI", "2026-01-15 10:46:00"), (3, "LH", "2026-01-15 10:00:00")], "id int, station string, ts string").select("id", "station", F.col("ts").cast("timestamp").alias("scheduled_departure"))
    weather = spark.createDataFrame([("HKI", "2026-01-15 10:00:00", -4.2)], "station string, ts string, t2m double").select("station", F.col("ts").cast("timestamp").alias("timestamp"), "t2m", *[F.lit(None).cast("double").alias(c) for c in ("r_1h", "ws_10min", "vis")])
    rows = rail.attach_weather(segments, weather)
    assert {r.id: r.t2m for r in rows.collect()} == {1: -4.2, 2: None, 3: None}
    labels = {(r.id, r.label) for r in metrics.overlapping(rows, rail.weather_conditions()).collect()}
    assert labels == {(1, "all"), (1, "freezing"), (2, "all"), (2, "none"), (3, "all"), (3, "none")}


def test_weather_xml(spark, tmp_path):
    element = lambda name, value: f"<B:BsWfsElement><B:Location><g:Point><g:pos>60.2 24.9</g:pos></g:Point></B:Location><B:Time>2026-01-15T10:00:00Z</B:Time><B:ParameterName>{name}</B:ParameterName><B:ParameterValue>{value}</B:ParameterValue></B:BsWfsElement>"
    (tmp_path / "w.xml").write_text('<w:FeatureCollection xmlns:w="w" xmlns:B="b" xmlns:g="g">' + element("t2m", "1") + element("t2m", "-4.2") + element("vis", "NaN") + element("other", "3") + "</w:FeatureCollection>")
    rows = feeds.read_weather(spark, str(tmp_path)).collect()
    assert [(r.t2m, r.vis, r.latitude) for r in rows] == [(-4.2, None, 60.2)]


def test_reliability_fixture(spark):
    df = spark.createDataFrame([(0, False), (5, False), (6, False), (31, False), (None, True)], "delay int, cancelled boolean")
    r = metrics.reliability(df, []).first()
    assert (r.scheduled, r.completed, r.on_time_5, r.on_time_rate_5, r.cancelled_rate) == (5, 4, 2, 0.5, 0.2)


def test_polygon_with_hole(spark):
    square = lambda a, b: [[float(a), float(a)], [float(b), float(a)], [float(b), float(b)], [float(a), float(b)], [float(a), float(a)]]
    regions = spark.createDataFrame([("01", [[square(0, 10), square(4, 6)]])], "code string, polygons array<array<array<array<double>>>>")
    points = spark.createDataFrame([(2.0, 2.0), (5.0, 5.0), (12.0, 5.0)], "longitude double, latitude double")
    assert {(r.longitude, r.region_code) for r in geo.assign_regions(points, regions).collect()} == {(2.0, "01"), (5.0, None), (12.0, None)}
    assert regions.select(geo.ring_area(F.col("polygons")[0][0]).alias("a")).first().a == 100.0


@pytest.mark.parametrize("trains,check", [([], "not_empty"), ([base(trainCategory="Cargo")], "passenger_trains"), ([base(day="2026-07-30")], "unexpected_date")])
def test_bronze_gate(spark, trains, check):
    rows = feeds.gate_partitions(frame(spark, trains), ["2026-07-31"]).collect()
    assert check in {r.check_name for r in rows if r.status == "FAIL"}


def test_business_days(spark):
    df = spark.createDataFrame([("2026-01-02", "2026-01-12"), ("2026-01-03", "2026-01-04")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    rows = df.select(C.business_days("a", "b").alias("n"), C.holidays_between("a", "b").alias("h")).collect()
    assert [(r.n, r.h) for r in rows] == [(7, 0), (0, 0)]


@pytest.fixture
def conf(tmp_path):
    (tmp_path / "landing").mkdir()
    named = {"HKI": {"name": "Helsinki asema", "passengerTraffic": True, "countryCode": "FI", "regionCode": "01"}, "LH": {"name": "Lahti", "passengerTraffic": True, "countryCode": "FI", "regionCode": "07"}}
    (tmp_path / "stations.json").write_text(json.dumps(named))
    return lakehouse.Conf(str(tmp_path / "landing"), str(tmp_path / "stations.json"), str(tmp_path / "lake"))


def land(conf, day, trains):
    with gzip.open(f"{conf.source}/{day}.json.gz", "wt") as f:
        json.dump(trains, f)


def test_lakehouse_skips_replaces_and_forces(spark, conf):
    land(conf, "2026-07-30", [base(1, "2026-07-30")])
    land(conf, "2026-07-31", [base(1), base(2)])
    days = ("2026-07-30", "2026-07-31")
    assert lakehouse.run(spark, conf, *days, "2026-08-01 01:00:00").processed == list(days)
    again = lakehouse.run(spark, conf, *days, "2026-08-01 02:00:00")
    assert (again.processed, again.skipped) == ([], list(days))
    land(conf, "2026-07-31", [base(1), base(2), base(3)])
    assert lakehouse.run(spark, conf, *days, "2026-08-01 03:00:00").processed == ["2026-07-31"]
    facts = lakehouse.table(spark, conf, "gold/facts")
    assert {(str(r.departure_date), r.n) for r in facts.groupBy("departure_date").agg(F.count(F.lit(1)).alias("n")).collect()} == {("2026-07-30", 1), ("2026-07-31", 3)}
    assert lakehouse.table(spark, conf, "gold/routes").first().scheduled == 4
    assert lakehouse.run(spark, conf, *days, "2026-08-01 04:00:00", force=True).processed == list(days)
    assert lakehouse.table(spark, conf, "gold/network").count() == 2
    assert lakehouse.table(spark, conf, "gold/facts", ["2026-07-31"]).count() == 3
    assert len(facts.inputFiles()) == 2  # a frame from before the last run still reads its files
    assert facts.count() == 4


def test_lakehouse_rejects_duplicates_and_keeps_the_watermark(spark, conf):
    land(conf, "2026-07-31", [base(1), base(1)])
    with pytest.raises(ValueError, match="duplicate_source_business_keys"):
        lakehouse.run(spark, conf, "2026-07-31", "2026-07-31", "2026-08-01 01:00:00")
    assert lakehouse.watermark(spark, conf).count() == 0
    assert spark.read.parquet(f"{conf.root}/control/runs").first().status == "FAILED"
    with pytest.raises(FileNotFoundError):
        lakehouse.run(spark, conf, "2026-08-01", "2026-08-01", "2026-08-01 01:00:00")


def quality_of(spark, conf, check):
    return [r.status for r in spark.read.parquet(f"{conf.root}/control/quality").filter(F.col("check_name") == check).orderBy("departure_date").collect()]


def test_lakehouse_keeps_a_manifest(spark, conf):
    land(conf, "2026-07-31", [base(1), base(2)])
    day = ("2026-07-31", "2026-07-31")
    first = lakehouse.run(spark, conf, *day, "2026-08-01 01:00:00")
    lakehouse.run(spark, conf, *day, "2026-08-01 02:00:00", force=True)
    rows = spark.read.parquet(f"{conf.root}/control/manifest").collect()
    assert [(r.departure_date, r.source_row_count, r.run_id) for r in rows] == [("2026-07-31", 2, first.run_id)]
    assert spark.read.parquet(f"{conf.root}/bronze/trains").count() == 2
    land(conf, "2026-07-31", [base(1)])
    lakehouse.run(spark, conf, *day, "2026-08-01 03:00:00")
    assert sorted(r.source_row_count for r in spark.read.parquet(f"{conf.root}/control/manifest").collect()) == [1, 2]
    assert quality_of(spark, conf, "metric_monotonicity") == ["PASS"] * 3


def test_lakehouse_rejects_gold_that_is_not_monotonic(spark, conf, monkeypatch):
    land(conf, "2026-07-31", [base(1)])
    fact = rail.journey_fact
    monkeypatch.setattr(rail, "journey_fact", lambda journeys: fact(journeys).withColumn("on_time_5", F.lit(True)))
    with pytest.raises(ValueError, match="metric_monotonicity"):
        lakehouse.run(spark, conf, "2026-07-31", "2026-07-31", "2026-08-01 01:00:00")
    assert lakehouse.watermark(spark, conf).count() == 0 and quality_of(spark, conf, "metric_monotonicity") == ["FAIL"]
    assert spark.read.parquet(f"{conf.root}/control/runs").first().status == "FAILED"


def test_lakehouse_rejects_a_date_of_few_rows(spark, conf):
    for d in range(20, 28):
        land(conf, f"2026-07-{d}", [base(n, f"2026-07-{d}") for n in range(1, 12)])
    lakehouse.run(spark, conf, "2026-07-20", "2026-07-27", "2026-08-01 01:00:00")
    land(conf, "2026-07-28", [base(1, "2026-07-28")])
    with pytest.raises(ValueError, match="row_count_anomaly"):
        lakehouse.run(spark, conf, "2026-07-28", "2026-07-28", "2026-08-01 02:00:00")
    assert lakehouse.watermark(spark, conf).count() == 8


def test_route_grain(spark, stations):
    there, back = base(1), train(2, [event("DEPARTURE", "LH", "2026-07-31T10:00:00Z", 2), event("ARRIVAL", "HKI", "2026-07-31T11:00:00Z", 4)])
    rows = rail.route_performance(rail.journey_fact(normal(spark, stations, [there, back])[0])).collect()
    assert {(r.route_key, r.origin_code, r.destination_code, r.scheduled) for r in rows} == {("HKI--LH", "HKI", "LH", 1), ("HKI--LH", "LH", "HKI", 1)}


def test_a_run_that_stops_between_writes_changes_nothing(spark, conf, monkeypatch):
    from millrace.sources import commits

    tables = {"silver/journeys": 1, "silver/arrivals": 1, "gold/facts": 1, "gold/regional": 4, "gold/network": 1, "gold/routes": 1, "gold/stations": 1}
    day = ("2026-07-31", "2026-07-31")
    land(conf, "2026-07-31", [base(1)])
    lakehouse.run(spark, conf, *day, "2026-08-01 01:00:00")
    seen = lambda: {name: sorted(map(str, lakehouse.table(spark, conf, name).collect())) for name in tables} | {"watermark": lakehouse.watermark(spark, conf).collect()}
    before = seen()
    assert {name: len(before[name]) for name in tables} == tables
    land(conf, "2026-07-31", [base(1), base(2)])
    for method in ("replace_parts", "replace", "append", "commit"):
        own = getattr(commits.Transaction, method)
        for stop_at in {"replace_parts": (0, 4), "replace": (1,)}.get(method, (0,)):
            calls = []

            def failing(self, *args, own=own, stop_at=stop_at, calls=calls, **more):
                calls.append(1)
                if len(calls) == stop_at + 1:
                    raise OSError("stopped")
                return own(self, *args, **more)

            monkeypatch.setattr(commits.Transaction, method, failing)
            with pytest.raises(OSError, match="stopped"):
                lakehouse.run(spark, conf, *day, "2026-08-01 02:00:00")
            monkeypatch.undo()
            assert seen() == before
    assert lakehouse.run(spark, conf, *day, "2026-08-01 03:00:00").processed == ["2026-07-31"]
    assert lakehouse.table(spark, conf, "gold/facts").count() == 2


def test_planning_opens_only_what_it_has_to(spark, conf, monkeypatch):
    opened = []
    own = feeds.fingerprint_paths
    monkeypatch.setattr(feeds, "fingerprint_paths", lambda spark, paths: opened.append([p[-18:-8] for p in paths]) or own(spark, paths))
    for d in range(1, 29):
        land(conf, f"2026-07-{d:02}", [base(1, f"2026-07-{d:02}")])
    day = ("2026-07-14", "2026-07-14")
    lakehouse.run(spark, conf, *day, "2026-08-01 01:00:00")
    lakehouse.run(spark, conf, *day, "2026-08-01 02:00:00")
    land(conf, "2026-07-14", [base(1, "2026-07-14"), base(2, "2026-07-14")])
    assert lakehouse.run(spark, conf, *day, "2026-08-01 03:00:00").processed == ["2026-07-14"]
    lakehouse.run(spark, conf, *day, "2026-08-01 04:00:00", force=True)
    assert opened == [["2026-07-14"], [], ["2026-07-14"], ["2026-07-14"]]
