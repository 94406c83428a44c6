"""Sources and sinks: daily files, partitions, payloads, grid, predictions, run log."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from emberline.operators import fanout, history, report, scoring, spatial
from emberline.plans import fixtures as fx
from emberline.plans import jobs
from emberline.session import local_table, scratch_dir
from emberline.sources import payloads as landed
from emberline.sources import sinks, weather

HEADER = ",".join(weather.DAILY_COLUMNS)


def daily_line(lat, lon, temperature, wind="3.0", rain="0.0"):
    values = {c: "" for c in weather.DAILY_COLUMNS}
    values.update(
        lat=lat, lon=lon, date="2024-06-01 12:00:00", nearest_station="Calgary", temperature=temperature,
        humidity="40", wind_speed=wind, rain_1h_mm=rain, timestamp_utc="1717264800",
    )
    return ",".join(str(values[c]) for c in weather.DAILY_COLUMNS)


@pytest.fixture
def folder(tmp_path):
    def put(name, *lines, header=HEADER):
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n")

    put("2024-06-01.csv", daily_line(50.0, -110.0, "20.5"))
    put("2024-06-02.csv", daily_line(50.0, -110.0, "n/a"), daily_line(50.5, -110.0, "NaN"))
    put("2024-06-03.csv", daily_line(50.0, -110.0, "19.0"), daily_line(50.5, -110.0, "warm"))
    put("2024-06-04.csv", daily_line(50.0, -110.0, "18.0"))
    return tmp_path


def test_bad_file_is_skipped_whole_and_missing_text_is_not_bad(spark, folder):
    rows = weather.load_history(spark, str(folder)).orderBy("file_date", "lat").collect()
    assert [(r["file_date"].day, r["lat"]) for r in rows] == [(1, 50.0), (2, 50.0), (2, 50.5), (4, 50.0)]
    assert rows[0]["temperature"] == 20.5 and rows[1]["temperature"] is None
    assert rows[0]["timestamp_utc"] == 1717264800
    raw = weather.read_daily_files(spark, weather.newest_files(spark, str(folder)))
    assert [r["file_name"] for r in weather.unreadable_files(raw).collect()] == ["2024-06-03.csv"]


def test_window_counts_files_before_bad_ones_are_skipped(spark, folder):
    assert [os.path.basename(p) for p in weather.newest_files(spark, str(folder), 2)] == ["2024-06-04.csv", "2024-06-03.csv"]
    assert weather.load_history(spark, str(folder), 2).count() == 1


def test_columns_by_name(spark, folder):
    (folder / "2024-06-05.csv").write_text("lon,lat,temperature\n-110.0,50.0,17.0\n")
    got = weather.load_history(spark, str(folder)).filter("file_date = '2024-06-05'").first()
    assert (got["lat"], got["lon"], got["temperature"], got["humidity"]) == (50.0, -110.0, 17.0, None)
    groups = weather.headers(spark, weather.newest_files(spark, str(folder)))
    assert sorted(len(paths) for paths in groups.values()) == [1, 4]


@pytest.mark.parametrize("text, sound", [("1d", False), ("17.0f", False), ("1e3", True), (" -.5 ", True), ("+7.", True), ("0x1", False), ("inf", True), ("1_0", False)])
def test_what_is_a_number(spark, folder, text, sound):
    (folder / "2024-06-06.csv").write_text(f"{HEADER}\n{daily_line(50.0, -110.0, text)}\n")
    assert (weather.load_history(spark, str(folder)).filter("file_date = '2024-06-06'").count() == 1) == sound


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        weather.load_history(spark, str(tmp_path / "empty"))


def test_day_is_replaced_and_others_are_kept(spark, sf, tmp_path):
    path = str(tmp_path / "daily")
    days = fx.wx_daily(spark, sf)
    sinks.write_daily(days, path)
    before = weather.read_history_table(spark, path)
    assert before.count() == days.count()
    changed = days.filter("file_date = '2024-01-05'").withColumn("temperature", F.lit(99.0)).limit(3)
    sinks.write_daily(changed, path)
    after = weather.read_history_table(spark, path)
    assert after.filter("file_date = '2024-01-05'").count() == 3
    assert after.filter("file_date <> '2024-01-05'").count() == days.filter("file_date <> '2024-01-05'").count()


def test_date_window_prunes_partitions(spark, sf, tmp_path, plan_of):
    path = str(tmp_path / "daily")
    sinks.write_daily(fx.wx_daily(spark, sf), path)
    window = history.newest_dates(weather.read_history_table(spark, path), 5)
    assert window.select("file_date").distinct().count() == 5
    partition_filters = plan_of(window).split("PartitionFilters: [")[1].split("]")[0]
    assert "file_date" in partition_filters and "ubquery" in partition_filters


def test_retention_keeps_the_newest_dates(spark, sf, tmp_path):
    days = fx.wx_daily(spark, sf)
    sinks.retain_latest(days, str(tmp_path / "kept"), 7)
    kept = weather.read_history_table(spark, str(tmp_path / "kept")).select("file_date").distinct()
    assert kept.count() == 7 and history.expired_dates(days, 7).intersect(kept).isEmpty()
    assert history.expired_dates(days, 7).count() == 23


def test_bucketed_history_is_gathered_without_a_shuffle(spark, sf, plan_of):
    days = fx.wx_daily(spark, sf)
    spark.sql("DROP TABLE IF EXISTS wx_history")
    sinks.create_history_table(days, "wx_history", 8)
    try:
        table = spark.table("wx_history")
        codes = history.accumulate_codes(table, 7)
        assert "Exchange" not in plan_of(codes)
        assert codes.exceptAll(history.accumulate_codes(days, 7)).isEmpty() and codes.count() == 15
        newest = days.filter("file_date = '2024-01-30'").withColumn("temperature", F.lit(30.0))
        sinks.replace_day(newest, "wx_history", datetime.date(2024, 1, 30), 8)
        spark.catalog.refreshTable("wx_history")
        table = spark.table("wx_history")
        assert table.count() == days.count() and table.filter("temperature = 30").count() >= newest.count()
        assert "Exchange" not in plan_of(history.accumulate_codes(table, 7))
        dropped = sinks.drop_expired(spark, "wx_history", 4)
        assert len(dropped) == 26 and spark.table("wx_history").select("file_date").distinct().count() == 4
        assert sinks.drop_expired(spark, "wx_history", 4) == []
    finally:
        spark.sql("DROP TABLE IF EXISTS wx_history")


def test_grid_and_mapping_round_trip(spark, sf, tmp_path):
    jobs.build_grid(spark, fx.fires(spark, sf), str(tmp_path / "grid"))
    grid = weather.read_grid(spark, str(tmp_path / "grid"))
    assert grid.agg(F.sum("historical_fire")).first()[0] == 372
    jobs.map_stations(spark, str(tmp_path / "map"), grid.withColumn("cell_id", F.monotonically_increasing_id()))
    assert weather.read_mapping(spark, str(tmp_path / "map")).count() == 14952
    assert weather.read_grid(spark, str(tmp_path / "nothing")) is None


def test_fire_reader_reads_only_what_is_used(spark, sf, tmp_path, plan_of):
    fx.fires(spark, sf).drop("fire_id").withColumn("rep_date", F.col("rep_date").cast("timestamp")).write.parquet(
        str(tmp_path / "fires")
    )
    stored = weather.read_fires(spark, str(tmp_path / "fires"))
    flagged = spatial.flag_fire_history(spatial.grid_cells(spark), stored)
    assert "ReadSchema: struct<latitude:double,longitude:double>" in plan_of(flagged)


PAYLOADS = {
    "full": {"main": {"temp": 1.5, "humidity": 30}, "rain": {"1h": 2}, "dt": 7, "weather": [{"main": "Rain", "description": "wet"}]},
    "null leaf": {"main": {"temp": None}, "visibility": None},
    "null object": {"rain": None, "weather": None},
    "number as text": {"main": {"temp": "12.5", "humidity": 44}},
    "no description": {"weather": [{"main": "Fog"}, {"main": "Rain"}]},
}


def test_payload_defaults(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 5)
    rows = [(name, at, json.dumps(p)) for name, p in PAYLOADS.items()] + [("broken", at, "{oops"), ("none", at, None)]
    flat = landed.flatten_payloads(spark.createDataFrame(rows, landed.LANDING_SCHEMA))
    got = {r["station"]: r for r in flat.collect()}
    assert sorted(set(got)) == sorted(set(PAYLOADS) | ({"none"} & set(got)))
    full = got["full"]
    assert (full["temperature"], full["humidity"], full["pressure"], full["rain_1h"], full["timestamp_utc"]) == (1.5, 30.0, 1013.0, 2.0, 7)
    assert (full["weather_main"], full["weather_description"]) == ("Rain", "wet")
    assert got["null leaf"]["temperature"] is None and got["null leaf"]["visibility"] is None
    assert got["null leaf"]["humidity"] == 50.0 and got["null leaf"]["timestamp_utc"] == 1704067205
    assert (got["null object"]["rain_1h"], got["null object"]["weather_main"]) == (0.0, "Unknown")
    assert (got["number as text"]["temperature"], got["number as text"]["humidity"]) == (12.5, 44.0)
    assert got["no description"]["weather_main"] == "Fog" and got["no description"]["weather_description"] is None


@pytest.mark.parametrize("text", [None, "", "null", "5", '"text"', '[{"main": {"temp": 1}}]', "{oops"])
def test_payload_that_is_no_object_counts_as_failed(spark, text):
    rows = spark.createDataFrame([("Calgary", None, text)], landed.LANDING_SCHEMA)
    assert landed.flatten_payloads(rows).isEmpty()


def test_empty_object_is_all_defaults(spark):
    rows = spark.createDataFrame([("Calgary", datetime.datetime(2024, 1, 1), "{}")], landed.LANDING_SCHEMA)
    assert landed.flatten_payloads(rows).first()["pressure"] == 1013.0


def test_run_without_weather_stops(spark):
    mapping = local_table(spark, [(50.0, -110.0, "Calgary")], "lat double, lon double, nearest_station_name string")
    rows = spark.createDataFrame([("Calgary", None, "{oops"), ("Atlantis", None, "{}")], landed.LANDING_SCHEMA)
    with pytest.raises(RuntimeError):
        jobs.run_weather(mapping, jobs.latest_weather(spark, rows))


def test_cells_without_position_are_no_station(spark):
    mapping = local_table(
        spark, [(50.0, -110.0, "Calgary"), (None, None, None)], "lat double, lon double, nearest_station_name string"
    )
    at = datetime.datetime(2024, 1, 1)
    rows = fanout.with_run(spark.createDataFrame([("Calgary", at), ("Atlantis", at)], "station string, fetched_at timestamp"))
    assert tuple(fanout.fetch_summary(mapping, rows).first()) == (1, 1, 0)
    assert tuple(fanout.run_summaries(mapping, rows, rows).first()) == (at, 1, 1, 0)


def test_fan_out_fills_failed_stations_with_null(spark):
    mapping = local_table(
        spark, [(50.0, -110.0, "Calgary"), (51.0, -110.0, "Regina")], "lat double, lon double, nearest_station_name string"
    )
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [("Calgary", at, '{"main":{"temp":1}}'), ("Calgary", at + datetime.timedelta(hours=1), '{"main":{"temp":2}}')],
        landed.LANDING_SCHEMA,
    )
    got = {r["nearest_station"]: r for r in jobs.run_weather(mapping, jobs.latest_weather(spark, rows)).collect()}
    assert got["Calgary"]["temperature"] == 2.0 and got["Regina"]["temperature"] is None
    assert set(landed.WEATHER_COLUMNS) <= set(got["Regina"].asDict())


def test_refresh_end_to_end(spark, sf, tmp_path):
    """Two runs on one day and one on the next; then predictions, document, stats and log."""
    mapping = (
        spatial.nearest_station(spatial.grid_cells(spark).filter("cell_id % 101 = 0"), spatial.stations(spark))
        .select("lat", "lon", "nearest_station_name")
    )
    grid = spatial.grid_cells(spark).withColumn("historical_fire", F.lit(1))
    names = [s["name"] for s in spatial.stations(spark).collect()]
    history_path, out = str(tmp_path / "weather"), str(tmp_path / "out")

    def run(day, hour, temp):
        at = datetime.datetime(2024, 7, day, hour)
        rows = [(n, at, json.dumps({"main": {"temp": temp + i}, "dt": 1})) for i, n in enumerate(names)]
        return jobs.refresh(
            spark, spark.createDataFrame(rows, landed.LANDING_SCHEMA), mapping, grid, history_path, out,
            at.date(), str(at), str(at),
        )

    run(1, 6, 10.0)
    run(1, 18, 20.0)
    stats = run(2, 6, -1.0).first()
    stored = weather.read_history_table(spark, history_path)
    assert stored.count() == 2 * mapping.count()
    assert stored.filter("file_date = '2024-07-01' AND nearest_station = 'Vancouver'").first()["temperature"] == 20.0
    # Vancouver reported -1 on the last day: its cells are rejected and counted.
    bad = mapping.filter("nearest_station_name = 'Vancouver'").count()
    assert stats["total_locations"] == mapping.count() and stats["processing_errors"] == bad
    predictions = weather.read_predictions(spark, f"{out}/predictions/parquet")
    assert predictions.count() == stats["processed_successfully"] == mapping.count() - bad
    row = predictions.filter("location_name = 'Calgary'").first()
    assert row["weather_features"]["temperature"] == 2.0 and row["weather_features"]["pressure"] == 1013.0
    lines = spark.read.json(f"{out}/predictions/json")
    assert lines.count() == predictions.count() and "fire_weather_indices" in lines.columns
    log = spark.read.parquet(f"{out}/run_log")
    assert log.count() == 3
    assert report.training_records(log).first()[0] == stats["processed_successfully"]
    envelope = spark.read.json(f"{out}/envelope").first()
    assert envelope["success"] is True and envelope["processing_stats"]["total_locations"] == stats["total_locations"]
    soon = datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(minutes=30)
    stored_predictions = spark.read.parquet(f"{out}/predictions/parquet")
    for later, status in ((0, "healthy"), (3, "degraded"), (30, "unhealthy")):
        as_of = (soon + datetime.timedelta(hours=later)).strftime("%Y-%m-%d %H:%M:%S")
        rows = {r["component"]: r for r in jobs.health(spark, stored, stored_predictions, as_of).collect()}
        assert {r["status"] for r in rows.values()} == {r["overall_status"] for r in rows.values()} == {status}
        assert rows["Weather Data"]["n_dates"] == 2 and rows["Weather Data"]["n_rows"] == stored.count()

    absent = jobs.health(spark, None, None, "2024-07-02 06:00:00").collect()
    assert {(r["freshness"], r["status"], r["n_rows"]) for r in absent} == {("missing", "unhealthy", 0)}
    assert weather.read_result(spark, out).count() == predictions.count()
    spark.range(1).selectExpr("false AS success").write.mode("overwrite").json(f"{out}/envelope")
    with pytest.raises(ValueError):
        weather.read_result(spark, out)


def test_snapshot_written_last(spark):
    rows = spark.createDataFrame(
        [(datetime.date(2024, 1, 1), 9), (datetime.date(2024, 1, 2), 5)], "file_date date, written int"
    )
    assert history.latest_snapshot(rows).first()["written"] == 5
    assert history.latest_snapshot(rows, "written").first()["file_date"] == datetime.date(2024, 1, 1)


def test_the_46th_day_drops_the_first(spark, sf, tmp_path):
    path = str(tmp_path / "history")
    first = datetime.date(2024, 1, 1)
    days = spark.range(46).selectExpr("50.0D AS lat", "-110.0D AS lon", f"date_add(DATE'{first}', cast(id AS int)) AS file_date", "20.0D AS temperature")
    sinks.write_daily(days, path)
    assert sinks.prune_history(spark, path) == [first]
    kept = sorted(weather.partition_dates(spark, path))
    assert len(kept) == 45 and kept[0] == datetime.date(2024, 1, 2)
    assert sinks.prune_history(spark, path) == [] and weather.read_window(spark, path).count() == 45


def test_the_window_opens_no_other_file(spark, sf, tmp_path):
    path = str(tmp_path / "history")
    sinks.write_daily(fx.wx_daily(spark, sf), path)
    dates = sorted(weather.partition_dates(spark, path))
    window = weather.read_window(spark, path, 5)
    scored = scoring.predictions(window, 7, bounds=(F.lit(dates[-5]), F.lit(dates[-1])))
    # From here on a file of an older date ends any query that opens it.
    for day in dates[:-5]:
        for name in os.listdir(f"{path}/file_date={day}"):
            with open(f"{path}/file_date={day}/{name}", "w") as file:
                file.write("no parquet")
    assert window.count() > 0 and scored.count() > 0
    with pytest.raises(Exception):
        spark.read.schema(window.schema).parquet(path).select("temperature").collect()


def test_scoring_reads_the_history_once(spark, sf, tmp_path, plan_of):
    path = str(tmp_path / "history")
    sinks.write_daily(fx.wx_daily(spark, sf), path)
    history_rows = weather.read_history_table(spark, path)
    bounds = (F.lit(datetime.date(2024, 1, 1)), F.lit(datetime.date(2024, 1, 30)))
    plan = plan_of(scoring.predictions(history_rows, 7, bounds=bounds))
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_an_earlier_snapshot_can_be_scored(spark, sf, tmp_path):
    path, out = str(tmp_path / "history"), str(tmp_path / "out")
    sinks.write_daily(fx.wx_daily(spark, sf).drop("cell_id", "event_id").dropDuplicates(["lat", "lon", "file_date"]), path)
    day = sorted(weather.partition_dates(spark, path))[-3]
    jobs.score_stored(spark, path, None, out, "2024-02-01 00:00:00", as_of=day)
    expected = weather.read_history_table(spark, path).filter(F.col("file_date") == F.lit(day)).count()
    assert spark.read.parquet(f"{out}/scored").count() == expected
    with pytest.raises(ValueError):
        jobs.score_stored(spark, path, None, out, "x", as_of=datetime.date(1999, 1, 1))


def test_broken_last_payload_hides_no_good_one(spark):
    at = lambda minute: datetime.datetime(2024, 6, 1, 6, minute)
    rows = [("Calgary", at(0), '{"main":{"temp":7}}'), ("Calgary", at(5), "{oops"), ("Regina", at(1), "[1]")]
    payloads = spark.createDataFrame(rows, landed.LANDING_SCHEMA)
    assert [(r["station"], r["temperature"]) for r in jobs.latest_weather(spark, payloads).collect()] == [("Calgary", 7.0)]
    rejects = landed.unreadable_payloads(payloads).collect()
    assert sorted((r["station"], r["reject_reason"]) for r in rejects) == [("Calgary", "payload_no_json"), ("Regina", "payload_no_object")]


def test_empty_predictions_are_an_error(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        weather.read_predictions(spark, str(tmp_path / "p"))


def test_prediction_filters_reach_the_scan(spark, sf, tmp_path, plan_of):
    sinks.write_predictions(scoring.accepted(scoring.predictions(fx.wx_daily(spark, sf), 7)), str(tmp_path / "p"))
    stored = weather.read_predictions(spark, str(tmp_path / "p/parquet"))
    plan = plan_of(stored.filter("daily_fire_risk > 0.5").select("location_name", "weather_features.is_hot"))
    assert "GreaterThan(daily_fire_risk,0.5)" in plan
    assert "ReadSchema: struct<location_name:string,daily_fire_risk:double,weather_features:struct<is_hot:int>>" in plan


class FakeSession:
    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_scratch_folder_comes_from_the_session(spark):
    shared = FakeSession(spark_checkpoint_dir="hdfs://shared/", spark_master="yarn")
    assert scratch_dir(shared, "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError):
        scratch_dir(FakeSession(spark_master="yarn"), "x")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
