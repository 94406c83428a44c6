"""Streams against the batch plans: order of arrival, late data, trimming, replays."""

import datetime
import json

import pytest

from emberline.operators import history, spatial
from emberline.functions import fwi
from emberline import session
from emberline.plans import catalog
from emberline.plans import fixtures as fx
from emberline.session import local_table
from emberline.sources import payloads as landed
from emberline.sources import weather
from emberline.streaming import ingest, state

SCHEMA = "cell_id bigint, file_date date, seq bigint, temperature double, humidity double, wind_speed double, rain_1h_mm double"


def run_stream(spark, source, out, checkpoint, window=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    state.start_window_stream(state.day_inputs(stream, "seq"), out, checkpoint, window=window).awaitTermination()


def batch(rows, window):
    daily = history.last_per_day(history.newest_dates(rows, window), ["seq"])
    return fwi.with_fire_indices(history.accumulate_codes(daily, 7))


def assert_same(spark, out, rows, window):
    got = state.codes_of_days(state.current_days(spark, out, window), 7)
    expected = batch(rows, window).select(*got.columns)
    got, expected = (sorted(map(tuple, df.collect())) for df in (got, expected))
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-12)


@pytest.mark.parametrize("window", [45, 6])
def test_shuffled_arrival_equals_batch(spark, sf, tmp_path, window):
    rows = fx.wx_events(spark, sf).selectExpr(
        "cell_id", "file_date", "event_id AS seq", "temperature", "humidity", "wind_speed", "rain_1h_mm"
    )
    source = str(tmp_path / "in")
    # Four files in hash order: later files bring earlier days and earlier snapshots.
    rows.repartition(4, "seq").write.parquet(source)
    run_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert_same(spark, str(tmp_path / "out"), rows, window)


def test_state_survives_a_restart_and_drops_what_is_too_old(spark, tmp_path):
    first = datetime.date(2024, 6, 1)
    day = lambda n: first + datetime.timedelta(n)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def land(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, source, out, checkpoint, window=3)

    land(*[(1, day(n), n, 20.0 + n, 40.0, 5.0, 0.0) for n in range(3)])
    land((1, day(3), 10, 25.0, 40.0, 5.0, 0.0))
    # Late but within the window; then too old; then an outdated and a newer snapshot of a day.
    land((1, day(2), 11, 30.0, 30.0, 9.0, 0.0), (1, day(0), 12, 50.0, 1.0, 50.0, 0.0))
    land((1, day(3), 9, -5.0, 90.0, 1.0, 9.0), (1, day(2), 13, 31.0, 30.0, 9.0, 0.0))
    days = state.current_days(spark, out, 3).orderBy("file_date").collect()
    assert [row["temperature"] for row in days] == [21.0, 31.0, 25.0]
    assert sorted(weather.partition_dates(spark, out)) == [day(1), day(2), day(3)]
    assert_same(spark, out, spark.read.schema(SCHEMA).parquet(source), 3)
    land((1, day(4), 14, 12.0, 40.0, 5.0, 0.0), (2, day(4), 15, 12.0, 40.0, 5.0, 0.0))
    assert_same(spark, out, spark.read.schema(SCHEMA).parquet(source), 3)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.date(2024, 6, 1), 1, 20.0, 40.0, 5.0, 0.0)], SCHEMA)
    for _ in range(2):
        state.upsert_days(spark, state.day_inputs(rows, "seq"), str(tmp_path / "out"))
    assert state.current_days(spark, str(tmp_path / "out")).count() == 1


def test_no_python_in_the_window_stream(spark, plan_of):
    rows = spark.createDataFrame([(1, datetime.date(2024, 6, 1), 1, 20.0, 40.0, 5.0, 0.0)], SCHEMA)
    plan = plan_of(state.codes_of_days(history.last_per_day(state.day_inputs(rows, "seq"), ["seq"]), 7))
    assert "Python" not in plan and "Pandas" not in plan


def ingest_in_order(spark, tmp_path, name, payloads):
    """One file, hence one micro-batch, per payload in the given order."""
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True)
    mapping = local_table(
        spark, [(50.0, -110.0, "Calgary"), (51.0, -110.0, "Regina")], "lat double, lon double, nearest_station_name string"
    )
    for number, (station, at, payload) in enumerate(payloads):
        line = json.dumps({"station": station, "fetched_at": at, "payload": payload})
        (folder / "in" / f"{number}.json").write_text(line)
        stream = landed.stream_payloads(spark, str(folder / "in"), files_per_batch=1)
        ingest.start_ingest(stream, mapping, str(folder / "daily"), str(folder / "cp")).awaitTermination()
    rows = weather.read_history_table(spark, str(folder / "daily")).collect()
    return {(r["file_date"].day, r["nearest_station"]): r["temperature"] for r in rows}


def test_stations_and_times_in_any_order_of_micro_batches(spark, tmp_path):
    temp = lambda value: {"main": {"temp": value}}
    payloads = [
        ("Calgary", "2024-06-01T12:10:00Z", temp(25)),
        ("Regina", "2024-06-01T12:20:00Z", temp(2)),
        ("Calgary", "2024-06-01T06:00:00Z", temp(5)),
        ("Regina", "2024-06-01T12:30:00Z", "broken"),
        ("Calgary", "2024-06-01T12:05:00Z", temp(24)),
    ]
    expected = {(1, "Calgary"): 25.0, (1, "Regina"): 2.0}
    assert ingest_in_order(spark, tmp_path, "forth", payloads) == expected
    assert ingest_in_order(spark, tmp_path, "back", payloads[::-1]) == expected


def test_ingest_replaces_the_day_with_each_run(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "daily", "cp"))
    (tmp_path / "in").mkdir()
    mapping = local_table(
        spark, [(50.0, -110.0, "Calgary"), (51.0, -110.0, "Regina")], "lat double, lon double, nearest_station_name string"
    )

    def run(number, *payloads):
        lines = [json.dumps({"station": s, "fetched_at": at, "payload": p}) for s, at, p in payloads]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))
        ingest.start_ingest(landed.stream_payloads(spark, source), mapping, path, checkpoint).awaitTermination()

    def stored():
        rows = weather.read_history_table(spark, path).collect()
        return {(r["file_date"].day, r["nearest_station"]): r["temperature"] for r in rows}

    run(1, ("Calgary", "2024-06-01T06:00:00Z", {"main": {"temp": 1}}), ("Regina", "2024-06-01T06:00:00Z", {"main": {"temp": 2}}))
    assert stored() == {(1, "Calgary"): 1.0, (1, "Regina"): 2.0}
    run(2, ("Calgary", "2024-06-01T07:00:00Z", {"main": {"temp": 3}}), ("Atlantis", "2024-06-01T07:00:00Z", {}))
    assert stored() == {(1, "Calgary"): 3.0, (1, "Regina"): None}
    run(3, ("Regina", "2024-06-02T07:00:00Z", {"main": {}}))
    assert stored() == {(1, "Calgary"): 3.0, (1, "Regina"): None, (2, "Calgary"): None, (2, "Regina"): 15.0}
    run(4, ("Atlantis", "2024-06-03T07:00:00Z", {}))
    assert len(stored()) == 4


def test_whole_grid_ingest(spark, tmp_path):
    mapping = spatial.nearest_station(spatial.grid_cells(spark), spatial.stations(spark)).select(
        "lat", "lon", "nearest_station_name"
    )
    (tmp_path / "in").mkdir()
    names = [s["name"] for s in spatial.stations(spark).collect()]
    lines = [
        json.dumps({"station": n, "fetched_at": "2024-06-01T06:00:00Z", "payload": {"main": {"temp": i}}})
        for i, n in enumerate(names)
    ]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    stream = landed.stream_payloads(spark, str(tmp_path / "in"))
    ingest.start_ingest(stream, mapping, str(tmp_path / "daily"), str(tmp_path / "cp")).awaitTermination()
    daily = weather.read_history_table(spark, str(tmp_path / "daily"))
    assert daily.count() == 14952 and daily.filter("temperature IS NULL").isEmpty()


def test_late_payloads_are_written_by_every_task(spark, sf, tmp_path):
    """Not all of them by one task; as many files, each half still one micro-batch."""
    fx.table(spark, sf, "events").repartition(3, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    rows = {(r.file_date, r.outcome): r.n_payloads for r in catalog.late_payloads(spark, str(tmp_path)).collect()}
    (path,) = [name for name in session._scratch[-1:] if "/late-" in name]
    assert len(spark.read.text(f"{path}/landed").inputFiles()) == 6
    assert rows[None, "repeated"] > 0 and rows[None, "late"] > 0
    whole = fx.table(spark, sf, "events").count()
    assert sum(n for (day, _), n in rows.items() if day) + rows[None, "late"] >= whole
