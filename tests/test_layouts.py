"""Clustered predictions, sketches by date, back-fill of dates, compaction of what has landed."""

import datetime
import glob
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import curve_key
from emberline.operators import history, sketches
from emberline.plans import fixtures as fx
from emberline.session import local_table
from emberline.sources import payloads as landed
from emberline.sources import sinks, weather
from emberline.streaming import ingest


def test_curve_interleaves_the_bits(spark):
    rows = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (0.0, -180.0), (-90.0, 0.0), (51.5, -114.25)], "lat double, lon double")
    keys = [row.key for row in rows.selectExpr(f"{curve_key('lat', 'lon')} AS key").collect()]
    assert keys[:4] == [0, 2**32 - 1, 2 << 30, 1 << 30]
    y, x = int((51.5 + 90) / 180 * 65536), int((180 - 114.25) / 360 * 65536)
    assert keys[4] == sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(16))


def row_groups_in(folder, box):
    """Row groups whose statistics meet the box, and all of them."""
    met = total = 0
    for file in glob.glob(os.path.join(folder, "*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            met += all(stats[name].min <= high and stats[name].max >= low for name, (low, high) in box.items())
            total += 1
    return met, total


def test_a_box_reads_few_row_groups(spark, tmp_path):
    cells = spark.range(40_000).selectExpr("id AS cell_id", "41 + (id % 200) * 0.2 AS lat", "-141 + cast(id / 200 AS int) * 0.4 AS lon", "cast(id AS string) AS note")
    cells.select("cell_id", F.col("lat").cast("double"), F.col("lon").cast("double"), "note").write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    sinks.cluster_predictions(stored, str(tmp_path / "curve"), 20_000)
    box = {"lat": (50.0, 55.0), "lon": (-120.0, -110.0)}
    met, total = row_groups_in(str(tmp_path / "curve"), box)
    assert total >= 20 and met <= total / 4
    inside = "lat BETWEEN 50 AND 55 AND lon BETWEEN -120 AND -110"
    clustered = spark.read.parquet(str(tmp_path / "curve"))
    assert sorted(map(tuple, clustered.where(inside).collect())) == sorted(map(tuple, stored.where(inside).collect()))
    assert clustered.count() == 40_000


def test_sketches_of_a_range_are_those_of_its_days(spark, plan_of):
    rows = spark.range(20_000).selectExpr(
        "cast(date_add(DATE'2024-01-01', cast(id % 10 AS int)) AS date) AS file_date", "id % 700 AS cell_id",
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN double('NaN') ELSE cast(id AS double) END AS risk",
    )
    ranges = local_table(spark, [("all", datetime.date(2024, 1, 1), datetime.date(2024, 1, 31)), ("two", datetime.date(2024, 1, 3), datetime.date(2024, 1, 4))], "name string, first date, last date")
    daily = sketches.daily_sketches(rows, "risk")
    assert daily.count() == 10
    found = {
        row.name: row
        for row in sketches.merged(daily, ranges)
        .withColumns({"q": sketches.quantiles("quantiles", (0.25, 0.75)), "cells": sketches.distinct_keys("keys")}).collect()
    }
    assert (found["all"].n_dates, found["all"].n_rows, found["all"].n_values) == (10, 20_000, 19_200)
    assert (found["two"].n_dates, found["two"].n_rows) == (2, 4_000)
    for pair, share in zip(found["all"].q, (0.25, 0.75)):
        assert pair.value == pytest.approx(20_000 * share, abs=20_000 * sketches.RANK_ERROR)
    assert found["all"].cells == pytest.approx(700, rel=sketches.DISTINCT_ERROR)
    none = sketches.merged(sketches.daily_sketches(rows.where("risk IS NULL"), "risk"), ranges)
    assert none.select(sketches.quantiles("quantiles", (0.5,)).alias("q")).where("q IS NOT NULL").isEmpty()


@pytest.mark.parametrize("window, block", [(45, 366), (6, 4), (6, 100), (9, 7)])
def test_every_date_equals_a_run_on_that_date(spark, sf, window, block):
    daily = fx.wx_daily(spark, sf).drop("lat", "lon").persist()
    got = {(row.cell_id, row.last_date): tuple(row) for row in history.accumulate_every_date(daily, 7, window, block=block).collect()}
    assert len(got) == daily.count()
    for day in (datetime.date(2024, 1, 2), datetime.date(2024, 1, 17), datetime.date(2024, 1, 30)):
        window_of_day = history.newest_dates(daily.where(F.col("file_date") <= F.lit(day)), window)
        expected = [row for row in history.accumulate_codes(window_of_day, 7).collect() if row.last_date == day]
        assert expected
        for row in expected:
            assert got[row.cell_id, day][2:] == pytest.approx(tuple(row)[2:], rel=1e-12)
    daily.unpersist()


MAPPING = [(50.0, -110.0, "Calgary"), (51.0, -110.0, "Regina")]


def batch_of(spark, *payloads):
    rows = [(station, datetime.datetime.fromisoformat(at), json.dumps({"main": {"temp": temp}})) for station, at, temp in payloads]
    return spark.createDataFrame(rows, landed.LANDING_SCHEMA)


def test_compaction_with_a_replay_between_the_steps(spark, tmp_path):
    store = str(tmp_path / "store")
    mapping = local_table(spark, MAPPING, "lat double, lon double, nearest_station_name string")
    batches = [
        [("Calgary", "2024-06-01T06:00:00", 1.0), ("Regina", "2024-06-01T06:10:00", 2.0), ("Calgary", "2024-05-30T06:00:00", 9.0)],
        [("Calgary", "2024-06-01T06:30:00", 3.0)],
        [("Regina", "2024-06-01T05:00:00", 4.0), ("Regina", "2024-06-02T05:00:00", 5.0)],
    ]

    def built():
        rows = ingest.build_dates(ingest.read_landed(spark, store), mapping).collect()
        return {(row.file_date.day, row.nearest_station): row.temperature for row in rows}

    for number, rows in enumerate(batches):
        ingest.land(batch_of(spark, *rows), store, number)
    before = built()
    assert before == {(1, "Calgary"): 3.0, (1, "Regina"): 2.0, (2, "Calgary"): None, (2, "Regina"): 5.0, (30, "Calgary"): 9.0, (30, "Regina"): None}
    assert ingest.compact_landed(spark, store) == [datetime.date(2024, 6, 1)]
    assert built() == before
    assert [name for name in sorted(os.listdir(f"{store}/file_date=2024-06-01")) if name.startswith("batch")] == ["batch=2"]
    # The first micro-batch is replayed, then the job runs again.
    ingest.land(batch_of(spark, *batches[0]), store, 0)
    assert built() == before
    assert ingest.compact_landed(spark, store, window=2) == [datetime.date(2024, 6, 1)]
    assert built() == {key: value for key, value in before.items() if key[0] != 30}
    assert ingest.compact_landed(spark, store, window=2) == []
    assert sorted(weather.partition_dates(spark, store)) == [datetime.date(2024, 6, 1), datetime.date(2024, 6, 2)]


def test_documents_are_shredded_and_keep_null_apart_from_absent(spark, tmp_path, plan_of):
    bodies = ['{"main": {"temp": 1.5, "humidity": null}, "dt": 5}'] * 50 + ['{"rain": null}', "[1]", "{broken", '{"wind": 3, "weather": [{"main": "Fog"}]}']
    rows = [("Calgary", datetime.datetime(2024, 6, 1), body) for body in bodies]
    payloads = spark.createDataFrame(rows, landed.LANDING_SCHEMA).coalesce(1)
    path = str(tmp_path / "documents")
    landed.documents(payloads).write.parquet(path)
    (file,) = glob.glob(f"{path}/*.parquet")
    assert "document.typed_value.main.typed_value.temp.typed_value" in {pq.ParquetFile(file).schema.column(i).path for i in range(len(pq.ParquetFile(file).schema))}
    stored = landed.flatten_documents(spark.read.parquet(path))
    direct = landed.flatten_payloads(payloads)
    assert sorted(map(str, stored.collect())) == sorted(map(str, direct.collect())) and direct.count() == 52
    assert plan_of(direct).count("parseJson") == 1
    kinds = {(row.temperature, row.humidity, row.weather_main) for row in direct.collect()}
    assert kinds == {(1.5, None, "Unknown"), (15.0, 50.0, "Unknown"), (15.0, 50.0, "Fog")}
