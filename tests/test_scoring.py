"""Scoring, reports and plan shapes."""

import datetime

import pytest
from pyspark.sql import functions as F

from emberline.operators import history, quality, report, scoring
from emberline.plans import catalog
from emberline.plans import fixtures as fx

DAY = datetime.date(2024, 7, 2)
BEFORE = datetime.date(2024, 7, 1)
COLUMNS = "cell_id bigint, lat double, lon double, file_date date, temperature double, humidity double, wind_speed double, rain_1h_mm double"


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def row(cell, day=DAY, t=20.0, h=40.0, w=10.0, r=0.0):
    return (cell, 50.0 + cell, -110.0, day, t, h, w, r)


def test_only_todays_cells_are_scored(spark):
    days = table(spark, [row(1, BEFORE), row(1), row(2, BEFORE)])
    assert [r["cell_id"] for r in scoring.predictions(days, 7).collect()] == [1]


def test_cell_without_history_starts_from_today(spark):
    past, today = table(spark, [row(1, BEFORE, t=30.0)]), table(spark, [row(1), row(2)])
    codes = {r["cell_id"]: r for r in scoring.today_codes(past, today, 7).collect()}
    alone = history.accumulate_codes(today, 7).filter("cell_id = 2").first()
    own = history.accumulate_codes(past, 7).first()
    assert codes[2]["dmc"] == alone["dmc"] and codes[1]["dmc"] == own["dmc"] != codes[2]["dmc"]


def test_given_snapshot_may_repeat_a_cell(spark):
    today = table(spark, [row(1), row(1, t=10.0)])
    got = scoring.predictions(table(spark, [row(1, BEFORE)]), 7, today=today)
    assert sorted(r["weather_features"]["temperature"] for r in got.collect()) == [10.0, 20.0]


def test_rejects(spark):
    scored = scoring.predictions(table(spark, [row(1, t=-1.0), row(2, t=None), row(3, t=float("nan")), row(4)]), 7)
    assert [r["cell_id"] for r in scoring.rejected(scored).collect()] == [1]
    assert sorted(r["cell_id"] for r in scoring.accepted(scored).collect()) == [2, 3, 4]
    assert report.rejects_by_reason(scored).first()["n_rows"] == 1


def test_missing_values_show_as_zero_but_count_as_default(spark):
    scored = scoring.predictions(table(spark, [row(1, t=None, h=float("nan"), w=None)]), 7).first()
    features = scored["weather_features"]
    assert (features["temperature"], features["humidity"], features["wind_speed"]) == (0.0, 0.0, 0.0)
    assert (features["is_hot"], features["is_dry"], features["is_windy"]) == (0, 0, 0)
    assert features["humidity_temp_ratio"] == 0.0
    usual = history.accumulate_codes(table(spark, [row(1, t=15.0, h=50.0, w=10.0)]), 7).first()
    assert scored["fire_weather_indices"]["ffmc"] == usual["ffmc"]


def test_absent_columns_show_their_default(spark):
    days = table(spark, [row(1)]).drop("humidity", "rain_1h_mm")
    features = scoring.predictions(days, 7).first()["weather_features"]
    assert (features["humidity"], features["pressure"], features["rain_1h_mm"]) == (50.0, 1013.0, 0.0)


def test_fire_history_raises_risk(spark):
    grid = spark.createDataFrame([(51.0, -110.0, 1), (52.0, -110.0, 0)], "lat double, lon double, historical_fire int")
    got = {r["cell_id"]: r for r in scoring.predictions(table(spark, [row(1), row(2), row(3)]), 7, grid=grid).collect()}
    assert got[1]["daily_fire_risk"] == pytest.approx(min(0.98, got[2]["daily_fire_risk"] * 1.15))
    assert got[3]["daily_fire_risk"] == got[2]["daily_fire_risk"]


def test_location_names(spark):
    assert [scoring.predictions(table(spark, [row(7)]), 7).first()["location_name"]] == ["Grid_7"]
    named = table(spark, [row(7), row(8)]).withColumn("nearest_station", F.when(F.col("cell_id") == 7, "Calgary"))
    got = {r["cell_id"]: r["location_name"] for r in scoring.predictions(named, 7).collect()}
    assert got == {7: "Calgary", 8: "Grid_8"}


def test_positions_as_keys(spark):
    days = table(spark, [row(1, BEFORE), row(1), row(2)]).drop("cell_id")
    got = scoring.predictions(days, 7, keys=("lat", "lon"))
    assert sorted((r["lat"], r["location_name"]) for r in got.collect()) == [
        (51.0, "Grid_3622"), (52.0, "Grid_3978")
    ]


def test_window_restarts_from_the_start_codes(spark):
    days = [row(1, datetime.date(2024, 5, 1) + datetime.timedelta(2 * i), t=5.0 + i) for i in range(60)]
    whole, cut = table(spark, days), table(spark, days[-45:])
    windowed = history.accumulate_codes(history.newest_dates(whole), 7).first()
    assert windowed == history.accumulate_codes(cut, 7).first()
    assert windowed["dc"] != history.accumulate_codes(whole, 7).first()["dc"]


def test_statistics_of_an_empty_run(spark):
    stats = report.run_stats(scoring.predictions(table(spark, [row(1)]), 7).filter("cell_id = 9")).first()
    assert stats["total_locations"] == 0 and stats["risk_statistics"]["mean_risk"] == 0.0
    assert report.class_report(scoring.predictions(table(spark, [row(1)]), 7)).count() == 6


def test_training_records_without_runs(spark):
    log = spark.createDataFrame([], "processed_successfully bigint, run_ts timestamp")
    assert report.training_records(log).first()[0] == 0


def test_last_snapshot_keeps_missing_values(spark):
    rows = spark.createDataFrame(
        [(1, DAY, 1, 5.0), (1, DAY, 2, None)], "cell_id bigint, file_date date, seq bigint, temperature double"
    )
    assert history.last_per_day(rows, ["seq"]).first()["temperature"] is None
    assert history.last_per_day(rows, ["seq", "cell_id"]).first()["temperature"] is None


@pytest.mark.parametrize(
    "age, status, label", [(1.99, "healthy", "fresh"), (2.0, "degraded", "stale"), (24.0, "unhealthy", "very_stale")]
)
def test_freshness_tiers(spark, age, status, label):
    at = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(at - datetime.timedelta(hours=age),)], "at timestamp")
    got = quality.freshness("t", rows, "at", F.lit(at)).first()
    assert (got["status"], got["freshness"], got["age_hours"]) == (status, label, age)


def test_too_few_rows_are_unhealthy(spark):
    at = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(at,)], "at timestamp")
    assert quality.freshness("t", rows, "at", F.lit(at), min_rows=2).first()["status"] == "unhealthy"


def test_snapshot_is_one_combined_shuffle(spark, sf, plan_of):
    plan = plan_of(fx.wx_daily(spark, sf))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan and "Window" not in plan


def test_accumulation_adds_one_shuffle(spark, sf, plan_of):
    plan = plan_of(catalog.accumulated_codes(spark, sf))
    assert plan.count("Exchange") == 2 and "Python" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"stream_equals_batch", "stream_ingest"}))
def test_no_pair_joins_and_no_python(spark, sf, plan_of, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "InPandas" not in plan
    if name != "freshness_audit":  # one row per table against one row
        assert "BroadcastNestedLoopJoin" not in plan
