"""The five jobs end to end, each one Spark program over tables."""

from __future__ import annotations

import time
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import WINDOW_DATES
from emberline.operators import fanout, quality, report, scoring, spatial
from emberline.sources import sinks, weather
from emberline.streaming import ingest


def build_grid(spark: SparkSession, fires: DataFrame, path: str, mode: str = "circle") -> None:
    """Generate the grid, flag cells with past fires nearby, and store it."""
    grid = spatial.flag_fire_history(spatial.grid_cells(spark), fires, mode=mode)
    sinks.write_table(grid.select("lat", "lon", "historical_fire"), path)


def map_stations(spark: SparkSession, path: str, grid: DataFrame | None = None) -> None:
    """Store the nearest station of every grid cell."""
    cells = spatial.grid_cells(spark) if grid is None else grid
    mapped = spatial.nearest_station(cells, spatial.stations(spark))
    sinks.write_table(mapped.select("lat", "lon", "nearest_station_name"), path)


def latest_weather(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """The last readable payload of each known station in a run, flat: one row per station."""
    return fanout.last_readings(ingest.station_rows(payloads), ("station",)).drop("file_date", "run")


def run_weather(cell_station: DataFrame, station_weather: DataFrame) -> DataFrame:
    """Grid weather of one run; a run in which no station delivered is an error."""
    fanout.require_weather(fanout.fetch_summary(cell_station, station_weather))
    return fanout.fan_out(cell_station, station_weather)


def collect_weather(
    spark: SparkSession, payloads: DataFrame, cell_station: DataFrame, path: str, run_date: date, run_text: str
) -> None:
    """Write a run's grid weather as the partition of its date, replacing an earlier run's.

    The station rows are used by the check and by the write; they are few and kept meanwhile.
    """
    station_weather = latest_weather(spark, payloads).persist()
    try:
        grid_weather = run_weather(cell_station, station_weather)
        sinks.write_daily(
            grid_weather.withColumns({"date": F.lit(run_text), "file_date": F.lit(run_date)}), path
        )
    finally:
        station_weather.unpersist()


def score(
    spark: SparkSession,
    history: DataFrame,
    grid: DataFrame | None,
    out: str,
    as_of_month: int,
    run_ts: str,
    window: int = WINDOW_DATES,
    keys: tuple[str, ...] = ("lat", "lon"),
    today: DataFrame | None = None,
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Score today's cells; store predictions, rejects and the run log; return the statistics.

    ``today`` is the snapshot to score, by default the newest date of the history.

    The scored rows are written once; statistics, rejects and the run log are made of what was
    counted on the way.
    """
    started = time.monotonic()
    moment = F.lit(run_ts).cast("timestamp")
    scored = scoring.predictions(history, as_of_month, today, grid, window, keys, bounds=bounds)
    seen = sinks.write_observed(scored, f"{out}/scored", report.run_metrics())
    sinks.write_predictions(scoring.accepted(spark.read.parquet(f"{out}/scored")), f"{out}/predictions")
    report.observed_rejects(spark, seen).write.mode("overwrite").parquet(f"{out}/rejects")
    stats = report.observed_stats(spark, seen)
    stats.write.mode("overwrite").parquet(f"{out}/stats")
    stats = spark.read.parquet(f"{out}/stats")
    sinks.envelope(stats, moment).write.mode("overwrite").json(f"{out}/envelope")
    sinks.append_run_log(stats, f"{out}/run_log", moment, time.monotonic() - started)
    return stats


def score_stored(
    spark: SparkSession,
    history_path: str,
    grid: DataFrame | None,
    out: str,
    run_ts: str,
    as_of: date | None = None,
    window: int = WINDOW_DATES,
) -> DataFrame:
    """Score a date of a stored history (its newest, or ``as_of``) with the dates before it.

    The window comes from the folder's listing, so only its files are opened.
    """
    dates = sorted(day for day in weather.partition_dates(spark, history_path) if as_of is None or day <= as_of)[-window:]
    if not dates:
        raise ValueError("no weather for that date")
    history = weather.read_history_table(spark, history_path).filter(F.col("file_date").isin(dates))
    bounds = (F.lit(dates[0]), F.lit(dates[-1]))
    return score(spark, history, grid, out, dates[-1].month, run_ts, window, bounds=bounds)


def refresh(
    spark: SparkSession,
    payloads: DataFrame,
    mapping: DataFrame,
    grid: DataFrame | None,
    history_path: str,
    out: str,
    run_date: date,
    run_text: str,
    run_ts: str,
    window: int = WINDOW_DATES,
) -> DataFrame:
    """One scheduled run: collect today's weather, drop expired dates, score the window."""
    collect_weather(spark, payloads, mapping, history_path, run_date, run_text)
    sinks.prune_history(spark, history_path, window)
    return score_stored(spark, history_path, grid, out, run_ts, window=window)


def health(
    spark: SparkSession, history: DataFrame | None, predictions: DataFrame | None, as_of: str
) -> DataFrame:
    """Freshness and completeness of stored weather and predictions at ``as_of``.

    Age counts from when their newest file was written; a table that is absent is unhealthy.
    """
    moment = F.lit(as_of).cast("timestamp")
    written = "_metadata.file_modification_time AS written"
    absent = spark.range(0).selectExpr("cast(NULL AS date) AS file_date", "cast(NULL AS timestamp) AS written")
    weather_rows = absent if history is None else history.selectExpr("file_date", written)
    result_rows = absent if predictions is None else predictions.selectExpr(written)
    return quality.audit(
        [
            quality.freshness("Weather Data", weather_rows, "written", moment, dates="file_date"),
            quality.freshness("Predictions Cache", result_rows, "written", moment),
        ]
    )
