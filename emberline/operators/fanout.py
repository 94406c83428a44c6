"""Station weather spread over the grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.payloads import WEATHER_COLUMNS


def known_payloads(payloads: DataFrame, stations: DataFrame) -> DataFrame:
    """Payloads of stations that are on the list."""
    return payloads.join(stations.select(F.col("name").alias("station")), "station", "left_semi")


def unknown_stations(payloads: DataFrame, stations: DataFrame) -> DataFrame:
    """Station names that are not on the list, with how many payloads they sent.

    Counted before the anti join, so the join sees one row per name.
    """
    counts = payloads.groupBy("station").agg(F.count("*").alias("n_payloads"))
    return counts.join(stations.select(F.col("name").alias("station")), "station", "left_anti")


def with_run(payloads: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Add the date and the collection run (the hour) that a payload belongs to."""
    return payloads.withColumns({"file_date": F.col(fetched_at).cast("date"), "run": F.date_trunc("hour", fetched_at)})


def arrival_order(columns: list[str], fetched_at: str = "fetched_at") -> Column:
    """One number that orders readings: fetched last, then observed last, then by content.

    A fixed-width number keeps the maximum per station in a hash aggregate.
    """
    observed = F.least(F.greatest(F.coalesce("timestamp_utc", F.lit(0)), F.lit(0)), F.lit(10**11 - 1))
    content = F.pmod(F.xxhash64(*[c for c in columns if c not in ("file_date", "run")]), F.lit(10**10))
    parts = ((F.unix_micros(F.col(fetched_at).cast("timestamp")), 21), (observed, 10), (content, 0))
    return sum(part.cast("decimal(17,0)") * F.expr(f"cast(1{'0' * shift} AS decimal(22,0))") for part, shift in parts).cast("decimal(38,0)")


def last_readings(station_rows: DataFrame, keys: tuple[str, ...] = ("file_date", "run", "station")) -> DataFrame:
    """The last row per ``keys`` of flat station weather (with ``file_date`` and ``run``).

    The winners are found by a hash aggregate over keys and one number, and joined back.
    """
    ordered = station_rows.withColumn("arrival", arrival_order(station_rows.columns))
    winners = ordered.groupBy(*keys).agg(F.max("arrival").alias("arrival"))
    return ordered.join(winners, [*keys, "arrival"], "left_semi").drop("arrival")


def rows_of_last_runs(station_rows: DataFrame) -> DataFrame:
    """Each station's last reading in the last run of each date, with its ``run``.

    ``station_rows`` is flat weather of known stations, one row per readable payload; a run
    that brought nothing readable is no run.  What is left of parts of the rows can be put
    together and reduced again: the result is that of all rows at once.
    """
    # Readings are in order of time first, so a station's last one is of its last run of the date.
    latest = last_readings(station_rows, ("file_date", "station"))
    # As many rows a date as there are stations.
    last = F.max("run").over(Window.partitionBy("file_date"))
    return latest.withColumn("last_run", last).where("run = last_run").drop("last_run")


def last_run_per_date(station_rows: DataFrame) -> DataFrame:
    """The same without ``run``: what the grid weather of each date is made of."""
    return rows_of_last_runs(station_rows).drop("run")


def _mapped_stations(cell_station: DataFrame) -> DataFrame:
    """Each station that some cell is mapped to; a cell without position has none."""
    return cell_station.select(F.col("nearest_station_name").alias("station")).where("station IS NOT NULL").distinct()


def fetch_summary(cell_station: DataFrame, station_weather: DataFrame) -> DataFrame:
    """How many of the mapped stations delivered weather: one row of counts."""
    wanted = _mapped_stations(cell_station)
    delivered = station_weather.select("station").distinct().withColumn("delivered", F.lit(True))
    return wanted.join(delivered, "station", "left").agg(
        F.count("*").alias("n_stations"),
        F.count_if("delivered").alias("n_success"),
        F.count_if(F.col("delivered").isNull()).alias("n_failed"),
    )


def run_summaries(cell_station: DataFrame, payloads: DataFrame, station_rows: DataFrame) -> DataFrame:
    """The same for every run that sent anything: ``run, n_stations, n_success, n_failed``.

    ``payloads`` lists the runs, ``station_rows`` is what could be read; both have ``run``.
    """
    wanted = _mapped_stations(cell_station)
    delivered = station_rows.select("run", "station").distinct().join(wanted, "station", "left_semi")
    counts = delivered.groupBy("run").agg(F.count("*").alias("n_success"))
    n_success, n_stations = F.coalesce("n_success", F.lit(0)), wanted.agg(F.count("*")).scalar()
    runs = payloads.select("run").distinct().join(counts, "run", "left").withColumn("n_stations", n_stations)
    return runs.select("run", "n_stations", n_success.alias("n_success"), (F.col("n_stations") - n_success).alias("n_failed"))


def require_weather(summary: DataFrame) -> None:
    """Stop a run that received no weather at all."""
    if summary.first()["n_success"] == 0:
        raise RuntimeError("no station delivered any weather")


def fan_out(cell_station: DataFrame, station_weather: DataFrame) -> DataFrame:
    """Every cell with the weather of its nearest station, NULL where that station failed.

    ``station_weather`` has one row per station (or per station and ``file_date``, with cells
    carrying ``file_date`` too).  Whether it is broadcast is left to its size as Spark finds it.
    """
    on = ["nearest_station"] + [c for c in ("file_date",) if c in station_weather.columns]
    keep = [c for c in WEATHER_COLUMNS if c in station_weather.columns]
    weather = station_weather.withColumnRenamed("station", "nearest_station").select(*on, *keep)
    cells = cell_station.withColumnRenamed("nearest_station_name", "nearest_station")
    return cells.join(weather, on, "left").select(*cells.columns, *keep)


def spread_by_date(station_weather: DataFrame, cell_station: DataFrame) -> DataFrame:
    """Grid weather for every date that brought some, NULL where a station failed."""
    # One entry per day that the rows span.
    dates = station_weather.select("file_date").distinct().agg(F.collect_list("file_date")).scalar()
    return fan_out(cell_station.withColumn("file_date", F.explode(dates)), station_weather)
