"""The registered queries: every operator of the engine run over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import FLOAT32_HISTORY, FLOAT32_TODAY
from emberline.functions import fwi
from emberline.functions.clean import as_float32, index_inputs, json_clean
from emberline.functions.geo import province
from emberline.operators import fanout, history, quality, report, scoring, sketches, spatial
from emberline.plans import fixtures as fx
from emberline.plans import jobs
from emberline.session import local_table, scratch_dir
from emberline.sources import payloads as landed
from emberline.sources import sinks, weather
from emberline.streaming import cells, ingest, state

# The month is a parameter of every accumulation; queries that share an oracle share it.
SUMMER = 7
SPRING = 4

CODES = ["ffmc", "dmc", "dc"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that results compare across engines."""
    return df.selectExpr(
        *[f"round({c}, {digits}) + 0D AS {c}" if kind == "double" else c for c, kind in df.dtypes]
    )


def daily_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    daily = fx.wx_daily(spark, sf).drop("lat", "lon")
    return as_float32(daily, FLOAT32_HISTORY)


def latest_n_dates(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest_dates(fx.wx_line(spark, sf))


def retention_drop_list(spark: SparkSession, sf: str) -> DataFrame:
    return history.expired_dates(fx.wx_line(spark, sf))


def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest_snapshot(fx.wx_events(spark, sf))


def line_window_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Newest dates first, then the last observation per day, then the accumulation."""
    # Order and line number are the key of a line: one number keeps the hash aggregate.
    lines = fx.wx_line(spark, sf).withColumn("line", F.expr("l_orderkey * 8 + l_linenumber"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    daily = history.last_per_day(history.newest_dates(lines).drop(*keys), ["line"])
    return rounded(history.accumulate_codes(daily, SUMMER).drop("last_wind"))


def sanitize_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return index_inputs(fx.wx_events(spark, sf), ["event_id"], float32=False)


def _daily_float32(spark: SparkSession, sf: str) -> DataFrame:
    return as_float32(fx.wx_daily(spark, sf), FLOAT32_TODAY)


def weather_features(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily_float32(spark, sf)
    columns = daily.columns
    features = scoring.weather_features(columns, "0D")
    del features["fire_danger_index"]
    valid = daily.filter(f"({scoring.reject_reason(columns)}) IS NULL")
    return rounded(valid.selectExpr("cell_id", "file_date", *[f"{text} AS {name}" for name, text in features.items()]))


def rejects_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily_float32(spark, sf)
    return report.rejects_by_reason(
        daily.selectExpr("*", f"{scoring.reject_reason(daily.columns)} AS reject_reason")
    )


def single_day_codes(spark: SparkSession, sf: str) -> DataFrame:
    terms = history.daily_terms(fx.wx_daily(spark, sf), SUMMER)
    day = terms.selectExpr("cell_id", "file_date", f"array({history.DAY_STRUCT}) AS series")
    return rounded(fwi.fold_series(day).drop("last_date", "last_wind"))


def accumulated_codes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.accumulate_codes(fx.wx_daily(spark, sf), SUMMER))


def _indices(spark: SparkSession, sf: str, month: int) -> DataFrame:
    return fwi.with_fire_indices(history.accumulate_codes(fx.wx_daily(spark, sf), month))


def fire_indices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_indices(spark, sf, SPRING).drop("last_wind", "last_date"))


def _flagged_grid(spark: SparkSession, sf: str, mode: str = "circle") -> DataFrame:
    return spatial.flag_fire_history(spatial.grid_cells(spark), fx.fires(spark, sf), mode=mode)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    dates = fx.table(spark, sf, "events").selectExpr("cast(ts AS date) AS file_date")
    return scoring.predictions(fx.wx_daily(spark, sf), SUMMER, grid=_flagged_grid(spark, sf), dates=dates)


def _flat(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "cell_id",
        *[c for c in scoring.PREDICTION_COLUMNS if c not in ("weather_features", "fire_weather_indices")],
        "weather_features.*",
        "fire_weather_indices.*",
    )


def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: history, accumulation, indices, fire history, classes, features."""
    return rounded(_flat(scoring.accepted(_scored(spark, sf))))


def danger_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.class_report(scoring.accepted(_scored(spark, sf)))


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of a run, counted while its rows are written."""
    path = scratch_dir(spark, "scored")
    stats = report.observed_stats(spark, sinks.write_observed(_scored(spark, sf), path, report.run_metrics()))
    return rounded(
        stats.select("total_locations", "processed_successfully", "processing_errors", "risk_statistics.*")
    )


def run_log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs are logged; the record count comes from the later one."""
    log = scratch_dir(spark, "run-log")
    daily = fx.wx_daily(spark, sf)
    earlier = daily.filter(F.col("file_date") < daily.agg(F.max("file_date")).scalar())
    for frame, moment in ((daily, "2024-01-31 00:00:00"), (earlier, "2024-01-30 00:00:00")):
        stats = report.run_stats(scoring.predictions(frame, SUMMER))
        sinks.append_run_log(stats, log, F.lit(moment).cast("timestamp"), 0.0)
    return report.training_records(spark.read.parquet(log))


def fallback_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history is all dates before the newest; it lacks one cell in three.

    Those cells start from today's row.
    """
    daily = fx.wx_daily(spark, sf)
    today = as_float32(history.latest_snapshot(daily), FLOAT32_TODAY)
    newest = daily.agg(F.max("file_date")).scalar()
    before = daily.filter((F.col("file_date") < newest) & (F.col("cell_id") % 3 != 0))
    codes = scoring.today_codes(before, today, SUMMER)
    return rounded(codes.select("cell_id", *fwi.INDEX_NAMES))


def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every grid cell with the number of observations made at its position."""
    seen = fx.wx_events(spark, sf).groupBy("lat", "lon").agg(F.count("*").alias("n_observations"))
    return (
        spatial.grid_cells(spark)
        .join(seen, ["lat", "lon"], "left")
        .select("cell_id", "lat", "lon", F.coalesce("n_observations", F.lit(0)).alias("n_observations"))
    )


def fire_projection(spark: SparkSession, sf: str) -> DataFrame:
    points = spatial.projected(fx.fires(spark, sf), "latitude", "longitude")
    return rounded(points.select("fire_id", "x", "y"), 2)


def _observed_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fx.wx_events(spark, sf).select("cell_id", "lat", "lon").distinct()


def _mapped_cells(spark: SparkSession, sf: str) -> DataFrame:
    mapped = spatial.nearest_station(_observed_cells(spark, sf), spatial.stations(spark))
    return mapped.drop("station_distance_m")


def nearest_station(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.nearest_station(_observed_cells(spark, sf), spatial.stations(spark)), 2)


def historical_fire_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged_grid(spark, sf)


def historical_fire_flag_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged_grid(spark, sf, "polygon64")


def province_of_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Province of every grid cell, with what was observed there."""
    return grid_coverage(spark, sf).selectExpr("*", f"{province('lat', 'lon')} AS province")


def payload_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = landed.daily_columns(landed.flatten_payloads(fx.payloads(spark, sf)))
    return flat.withColumn("date", landed.local_date_text(F.col("fetched_at"))).drop("fetched_at")


def payload_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same from payloads that were stored as shredded variants."""
    path = scratch_dir(spark, "documents")
    landed.documents(fx.payloads(spark, sf)).write.parquet(path)
    flat = landed.daily_columns(landed.flatten_documents(spark.read.parquet(path)))
    return flat.withColumn("date", landed.local_date_text(F.col("fetched_at"))).drop("fetched_at")


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads as an ingest keeps them: the last readings of each date, flat."""
    store = scratch_dir(spark, "landed")
    ingest.land(fx.payloads(spark, sf), store)
    return ingest.read_landed(spark, store)


def station_fanout(spark: SparkSession, sf: str) -> DataFrame:
    latest = fanout.last_run_per_date(_landed(spark, sf).drop("event_id"))
    return fanout.spread_by_date(latest, _mapped_cells(spark, sf))


def fetch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Stations that delivered and failed, for every hourly run."""
    sent = fanout.with_run(fx.table(spark, sf, "events").withColumnRenamed("ts", "fetched_at"))
    return fanout.run_summaries(_mapped_cells(spark, sf), sent, ingest.station_rows(fx.payloads(spark, sf)))


def payload_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that could not be read, with the reason."""
    return landed.unreadable_payloads(fx.payloads(spark, sf)).drop("fetched_at")


def unknown_stations(spark: SparkSession, sf: str) -> DataFrame:
    return fanout.unknown_stations(fx.payloads(spark, sf), spatial.stations(spark))


def union_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Failed observations come without a temperature column; the union fills it with NULL."""
    events = fx.table(spark, sf, "events")
    failed = fx.events_as_weather(events.filter("event_type = 'error'")).drop("temperature")
    sound = fx.events_as_weather(events.filter("event_type <> 'error'"))
    return failed.unionByName(sound, allowMissingColumns=True)


def partition_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Each date is first written with its first snapshot, then replaced; the last one wins.

    The newest date is not part of the second write and keeps its first snapshot.
    """
    path = scratch_dir(spark, "daily")
    events = fx.wx_events(spark, sf)
    first = history.last_per_day(events.withColumn("back", -F.col("event_id")), ["back"]).drop("back")
    sinks.write_daily(first, path)
    daily = fx.wx_daily(spark, sf)
    sinks.write_daily(daily.filter(F.col("file_date") < daily.agg(F.max("file_date")).scalar()), path)
    return weather.read_history_table(spark, path)


FILE_COLUMNS = ["cell_id", "lat", "lon", "temperature", "humidity", "wind_speed", "rain_1h_mm"]


def _daily_files(spark: SparkSession, sf: str) -> str:
    """A folder of dated CSV files, one per date.

    Failed observations at full humidity write text as temperature.  Of the dates with an even
    day number one in three writes a number with a type's suffix, and another has no rain column.
    """
    path = scratch_dir(spark, "csv")
    broken = "temperature IS NULL AND humidity = 100"
    day = "day(file_date) % 6"
    text = f"CASE WHEN {broken} THEN 'corrupt' WHEN {day} = 2 AND cell_id % 50 = 0 THEN '1d' ELSE cast(temperature AS string) END"
    row = f"concat_ws(',', cell_id, lat, lon, coalesce({text}, ''), humidity, wind_speed"
    line = f"if({day} = 4, {row}), {row}, rain_1h_mm))"
    head = f"if({day} = 4, '{','.join(FILE_COLUMNS[:-1])}', '{','.join(FILE_COLUMNS)}')"
    days = fx.wx_daily(spark, sf).groupBy("file_date").agg(F.array_sort(F.collect_list(F.expr(line))).alias("lines"))
    files = days.selectExpr("file_date", f"concat({head}, chr(10), array_join(lines, chr(10))) AS value")
    files.repartition(F.col("file_date")).write.partitionBy("file_date").text(f"{path}/parts")
    _name_by_date(spark, f"{path}/parts", f"{path}/days")
    return f"{path}/days"


def _name_by_date(spark: SparkSession, parts: str, days: str) -> None:
    """Give each date's one file the name ``<date>.csv`` in one folder, as the collector does."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(days)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    for file in spark.read.text(parts).inputFiles():
        date = file.rpartition("file_date=")[2].partition("/")[0]
        files.rename(path(file), path(folder, f"{date}.csv"))


def bad_file_skip(spark: SparkSession, sf: str) -> DataFrame:
    """All dated files of a folder through the reader of the history."""
    everything = 100_000
    typed = weather.load_history(spark, _daily_files(spark, sf), everything, FILE_COLUMNS)
    return typed.withColumn("cell_id", F.col("cell_id").cast("bigint"))


def rejects_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that could not be scored, files and payloads that could not be read, in one table."""
    daily = _daily_float32(spark, sf)
    scored = daily.selectExpr("*", f"{scoring.reject_reason(daily.columns)} AS reject_reason")
    text = "if(temperature IS NULL AND humidity = 100, 'corrupt', cast(temperature AS string)) AS temperature"
    raw = fx.wx_daily(spark, sf).selectExpr("cast(file_date AS string) AS file_name", text)
    return report.rejects_report(scored, weather.unreadable_files(raw), landed.unreadable_payloads(fx.payloads(spark, sf)))


def freshness_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The observations, and the same without failed ones as a stand-in for their results."""
    as_of = F.lit("2024-01-31 01:00:00").cast("timestamp")
    events = fx.table(spark, sf, "events")
    fires = fx.table(spark, sf, "orders")
    return quality.audit(
        [
            quality.freshness("Weather Data", events, "ts", as_of),
            quality.freshness("Predictions Cache", events.filter("event_type <> 'error'"), "ts", as_of),
            quality.freshness("Fire Points", fires, "o_orderdate", as_of),
            quality.freshness("Rejects", events.filter("value < 0"), "ts", as_of, min_rows=0),
        ]
    )


def json_clean_values(spark: SparkSession, sf: str) -> DataFrame:
    """NaN and infinities inside structs and arrays become zero, NULL stays."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    raw = fx.wx_events(spark, sf).select(
        "event_id",
        F.struct(
            F.coalesce("temperature", nan).alias("temperature"),
            F.when(F.col("wind_speed") > 12.0, -inf).otherwise(F.col("wind_speed")).alias("wind_speed"),
            F.col("temperature").alias("kept_null"),
        ).alias("weather"),
        F.array(F.coalesce("temperature", nan), F.col("humidity")).alias("readings"),
    )
    clean = json_clean(raw)
    return clean.select(
        "event_id", "weather.*", F.get("readings", F.lit(0)).alias("first_reading"),
        F.get("readings", F.lit(1)).alias("second_reading"),
    )


def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written and read back, with the filter pushed into the scan."""
    path = scratch_dir(spark, "predictions")
    sinks.write_predictions(scoring.accepted(_scored(spark, sf)), path)
    stored = weather.read_predictions(spark, f"{path}/parquet")
    return rounded(_flat(stored.filter(F.col("daily_fire_risk") >= 0.65)))


def prediction_export(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines and envelope of a run, written and read back."""
    path = scratch_dir(spark, "export")
    scored = _scored(spark, sf)
    scored.write.parquet(f"{path}/scored")
    stored = spark.read.parquet(f"{path}/scored")
    sinks.write_predictions(scoring.accepted(stored), f"{path}/predictions")
    sinks.envelope(report.run_stats(stored), F.lit("2024-01-31 00:00:00")).write.json(f"{path}/envelope")
    head = spark.read.json(f"{path}/envelope")
    lines = spark.read.json(f"{path}/predictions/json")
    marked = lines.withColumns(
        {
            "success": head.select("success").scalar(),
            "total_locations": head.select("processing_stats.total_locations").scalar(),
            "run": head.select("timestamp").scalar(),
        }
    )
    return rounded(
        marked.selectExpr(
            "cell_id", "location_name", "daily_fire_risk", "danger_class", "weather_features.humidity_temp_ratio",
            "fire_weather_indices.fwi", "success", "total_locations", "run",
        )
    )


def _payload_lines(payloads: DataFrame) -> DataFrame:
    """Lines of landing files; a text that is no JSON travels as a JSON string."""
    body = "if(try_parse_json(payload) IS NULL, to_json(array(payload)), payload)"
    line = (
        "concat('{\"station\":\"', station, '\",\"fetched_at\":\"', cast(fetched_at AS string),"
        f" '\",\"payload\":', {body}, '}}')"
    )
    return payloads.selectExpr(f"replace({line}, chr(10), ' ') AS value")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Payload files land, are streamed over the observed cells, and stored as daily partitions."""
    path = scratch_dir(spark, "ingest")
    # Four files in an order unlike that of the events, one per micro-batch.
    mixed = fx.payloads(spark, sf).repartition(4, F.xxhash64("event_id"))
    _payload_lines(mixed).write.text(f"{path}/landed")
    # As the mapping job leaves it: every micro-batch reads it.
    _mapped_cells(spark, sf).drop("cell_id").write.parquet(f"{path}/mapping")
    mapping = spark.read.parquet(f"{path}/mapping")
    stream = landed.stream_payloads(spark, f"{path}/landed", files_per_batch=1)
    ingest.start_ingest(stream, mapping, f"{path}/daily", f"{path}/checkpoint").awaitTermination()
    return weather.read_history_table(spark, f"{path}/daily")


LATE_AFTER = "10 days"


def late_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the payloads land, then all of them: the first half once more, and dates that have expired.

    Accepted payloads by date; repeated and late ones as totals.
    """
    path = scratch_dir(spark, "late")
    counts = {"repeated": 0, "late": 0}
    for part in ("event_id % 2 = 0", "true"):
        _payload_lines(fx.payloads(spark, sf).where(part)).write.mode("append").text(f"{path}/landed")
        stream = landed.stream_payloads(spark, f"{path}/landed")
        query = ingest.start_landing(stream, f"{path}/accepted", f"{path}/checkpoint", LATE_AFTER)
        query.awaitTermination()
        seen = ingest.landing_counts(query)
        counts = {name: n + seen[name] for name, n in counts.items()}
    totals = local_table(spark, list(counts.items()), "outcome string, n_payloads bigint")
    accepted = spark.read.parquet(f"{path}/accepted").groupBy("file_date").agg(F.count("*").alias("n_payloads"))
    return accepted.selectExpr("file_date", "'accepted' AS outcome", "n_payloads").unionByName(
        totals.selectExpr("cast(NULL AS date) AS file_date", "outcome", "n_payloads")
    )


def stream_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The accumulation from a stream over the observations; same result as the batch.

    Four files, mixed by a hash, make four micro-batches: later ones bring earlier days.
    """
    path = scratch_dir(spark, "windows")
    events = fx.table(spark, sf, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    inputs = state.day_inputs(fx.events_as_weather(arriving), "event_id")
    state.start_window_stream(inputs, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    codes = state.codes_of_days(state.current_days(spark, f"{path}/out"), SUMMER)
    return rounded(codes.select("cell_id", "last_date", "last_wind", *CODES))


def state_store_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The same from windows in keyed state; the stream stops half way and goes on."""
    path = scratch_dir(spark, "cells")
    events = fx.table(spark, sf, "events")
    for half in (0, 1):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half)
        part.repartition(2, F.xxhash64("event_id", F.lit(1))).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        inputs = state.day_inputs(fx.events_as_weather(arriving), "event_id")
        cells.start_cell_stream(inputs, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    codes = state.codes_of_days(cells.current_windows(spark, f"{path}/out"), SUMMER)
    return rounded(codes.select("cell_id", "last_date", "last_wind", *CODES))


BOX = {"lat": (50.0, 60.0), "lon": (-125.0, -100.0)}


def predictions_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a box, from a table laid out along a space-filling curve."""
    path = scratch_dir(spark, "curve")
    scoring.accepted(_scored(spark, sf)).write.parquet(f"{path}/stored")
    sinks.cluster_predictions(spark.read.parquet(f"{path}/stored"), f"{path}/clustered")
    inside = weather.read_predictions(spark, f"{path}/clustered")
    for name, ends in BOX.items():
        inside = inside.filter(F.col(name).between(*ends))
    return rounded(_flat(inside))


RANGES = [("first week", "2024-01-01", "2024-01-07"), ("january", "2024-01-01", "2024-01-31"), ("one day", "2024-01-15", "2024-01-15")]
SHARES = (0.1, 0.5, 0.9)


def risk_quantiles_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """FWI over ranges of dates from stored daily sketches, held against the values themselves.

    ``rank_held`` and ``cells_held`` say whether the sketches keep to their stated errors.
    """
    path = scratch_dir(spark, "sketches")
    scores = fwi.with_fire_indices(history.accumulate_every_date(fx.wx_daily(spark, sf), SUMMER, BACKFILL_WINDOW))
    scores.withColumnRenamed("last_date", "file_date").select("cell_id", "file_date", "fwi").write.parquet(f"{path}/scores")
    stored = spark.read.parquet(f"{path}/scores")
    sketches.daily_sketches(stored, "fwi").write.parquet(f"{path}/daily")
    ranges = local_table(spark, RANGES, "name string, first string, last string").selectExpr(
        "name", "cast(first AS date) AS first", "cast(last AS date) AS last"
    )
    merged = sketches.merged(spark.read.parquet(f"{path}/daily"), ranges)
    guessed = merged.select(
        "name", "n_dates", "n_rows", sketches.distinct_keys("keys").alias("cells"), F.inline(sketches.quantiles("quantiles", SHARES))
    )
    inside = stored.join(sketches.dates_of(ranges), "file_date")
    cells_seen = inside.groupBy("name").agg(F.countDistinct("cell_id").alias("n_cells"))
    ranks = (
        inside.join(guessed.select("name", "share", "value"), "name").groupBy("name", "share")
        .agg((F.count_if(F.col("fwi") < F.col("value")) / F.count("*")).alias("below"), (F.count_if(F.col("fwi") <= F.col("value")) / F.count("*")).alias("upto"))
    )
    held = (F.col("below") <= F.col("share") + sketches.RANK_ERROR) & (F.col("upto") >= F.col("share") - sketches.RANK_ERROR)
    near = F.abs(F.col("cells") - F.col("n_cells")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("n_cells"))
    return guessed.join(ranks, ["name", "share"]).join(cells_seen, "name").select(
        F.col("name").alias("range_name"), "share", "n_dates", "n_rows", "n_cells", held.alias("rank_held"), near.alias("cells_held")
    )


BACKFILL_WINDOW = 10


def scores_of_every_date(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of every cell on each of its dates, by one pass over the history."""
    return rounded(history.accumulate_every_date(fx.wx_daily(spark, sf), SUMMER, BACKFILL_WINDOW))


def fire_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Fire points written as text and read by their reader."""
    path = scratch_dir(spark, "fires")
    points = fx.fires(spark, sf).selectExpr("latitude", "longitude", "cast(rep_date AS timestamp) AS rep_date", "size_ha")
    points.write.option("header", True).csv(path)
    return weather.read_fires(spark, path, "csv").withColumn("rep_date", F.col("rep_date").cast("date"))


def grid_job(spark: SparkSession, sf: str) -> DataFrame:
    """The grid as the grid job stores it and its reader finds it."""
    path = scratch_dir(spark, "grid")
    fx.fires(spark, sf).drop("fire_id").write.parquet(f"{path}/fires")
    jobs.build_grid(spark, weather.read_fires(spark, f"{path}/fires"), f"{path}/grid")
    return weather.read_grid(spark, f"{path}/grid")


def mapping_job(spark: SparkSession, sf: str) -> DataFrame:
    """Stations of the observed cells as the mapping job stores them."""
    path = scratch_dir(spark, "mapping")
    jobs.map_stations(spark, path, _observed_cells(spark, sf))
    return weather.read_mapping(spark, path)


def stored_result(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions of a whole scoring job, read by way of its envelope."""
    out = scratch_dir(spark, "run")
    jobs.score(spark, fx.wx_daily(spark, sf), _flagged_grid(spark, sf), out, SUMMER, "2024-01-31 00:00:00", keys=("cell_id",))
    return rounded(_flat(weather.read_result(spark, out)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        daily_snapshot,
        latest_n_dates,
        retention_drop_list,
        latest_snapshot,
        line_window_codes,
        sanitize_inputs,
        weather_features,
        rejects_by_reason,
        single_day_codes,
        accumulated_codes,
        fire_indices,
        risk_scores,
        danger_class_counts,
        run_stats,
        run_log_records,
        fallback_history,
        grid_coverage,
        fire_projection,
        nearest_station,
        historical_fire_flag,
        historical_fire_flag_polygon,
        province_of_cell,
        payload_flatten,
        payload_documents,
        station_fanout,
        fetch_summary,
        unknown_stations,
        payload_rejects,
        union_daily,
        partition_overwrite,
        bad_file_skip,
        rejects_report,
        freshness_audit,
        json_clean_values,
        stored_predictions,
        prediction_export,
        stream_ingest,
        late_payloads,
        stream_equals_batch,
        state_store_codes,
        predictions_in_box,
        risk_quantiles_by_range,
        scores_of_every_date,
        fire_scan,
        grid_job,
        mapping_job,
        stored_result,
    )
}
