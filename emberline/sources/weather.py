"""Readers of the weather history, fire points, grid, mapping and predictions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import MISSING_TOKENS, WINDOW_DATES
from emberline.sources import daily_files

# Columns of a daily weather file in the order they are written.
DAILY_TEXT = ["date", "nearest_station", "weather_main", "weather_description"]
DAILY_COLUMNS = [
    "lat", "lon", "date", "nearest_station", "temperature", "humidity", "wind_speed", "feels_like",
    "temp_min", "temp_max", "pressure", "wind_deg", "wind_gust", "clouds_pct", "visibility_m",
    "rain_1h_mm", "rain_3h_mm", "snow_1h_mm", "snow_3h_mm", "weather_main", "weather_description",
    "timestamp_utc",
]
DAILY_NUMBERS = [c for c in DAILY_COLUMNS if c not in DAILY_TEXT]

FIRE_SCHEMA = "latitude double, longitude double, rep_date timestamp, size_ha double"
GRID_SCHEMA = "lat double, lon double, historical_fire int"
MAPPING_SCHEMA = "lat double, lon double, nearest_station_name string"


def newest_files(spark: SparkSession, folder: str, n: int = WINDOW_DATES) -> list[str]:
    """Paths of the newest ``n`` daily files, by the date in their name.

    Only the file listing is read.  The list is as long as the window at most.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    newest = listing.select("path", name.alias("name")).orderBy(F.desc("name")).limit(n)
    return [row["path"] for row in newest.collect()]


def read_daily_files(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Daily CSV files as text columns plus ``file_name`` and ``file_date``.

    Files with one header are one scan, and scans are put together by column name; a column
    that a file lacks is NULL in its rows.  ``columns`` are there in any case.
    """
    if not paths:
        raise FileNotFoundError("no daily weather files")
    groups = headers(spark, paths)
    frames = [_scan(spark, some, header) for header, some in sorted(groups.items())]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return raw.withColumns({c: F.lit(None).cast("string") for c in columns or DAILY_COLUMNS if c not in raw.columns})


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths by the columns that their first line names; one job over the window's files."""
    heads = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # Of a file's first block the first row is its first line.
    first = heads.where("block = 0").groupBy("path").agg(F.first("value").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.collect():
        names = [name.strip().strip('"') for name in row["header"].strip("\r\ufeff").split(",")]
        found.setdefault(tuple(names), []).append(row["path"])
    return found


def _scan(spark: SparkSession, paths: list[str], header: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in header)
    return _with_file_date(spark.read.option("header", True).schema(schema).csv(sorted(paths)))


def _with_file_date(df: DataFrame) -> DataFrame:
    name = F.col("_metadata.file_name")
    return df.withColumns(
        {"file_name": name, "file_date": F.regexp_replace(name, r"\.csv$", "").cast("date")}
    )


# Fixed value: what counts as a number in a daily file.  Suffixes of types are no numbers.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf(inity)?|INF(INITY)?)$"


def is_number(text: Column) -> Column:
    """Whether a text is a number, with blanks around it or not."""
    return F.trim(text).rlike(NUMBER)


def unreadable_files(raw: DataFrame, numbers: list[str] = DAILY_NUMBERS) -> DataFrame:
    """Names of files with text in a numeric column that is neither a number nor "missing"."""
    bad = F.lit(False)
    for c in (c for c in numbers if c in raw.columns):
        bad = bad | (F.col(c).isNotNull() & ~F.col(c).isin(MISSING_TOKENS) & ~is_number(F.col(c)))
    return raw.filter(bad).select("file_name").distinct()


def typed_daily(raw: DataFrame, numbers: list[str] = DAILY_NUMBERS) -> DataFrame:
    """Whole files that parse, with numeric columns typed; a bad file is left out as a whole."""
    return _typed(raw.join(unreadable_files(raw, numbers), "file_name", "left_anti"), numbers)


def _typed(good: DataFrame, numbers: list[str]) -> DataFrame:
    typed = {
        c: F.col(c).try_cast("bigint" if c == "timestamp_utc" else "double")
        for c in numbers if c in good.columns
    }
    return good.withColumns(typed).drop("file_name")


def load_history(
    spark: SparkSession, folder: str, n: int = WINDOW_DATES, columns: list[str] | None = None
) -> DataFrame:
    """The newest ``n`` daily files of a folder, bad files skipped.

    Each file is opened once, by the task that reads it.  Where only Spark's own file systems
    reach the folder, it is read by ``typed_daily(read_daily_files(...))``: the same rows.
    """
    wanted = columns or DAILY_COLUMNS
    numbers = [c for c in wanted if c not in DAILY_TEXT]
    try:
        daily_files.file_system(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return typed_daily(read_daily_files(spark, newest_files(spark, folder, n), columns), numbers)
    return _typed(daily_files.read_daily_folder(spark, folder, wanted, numbers, NUMBER, MISSING_TOKENS, n), numbers)


def partition_dates(spark: SparkSession, path: str) -> list[date]:
    """The dates of a history folder, from the names of its folders: no file is listed or opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        raise FileNotFoundError(path)
    names = [entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory()]
    return [date.fromisoformat(name.partition("=")[2]) for name in names if name.startswith("file_date=")]


def read_window(spark: SparkSession, path: str, n: int = WINDOW_DATES) -> DataFrame:
    """The newest ``n`` dates of a history folder; no file of another date is opened."""
    newest = sorted(partition_dates(spark, path))[-n:]
    return spark.read.parquet(path).filter(F.col("file_date").isin(newest))


def read_history_table(spark: SparkSession, path: str) -> DataFrame:
    """The weather history kept as Parquet, partitioned by ``file_date``."""
    return spark.read.parquet(path)


def read_fires(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Historical fire points."""
    reader = spark.read.schema(FIRE_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` returns, or None if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_grid(spark: SparkSession, path: str) -> DataFrame | None:
    """The grid with its fire flags, or None if it was never built."""
    return if_present(lambda: spark.read.option("header", True).schema(GRID_SCHEMA).csv(path))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The cell to station mapping; required."""
    return spark.read.option("header", True).schema(MAPPING_SCHEMA).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions; empty ones are an error.  Filters and columns reach the scan."""
    stored = spark.read.parquet(path)
    if stored.isEmpty():
        raise ValueError("no prediction data available")
    return stored


def read_result(spark: SparkSession, out: str) -> DataFrame:
    """Predictions of the last run, if its envelope says that it succeeded."""
    envelope = spark.read.json(f"{out}/envelope")
    if "success" not in envelope.columns or envelope.filter("success").isEmpty():
        raise ValueError("invalid prediction data")
    return read_predictions(spark, f"{out}/predictions/parquet")
