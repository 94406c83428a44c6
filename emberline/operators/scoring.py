"""From accumulated codes and today's weather to one prediction per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.constants import (
    FLOAT32_TODAY,
    GRID_LAT,
    GRID_LON,
    GRID_STEP,
    MODEL_CONFIDENCE,
    TODAY_DEFAULTS,
    WINDOW_DATES,
)
from emberline.functions.clean import as_float32, bounded, finite, total_precip
from emberline.functions.classify import adjusted_risk, base_risk, color_code, danger_class
from emberline.functions.fwi import INDEX_NAMES, fold_series, with_fire_indices
from emberline.functions.geo import province
from emberline.operators.history import (
    CELL,
    DAY_STRUCT,
    daily_terms,
    ordered_series,
    window_bounds,
)

PREDICTION_COLUMNS = [
    "lat", "lon", "location_name", "province", "daily_fire_risk", "danger_class", "color_code",
    "weather_features", "fire_weather_indices", "model_confidence",
]


def _reported(columns: list[str], name: str) -> str:
    """A weather value of today, NULL if missing; the default only if there is no such column."""
    return finite(name) if name in columns else f"{TODAY_DEFAULTS[name]}D"


def _flag(condition: str) -> str:
    return f"coalesce(cast({condition} AS int), 0)"


def weather_features(columns: list[str], danger_index: str) -> dict[str, str]:
    """Features of today's weather.  Missing values are reported as zero, missing flags as off."""
    value = {name: f"({_reported(columns, name)})" for name in TODAY_DEFAULTS}
    shown = {name: f"coalesce({source}, 0D)" for name, source in value.items()}
    precip = f"({total_precip(columns)})"
    precip_columns = ["rain_1h_mm", "rain_3h_mm", "snow_1h_mm", "snow_3h_mm"]
    return {
        **{name: shown[name] for name in ("temperature", "humidity", "wind_speed", "pressure")},
        "fire_danger_index": danger_index,
        **{name: shown[name] for name in precip_columns},
        "is_hot": _flag(f"{value['temperature']} > 25"),
        "is_dry": _flag(f"{value['humidity']} < 30"),
        "humidity_temp_ratio": f"coalesce(try_divide({value['humidity']}, {value['temperature']} + 1D), 0D)",
        "is_windy": _flag(f"{value['wind_speed']} > 15"),
        "total_precip": f"coalesce({precip}, 0D)",
        "has_recent_precip": _flag(f"{precip} > 0"),
        "weather_main_encoded": "0",
    }


REJECT_REASONS = ("ratio_divides_by_zero",)


def reject_reason(columns: list[str]) -> str:
    """Why a row cannot be scored; NULL if it can.

    The humidity/temperature ratio divides by the temperature plus one.
    """
    return f"CASE WHEN {_reported(columns, 'temperature')} = -1D THEN '{REJECT_REASONS[0]}' END"


def attach_fire_history(
    today: DataFrame, grid: DataFrame | None, on: tuple[str, ...] = ("lat", "lon")
) -> DataFrame:
    """Add ``historical_fire`` from the grid by position, 0 for unknown cells or without a grid.

    Positions are exact at the usual half-degree step; join other grids ``on`` a cell number.

    The join is left to the size known to Spark: a stored grid of the usual resolution is
    broadcast, a very fine one is not.
    """
    if grid is None:
        return today.withColumn("historical_fire", F.lit(0))
    flags = grid.select(*on, "historical_fire")
    return today.join(flags, list(on), "left").withColumn(
        "historical_fire", F.coalesce("historical_fire", F.lit(0))
    )


def today_codes(
    history: DataFrame,
    today: DataFrame,
    as_of_month: int,
    keys: tuple[str, ...] = CELL,
    float32: bool = True,
) -> DataFrame:
    """Today's rows with their indices: each cell's history folded, today alone if it has none.

    Today's side meets the history after it was gathered per cell, so the join reuses that
    partitioning, and only cells that report today are folded.
    """
    series = ordered_series(daily_terms(history, as_of_month, keys, float32), keys)
    rows = today.withColumn("row", F.struct(*today.columns))
    own = daily_terms(rows, as_of_month, keys, float32=False, carry=("row",))
    alone = own.selectExpr(*keys, "row", f"array({DAY_STRUCT}) AS alone")
    filled = alone.join(series, list(keys), "left").selectExpr("row", "coalesce(series, alone) AS series")
    return with_fire_indices(fold_series(filled)).select("row.*", *INDEX_NAMES)


def newest_codes(
    history: DataFrame,
    as_of_month: int,
    bounds: tuple[Column, Column],
    keys: tuple[str, ...] = CELL,
    float32: bool = True,
) -> DataFrame:
    """Rows of the window's last date with their indices, from one pass over the history.

    ``bounds`` are the window's first and last date.  A cell's row of the last date travels
    with its series, so the history is read, cleaned and shuffled once and joined with nothing.
    """
    first, last = bounds
    window = history.filter((F.col("file_date") >= first) & (F.col("file_date") <= last))
    rows = window.withColumn("row", F.when(F.col("file_date") == last, F.struct(*history.columns)))
    gathered = (
        daily_terms(rows, as_of_month, keys, float32, carry=("row",))
        .groupBy(*keys)
        .agg(F.expr(f"array_sort(collect_list({DAY_STRUCT})) AS series"), F.first("row", ignorenulls=True).alias("row"))
        .filter("row IS NOT NULL")
        .select("row", "series")
    )
    return with_fire_indices(fold_series(gathered)).select("row.*", *INDEX_NAMES)


def predictions(
    history: DataFrame,
    as_of_month: int,
    today: DataFrame | None = None,
    grid: DataFrame | None = None,
    window: int = WINDOW_DATES,
    keys: tuple[str, ...] = CELL,
    float32: bool = True,
    grid_on: tuple[str, ...] = ("lat", "lon"),
    dates: DataFrame | None = None,
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """All of today's cells with prediction columns and a ``reject_reason``.

    ``history`` has one row per cell and date; ``today`` defaults to its newest date.  Filter
    on ``reject_reason`` to separate results from rejects.  The window is known by its
    ``bounds``, or found in ``dates`` (any table of the same dates), or in the history.
    """
    bounds = bounds or window_bounds(history if dates is None else dates, window)
    if today is None:
        scored = newest_codes(history, as_of_month, bounds, keys, float32)
        scored = as_float32(scored, FLOAT32_TODAY) if float32 else scored
    else:
        snapshot = as_float32(today, FLOAT32_TODAY) if float32 else today
        scored = today_codes(history.filter(F.col("file_date") >= bounds[0]), snapshot, as_of_month, keys, float32)
    flagged = attach_fire_history(scored, grid, grid_on)
    known = flagged.columns
    classed = flagged.selectExpr("*", f"{bounded('fwi', 'fwi')} AS class_fwi").selectExpr(
        "*", f"{base_risk('class_fwi')} AS base_risk"
    )
    features = ", ".join(f"{text} AS {name}" for name, text in weather_features(known, "fwi").items())
    return classed.selectExpr(
        *[k for k in keys if k not in ("lat", "lon")],
        f"{finite('lat')} AS lat",
        f"{finite('lon')} AS lon",
        f"{location_name(known)} AS location_name",
        f"{province('lat', 'lon')} AS province",
        f"{adjusted_risk('base_risk', 'historical_fire')} AS daily_fire_risk",
        f"{danger_class('class_fwi')} AS danger_class",
        f"{color_code('class_fwi')} AS color_code",
        f"struct({features}) AS weather_features",
        f"struct({', '.join(INDEX_NAMES)}) AS fire_weather_indices",
        f"{MODEL_CONFIDENCE}D AS model_confidence",
        f"{reject_reason(known)} AS reject_reason",
    )


def location_name(columns: list[str]) -> str:
    """The nearest station, else a label with the cell's number.

    Without a number column it is the cell's place in the usual grid, row by row.
    """
    across = round((GRID_LON[1] - GRID_LON[0]) / GRID_STEP)
    row, column = (f"round(({c} - ({low}D)) / {GRID_STEP}D)" for c, (low, _) in (("lat", GRID_LAT), ("lon", GRID_LON)))
    number = "cell_id" if "cell_id" in columns else f"cast({row} * {across} + {column} AS bigint)"
    label = f"concat('Grid_', {number})"
    return f"coalesce(nearest_station, {label})" if "nearest_station" in columns else label


def accepted(scored: DataFrame) -> DataFrame:
    """Rows that were scored."""
    return scored.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(scored: DataFrame) -> DataFrame:
    """Rows that could not be scored, with the reason."""
    return scored.filter(F.col("reject_reason").isNotNull())
