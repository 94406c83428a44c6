"""Daily history: last snapshot per day, the newest dates, and the accumulation over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.constants import WINDOW_DATES
from emberline.functions import fwi
from emberline.functions.clean import index_inputs

CELL = ("cell_id",)


def last_per_day(observations: DataFrame, order: list[str], keys: tuple[str, ...] = CELL) -> DataFrame:
    """The last observation of each cell and day, by the ``order`` columns.

    Together they should be unique per cell and day; add a tie-breaking column where they are not.
    ``max_by`` combines on the map side, so a cell holding a large share of the rows sends
    one row per day and map task through the shuffle.  A single numeric order column gives
    one fixed-width buffer per column, which keeps the aggregate in generated code.
    """
    groups = [*keys, "file_date"]
    rest = [c for c in observations.columns if c not in groups]
    if len(order) == 1:
        latest = F.col(order[0])
        aggs = [
            (F.max(latest) if c == order[0] else F.max_by(F.col(c), latest)).alias(c) for c in rest
        ]
        return observations.groupBy(*groups).agg(*aggs)
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return observations.groupBy(*groups).agg(picked).select(*groups, "last.*")


def newest_date(df: DataFrame, n: int = 1) -> Column:
    """The n-th newest distinct ``file_date`` as a scalar subquery (the oldest if fewer)."""
    newest = df.select("file_date").distinct().orderBy(F.desc("file_date")).limit(n)
    return newest.agg(F.min("file_date")).scalar()


def newest_dates(df: DataFrame, n: int = WINDOW_DATES) -> DataFrame:
    """Rows of the newest ``n`` distinct dates present, which need not be consecutive.

    The cut-off is one scalar, so the rows are filtered in the scan (and whole partitions
    are pruned in a table partitioned by date) without a join or a global window.
    """
    return df.filter(F.col("file_date") >= newest_date(df, n))


def expired_dates(df: DataFrame, n: int = WINDOW_DATES) -> DataFrame:
    """Distinct dates older than the newest ``n``: the partitions a retention run drops."""
    return df.select("file_date").distinct().filter(F.col("file_date") < newest_date(df, n))


def window_bounds(dates: DataFrame, n: int = WINDOW_DATES) -> tuple[Column, Column]:
    """The first and last of the newest ``n`` distinct dates: parts of one scalar, found once.

    ``dates`` may be any cheaper source of the same dates than the history itself.
    """
    newest = dates.select("file_date").distinct().orderBy(F.desc("file_date")).limit(n)
    both = newest.agg(F.struct(F.min("file_date").alias("first"), F.max("file_date").alias("last"))).scalar()
    return both.getField("first"), both.getField("last")


def latest_snapshot(df: DataFrame, stamp: str | None = None) -> DataFrame:
    """Rows of the newest date, or of the date written last according to a ``stamp`` column."""
    newest = F.max_by("file_date", stamp) if stamp else F.max("file_date")
    return df.filter(F.col("file_date") == df.agg(newest).scalar())


def daily_terms(
    history: DataFrame,
    as_of_month: int | str,
    keys: tuple[str, ...] = CELL,
    float32: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per cell and day, the weather-only terms of the index formulas, plus ``carry`` columns.

    The month is a number for the whole window, or the name of one of the ``carry`` columns.
    """
    fixed = [*keys, *carry, "file_date"]
    terms = [f"{term} AS {name}" for name, term in fwi.day_terms(as_of_month).items()]
    return index_inputs(history, fixed, float32).selectExpr(*fixed, "wind_speed", *terms)


# A day of weather terms as one struct that sorts by date.
DAY_STRUCT = f"struct(file_date, wind_speed, {', '.join(fwi.day_terms(1))})"


def ordered_series(days: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """One row per cell with its days as an array in date order.

    Expects one row per cell and day within the date window, so an array holds at most
    the window's number of entries whatever the size of the table.
    """
    return days.groupBy(*keys).agg(F.expr(f"array_sort(collect_list({DAY_STRUCT}))").alias("series"))


def accumulate_codes(
    history: DataFrame,
    as_of_month: int,
    keys: tuple[str, ...] = CELL,
    float32: bool = True,
) -> DataFrame:
    """FFMC, DMC and DC per cell after folding its daily rows in date order."""
    return fwi.fold_series(ordered_series(daily_terms(history, as_of_month, keys, float32), keys))


# Dates of one array of a cell, besides those of the window before them.
BLOCK_DATES = 366


def accumulate_every_date(
    history: DataFrame,
    as_of_month: int,
    window: int = WINDOW_DATES,
    keys: tuple[str, ...] = CELL,
    float32: bool = True,
    block: int = BLOCK_DATES,
) -> DataFrame:
    """The codes of each cell for every date it was seen on, as a run on that date would find them.

    ``last_date`` is that date; a run sees the newest ``window`` dates up to it.  The history
    (one row per cell and day) is read once for all dates: a cell's days are gathered in blocks
    of dates, with the window before each block, and every date folds its part of the array.
    """
    # A number per date: a list as long as the history has dates.
    dates = history.select("file_date").distinct()
    numbered = dates.withColumn("place", F.row_number().over(Window.orderBy("file_date")))
    days = daily_terms(history, as_of_month, keys, float32).join(numbered, "file_date")
    reach = -(-(block + window - 1) // block)
    blocks = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: F.floor(F.col("place") / block) + i),
        lambda b: b * block - F.col("place") < window,
    )
    entry = DAY_STRUCT.replace("struct(file_date,", "struct(file_date, place,")
    gathered = (
        days.withColumn("block", F.explode(blocks)).groupBy(*keys, "block")
        .agg(F.expr(f"array_sort(collect_list({entry}))").alias("days"))
    )
    own = f"filter(days, d -> floor(d.place / {block}) = block)"
    windows = gathered.selectExpr(
        *keys,
        f"explode(transform({own}, d -> filter(days, x -> x.place <= d.place AND x.place > d.place - {window}))) AS series",
    )
    return fwi.fold_series(windows)
