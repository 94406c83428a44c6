"""Per-cell accumulation over a stream of observations.

The state of a cell is its newest daily inputs, not its codes: the accumulation restarts at
the oldest day of the window on every run, and the current day is replaced by each later
snapshot.  The state is kept as a table by day.  A micro-batch is reduced to its last row per
cell and day, merged with the rows of the days it touches, and those days are replaced; a
replayed micro-batch changes nothing.  Reading is the batch plan over the newest days, so no
expression of the indices exists twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import WINDOW_DATES
from emberline.functions.clean import index_inputs
from emberline.functions.fwi import with_fire_indices
from emberline.operators.history import accumulate_codes, last_per_day
from emberline.session import scratch_dir
from emberline.sources.payloads import exists
from emberline.sources.sinks import prune_history, write_daily
from emberline.sources.weather import read_window


def day_inputs(observations: DataFrame, order: str, float32: bool = True) -> DataFrame:
    """The cleaned inputs of each observation: what the state keeps.  Works on streams."""
    rows = index_inputs(observations, ["cell_id", "file_date", order], float32)
    return rows.withColumnsRenamed({order: "seq", "rain": "rain_1h_mm"})


def upsert_days(spark: SparkSession, rows: DataFrame, out: str) -> None:
    """Merge observations into the stored days: the last one of a cell and day stays.

    The merged days are written beside the table first, so that a day is never read and
    replaced at once.
    """
    fresh = last_per_day(rows, ["seq"])
    merged = fresh
    if exists(spark, out):
        # As many dates as the micro-batch spans.
        touched = [row["file_date"] for row in rows.select("file_date").distinct().collect()]
        stored = spark.read.parquet(out).filter(F.col("file_date").isin(touched))
        merged = last_per_day(stored.unionByName(fresh), ["seq"])
    aside = scratch_dir(spark, "days")
    merged.write.parquet(aside)
    write_daily(spark.read.schema(merged.schema).parquet(aside), out)


def start_window_stream(
    inputs: DataFrame, out: str, checkpoint: str, available_now: bool = True, window: int | None = None
):
    """Keep the table of days up to date with a stream of ``day_inputs``.

    With ``window`` the days beyond the newest ones are dropped after each micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_days(batch.sparkSession, batch, out)
            if window:
                prune_history(batch.sparkSession, out, window)

    writer = inputs.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def current_days(spark: SparkSession, out: str, window: int = WINDOW_DATES) -> DataFrame:
    """The stored days within the newest ``window`` dates over all cells."""
    return read_window(spark, out, window)


def codes_of_days(days: DataFrame, as_of_month: int) -> DataFrame:
    """All seven indices of each cell from its stored days."""
    return with_fire_indices(accumulate_codes(days, as_of_month, float32=False))
