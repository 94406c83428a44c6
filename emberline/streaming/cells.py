"""The window of each cell as keyed state of a stream.

Of every cell the state is each date's last inputs, trimmed to the newest ``window`` dates of
the cell, as one value with an array per column: it is asked for once and stored once per
micro-batch, however many days that brings.  A micro-batch reads and writes the values of the
cells in it and emits their windows; those of other cells are not touched.  The sink keeps
what was emitted by micro-batch, a replayed one replaces itself, and a cell's current window
is the one of its last micro-batch.

A window over all cells is cut when it is read: a date among the newest ``n`` of all cells is
among the newest ``n`` of each cell that has it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from emberline.constants import WINDOW_DATES
from emberline.operators.history import newest_dates
from emberline.sources.payloads import exists

INPUTS = ["temperature", "humidity", "wind_speed", "rain_1h_mm"]
DAY_SCHEMA = "seq bigint, " + ", ".join(f"{name} double" for name in INPUTS)
EMITTED = f"cell_id bigint, day int, {DAY_SCHEMA}"
# The state needs a store with column families; its rows carry their schema, so that columns can be added.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "avro",
}


def _known(value: Any) -> Any:
    return None if value is None or value != value else value


class CellWindow(StatefulProcessor):
    """Keeps the newest days of one cell; rows come in any order.

    ``added`` are further inputs that were not kept from the start: in days stored before
    them they are NULL.
    """

    def __init__(self, window: int, added: tuple[str, ...] = ()) -> None:
        self.window = window
        self.columns = ["seq", *INPUTS, *added]
        self.emitted = Row("cell_id", "day", *self.columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"day": "int", "seq": "bigint"}
        self.days = handle.getValueState("days", ", ".join(f"{c} array<{kinds.get(c, 'double')}>" for c in ("day", *self.columns)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Of the stored days and all rows of the cell in this micro-batch only the last per day is held.
        whole = self._kept()
        changed = False
        for row in rows:
            day, seq = row["day"], row["seq"]
            if day not in whole or whole[day][0] < seq:
                whole[day] = tuple(_known(row[name]) for name in self.columns)
                changed = True
        newest = sorted(whole)[-self.window :]
        if changed:
            # The store takes no NULL within an array.
            columns = ([math.nan if value is None else value for value in column] for column in zip(*(whole[day] for day in newest)))
            self.days.update((newest, *columns))
        for day in newest:
            yield self.emitted(key[0], day, *whole[day])

    def _kept(self) -> dict[int, tuple]:
        """The stored days with their inputs; a column that was not stored yet is NULL."""
        stored = self.days.get()
        if stored is None:
            return {}
        days, *columns = stored
        return dict(zip(days, zip(*(map(_known, column or [None] * len(days)) for column in columns))))

    def close(self) -> None:
        pass


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """The settings of the store while a stream starts, which takes them along; other streams keep theirs."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start_cell_stream(
    inputs: DataFrame, out: str, checkpoint: str, available_now: bool = True, window: int = WINDOW_DATES, added: tuple[str, ...] = ()
):
    """Keep the windows of cells up to date with a stream of ``state.day_inputs``."""
    spark = inputs.sparkSession
    # A worker beside the driver reads the processor too; it knows none of the files shipped to executors.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    emitted = EMITTED + "".join(f", {name} double" for name in added)
    rows = inputs.where("cell_id IS NOT NULL AND file_date IS NOT NULL AND seq IS NOT NULL").selectExpr(
        "cast(cell_id AS bigint) AS cell_id", "unix_date(file_date) AS day", "cast(seq AS bigint) AS seq", *INPUTS, *added
    )
    windows = rows.groupBy("cell_id").transformWithState(CellWindow(window, added), emitted, "Update", "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        )

    writer = windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with _store(spark):
        return writer.foreachBatch(write).start()


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """Every window that was emitted, with its micro-batch."""
    return spark.read.option("mergeSchema", True).parquet(out).withColumn("batch", F.col("batch").cast("long"))


def current_windows(spark: SparkSession, out: str, window: int = WINDOW_DATES) -> DataFrame:
    """The days of each cell within the newest ``window`` dates over all cells: ``cell_id, file_date`` and inputs."""
    if not exists(spark, out):
        return spark.createDataFrame([], StructType.fromDDL(EMITTED)).withColumn("file_date", F.date_from_unix_date("day")).drop("day")
    emitted = read_windows(spark, out)
    last = emitted.groupBy("cell_id").agg(F.max("batch").alias("batch"))
    days = emitted.join(last, ["cell_id", "batch"], "left_semi").drop("batch")
    return newest_dates(days.withColumn("file_date", F.date_from_unix_date("day")).drop("day"), window)


def compact_windows(spark: SparkSession, out: str, into: str) -> None:
    """Write the current window of every cell alone, as one micro-batch, into a new folder.

    The stream may go on into that folder: what it emits later has greater numbers.
    """
    emitted = read_windows(spark, out)
    last = emitted.groupBy("cell_id").agg(F.max("batch").alias("batch"))
    newest = emitted.agg(F.max("batch")).scalar()
    current = emitted.join(last, ["cell_id", "batch"], "left_semi").withColumn("batch", newest)
    current.repartition("cell_id").write.mode("overwrite").partitionBy("batch").parquet(into)
