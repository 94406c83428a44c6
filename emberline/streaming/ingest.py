"""Payload files as they land, spread over the grid and written as daily partitions.

What a date's weather can still depend on is kept: of each micro-batch the last readings in
the last run of each date, as flat rows by date and micro-batch.  A date that a micro-batch
touches is built anew from these, by the same functions as in batch, so neither the order of
files nor the borders of micro-batches matter.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import fanout
from emberline.operators.spatial import stations
from emberline.sources import payloads as landed
from emberline.session import scratch_dir
from emberline.sources.sinks import prune_history, write_daily


def station_rows(payloads: DataFrame) -> DataFrame:
    """Flat weather of known stations with date and run, one row per readable payload."""
    known = fanout.known_payloads(payloads, stations(payloads.sparkSession))
    return fanout.with_run(landed.daily_columns(landed.flatten_payloads(known)))


def land(payloads: DataFrame, store: str, batch_id: int = 0) -> list[date]:
    """Keep what the readable payloads leave of each date; returns the dates.

    The same batch again replaces what it wrote before.
    """
    # Parsed once, read by three steps.
    rows = station_rows(payloads).persist()
    try:
        (
            fanout.rows_of_last_runs(rows).withColumn("batch", F.lit(batch_id)).hint("rebalance", F.col("file_date"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("file_date", "batch").parquet(store)
        )
        # As many dates as the micro-batch spans.
        return [row["file_date"] for row in rows.select("file_date").distinct().collect()]
    finally:
        rows.unpersist()


def read_landed(spark, store: str) -> DataFrame:
    """All rows kept by ``land``; a filter on ``file_date`` reaches the file listing."""
    return spark.read.parquet(store).drop("batch")


def compact_landed(spark: SparkSession, store: str, window: int | None = None) -> list[date]:
    """Leave one folder of each date's micro-batches, with what they come to together.

    With ``window`` the dates beyond the newest ones are dropped.  The rows of a date go into
    the folder of its last micro-batch before the others are deleted, so a job that stops in
    between leaves nothing but rows that count once anyway; the same holds for a micro-batch
    that is replayed after it.  Returns the dates that were put together.
    """
    if window:
        prune_history(spark, store, window)
    # One row per date and micro-batch, from the listing alone.
    folders: dict[str, set[int]] = {}
    for file in spark.read.parquet(store).inputFiles():
        day, _, rest = file.rpartition("file_date=")[2].partition("/batch=")
        folders.setdefault(day, set()).add(int(rest.partition("/")[0]))
    several = {day: batches for day, batches in folders.items() if len(batches) > 1}
    if not several:
        return []
    rows = spark.read.parquet(store).filter(F.col("file_date").isin([date.fromisoformat(day) for day in several]))
    aside = scratch_dir(spark, "landed")
    last = rows.groupBy("file_date").agg(F.max("batch").alias("batch"))
    fanout.rows_of_last_runs(rows.drop("batch")).join(last, "file_date").write.parquet(aside)
    (
        spark.read.parquet(aside).hint("rebalance", F.col("file_date"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_date", "batch").parquet(store)
    )
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for day, batches in several.items():
        for batch in sorted(batches)[:-1]:
            files.delete(path(f"{store}/file_date={day}/batch={batch}"), True)
    return sorted(date.fromisoformat(day) for day in several)


def build_dates(landed_rows: DataFrame, cell_station: DataFrame) -> DataFrame:
    """Grid weather of each date from the last run of that date."""
    stamp = landed.local_date_text(F.col("timestamp_utc").cast("timestamp"))
    return fanout.spread_by_date(fanout.last_run_per_date(landed_rows), cell_station).withColumn("date", stamp)


def start_ingest(
    payloads: DataFrame, cell_station: DataFrame, path: str, checkpoint: str, available_now: bool = True, store: str | None = None
):
    """Keep the daily history up to date, by default from what is kept beside the checkpoint.

    A micro-batch without any usable payload writes nothing.
    """
    store = store or f"{checkpoint.rstrip('/')}-landed"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = land(batch, store, batch_id)
        if touched:
            rows = read_landed(spark, store).filter(F.col("file_date").isin(touched))
            write_daily(build_dates(rows, cell_station), path)

    writer = payloads.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def first_arrivals(payloads: DataFrame, delay: str) -> DataFrame:
    """Each payload of a stream once, as long as it is not older than the newest by more than ``delay``.

    What was seen is remembered for that long and then forgotten, so the state is bounded by
    the payloads of ``delay``.  Older ones are dropped.
    """
    known = payloads.withColumn("digest", F.sha2("payload", 256)).withWatermark("fetched_at", delay)
    return known.dropDuplicatesWithinWatermark(["station", "fetched_at", "digest"]).drop("digest")


def start_landing(payloads: DataFrame, path: str, checkpoint: str, delay: str, available_now: bool = True):
    """Keep the first arrivals of a stream of payloads, by date."""
    rows = first_arrivals(payloads, delay).withColumn("file_date", F.col("fetched_at").cast("date"))
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("file_date")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def landing_counts(query) -> dict[str, int]:
    """What a landing has read, and how much of it was repeated or late, by its progress reports."""
    counts = {"read": 0, "repeated": 0, "late": 0}
    for progress in query.recentProgress:
        (operator,) = progress.stateOperators or [None]
        counts["read"] += progress.numInputRows
        if operator is not None:
            counts["late"] += operator.numRowsDroppedByWatermark
            counts["repeated"] += operator.customMetrics.get("numDroppedDuplicateRows", 0)
    return counts
