"""Writers of the daily history, grid, mapping, predictions and run log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberline.constants import MODEL_INFO, WINDOW_DATES
from emberline.functions.clean import json_clean
from emberline.functions.geo import curve_key
from emberline.operators.history import expired_dates, newest_dates
from emberline.sources.weather import partition_dates


def write_daily(df: DataFrame, path: str) -> None:
    """Write days of weather, each replacing that day's partition and no other.

    Rows are rebalanced by date first: a small day becomes one file, a large one is split
    into files of the advisory size, and no day is left to a single task.
    """
    (
        df.hint("rebalance", F.col("file_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_date")
        .parquet(path)
    )


def create_history_table(df: DataFrame, table: str, buckets: int) -> None:
    """Keep the history as a table partitioned by date and bucketed by ``cell_id``.

    Scoring gathers each cell's days; on this table it does so without any shuffle.
    """
    (
        df.repartition(buckets, "cell_id")
        .write.partitionBy("file_date")
        .bucketBy(buckets, "cell_id")
        .sortBy("cell_id")
        .format("parquet")
        .saveAsTable(table)
    )


def replace_day(df: DataFrame, table: str, day: date, buckets: int) -> None:
    """Replace one date of a history table; ``buckets`` as the table was created with.

    The partition is named in the statement, so no setting can widen what is overwritten.
    """
    spark = df.sparkSession
    columns = ", ".join(c for c in spark.table(table).columns if c != "file_date")
    spark.sql(
        f"INSERT OVERWRITE TABLE {table} PARTITION (file_date = DATE'{day}') SELECT {columns} FROM {{rows}}",
        rows=df.repartition(buckets, "cell_id"),
    )


def drop_expired(spark: SparkSession, table: str, n: int = WINDOW_DATES) -> list:
    """Drop the partitions older than the newest ``n`` dates of a history table."""
    partitions = spark.sql(f"SHOW PARTITIONS {table}")
    dates = partitions.selectExpr("cast(split(partition, '=')[1] AS date) AS file_date")
    # One row per date of the table.
    expired = [row["file_date"] for row in expired_dates(dates, n).collect()]
    for day in expired:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (file_date = DATE'{day}')")
    return sorted(expired)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the grid or the station mapping."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def retain_latest(df: DataFrame, path: str, n: int) -> None:
    """Write only the newest ``n`` dates of a history to a new location."""
    write_daily(newest_dates(df, n), path)


def expired_partitions(spark: SparkSession, path: str, n: int = WINDOW_DATES) -> list[date]:
    """Dates of a history folder that are older than its newest ``n``; only its listing is read."""
    dates = sorted(partition_dates(spark, path))
    return dates[:-n] if n else dates


def prune_history(spark: SparkSession, path: str, n: int = WINDOW_DATES) -> list[date]:
    """Delete the partitions of a history folder beyond its newest ``n`` dates; returns them."""
    expired = expired_partitions(spark, path, n)
    if expired:
        jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for day in expired:
            files.delete(jvm.org.apache.hadoop.fs.Path(root, f"file_date={day}"), True)
    return expired


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as Parquet for queries and as JSON lines for consumers.

    The lines are made from the stored Parquet, so the predictions are computed once.
    """
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    stored = df.sparkSession.read.parquet(f"{path}/parquet")
    json_clean(stored).write.mode("overwrite").json(f"{path}/json")


def cluster_predictions(stored: DataFrame, path: str, group_bytes: int = 16 << 20) -> None:
    """Stored predictions once more, in order of a space-filling curve.

    A file and each of its row groups then covers a small box, so that a filter on latitude
    and longitude leaves out most of them by their statistics.  Reads ``stored`` twice: once to
    find the borders of the files.
    """
    key = F.expr(curve_key("lat", "lon"))
    ordered = stored.withColumn("along", key).repartitionByRange("along").sortWithinPartitions("along").drop("along")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column]) -> dict:
    """Write ``df`` as Parquet; aggregates over its rows come from the tasks that write them."""
    seen = Observation()
    df.observe(seen, *[metric.alias(name) for name, metric in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def envelope(stats: DataFrame, run_ts: Column) -> DataFrame:
    """One row that describes a run: model information, statistics and times."""
    info = [
        (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in MODEL_INFO.items()
    ]
    return stats.select(
        F.lit(True).alias("success"),
        F.struct(*info).alias("model_info"),
        F.struct(*stats.columns).alias("processing_stats"),
        run_ts.alias("timestamp"),
        run_ts.alias("last_updated"),
    )


def append_run_log(stats: DataFrame, path: str, run_ts: Column, seconds: float) -> None:
    """Append one run to the run log."""
    (
        stats.withColumns({"processing_time_seconds": F.lit(float(seconds)), "run_ts": run_ts})
        .coalesce(1)
        .write.mode("append")
        .parquet(path)
    )
