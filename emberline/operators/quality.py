"""Freshness and completeness of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.constants import FRESH_HOURS, STALE_HOURS

STATUS = ["healthy", "degraded", "unhealthy"]


def _tier(age: Column, labels: list[str], absent: str) -> Column:
    fresh, stale, very_stale = labels
    return (
        F.when(age.isNull(), F.lit(absent))
        .when(age < FRESH_HOURS, F.lit(fresh))
        .when(age < STALE_HOURS, F.lit(stale))
        .otherwise(F.lit(very_stale))
    )


def freshness(
    component: str, df: DataFrame, stamp: str, as_of: Column, min_rows: int = 1, dates: str | None = None
) -> DataFrame:
    """One row on a table: rows, distinct dates, age at ``as_of``, freshness and status.

    Age is measured from the latest ``stamp``; dates are counted in the ``dates`` column, or
    in ``stamp``.  An empty table, or one below ``min_rows``, is unhealthy whatever its age.
    """
    moment = F.col(stamp)
    age = F.timestamp_diff("MICROSECOND", F.col("last_updated"), as_of) / F.lit(3.6e9)
    measured = df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.col(dates or stamp).cast("date")).alias("n_dates"),
        F.max(moment).alias("last_updated"),
    ).withColumn("age", age)
    status = F.when(F.col("n_rows") < min_rows, F.lit("unhealthy")).otherwise(
        _tier(F.col("age"), STATUS, "unhealthy")
    )
    return measured.select(
        F.lit(component).alias("component"),
        "n_rows",
        "n_dates",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        F.coalesce(F.round("age", 2), F.lit(0.0)).alias("age_hours"),
        F.coalesce(F.col("age") < FRESH_HOURS, F.lit(False)).alias("is_fresh"),
        _tier(F.col("age"), ["fresh", "stale", "very_stale"], "missing").alias("freshness"),
        status.alias("status"),
    )


def audit(components: list[DataFrame]) -> DataFrame:
    """All component rows, each with the worst status of the lot as ``overall_status``.

    There is one row per audited table, so the window over all of them is tiny, and each
    table is measured once.
    """
    rows = reduce(DataFrame.unionByName, components)
    labels = F.array(*[F.lit(s) for s in STATUS])
    worst = F.max(F.array_position(labels, F.col("status")).cast("int")).over(W.partitionBy())
    return rows.withColumn("overall_status", F.element_at(labels, worst))
