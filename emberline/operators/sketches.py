"""Statistics of runs and dates as sketches that can be merged over any range of dates.

A day's rows become one row: a KLL sketch of the values for quantiles, an HLL sketch of the
cells for distinct counts, and plain counts.  A question about a range of dates merges the
rows of its days and reads no observation again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameter of the KLL sketches.  Its normalised rank error is below RANK_ERROR with 99 % probability.
KLL_K = 400
RANK_ERROR = 0.01
# An HLL sketch of 2 ** 14 registers has a relative standard error of about 0.8 %.
HLL_LG_K = 14
DISTINCT_ERROR = 0.03


def daily_sketches(rows: DataFrame, value: str, key: str = "cell_id") -> DataFrame:
    """``file_date, n_rows, n_values, low, high, quantiles, keys``: one row per date.

    Rows of one date are summed up on the map side, so a date that holds most rows is no
    burden.  Missing and non-finite values count as rows only.
    """
    finite = F.when(F.abs(F.col(value).cast("double")) < float("inf"), F.col(value).cast("double"))
    return (
        rows.withColumn("sketched", finite).groupBy("file_date")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("sketched").alias("n_values"),
            F.min("sketched").alias("low"),
            F.max("sketched").alias("high"),
            F.kll_sketch_agg_double("sketched", KLL_K).alias("quantiles"),
            F.hll_sketch_agg(F.col(key).cast("bigint"), HLL_LG_K).alias("keys"),
        )
    )


def dates_of(ranges: DataFrame) -> DataFrame:
    """``name, file_date``: every date of every range, for a join by equality."""
    return ranges.select("name", F.explode(F.sequence("first", "last")).alias("file_date"))


def merged(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """The sketches of ``ranges`` (``name, first, last``), each over all its dates."""
    inside = sketches.join(dates_of(ranges), "file_date")
    return inside.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles"),
        F.hll_union_agg("keys").alias("keys"),
    )


def quantiles(sketch: str, shares: tuple[float, ...]) -> Column:
    """Array of (share, value): the values at shares of the sorted values; NULL without values."""
    found = F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*map(F.lit, shares)))
    pairs = F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), found.alias("value"))
    return F.when(F.col("n_values") > 0, pairs)


def distinct_keys(merged_keys: str) -> Column:
    """About how many different keys there are."""
    return F.hll_sketch_estimate(merged_keys)
