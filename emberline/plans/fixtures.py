"""Weather-shaped views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.constants import STATIONS
from emberline.operators.history import last_per_day
from emberline.session import local_table

# Station names of the payload fixture that are not on the list.
UNKNOWN_STATIONS = ["Nowhere One", "Nowhere Two"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several weather observations per cell and day."""
    return events_as_weather(table(spark, sf_dir, "events"))


def events_as_weather(events: DataFrame) -> DataFrame:
    """The same view over any events frame, batch or streaming."""
    return events.selectExpr(
        "event_id",
        "user_id AS cell_id",
        "41.0D + 0.5D * cast(user_id % 84 AS double) AS lat",
        "-141.0D + 0.5D * cast((user_id * 7) % 178 AS double) AS lon",
        "cast(ts AS date) AS file_date",
        """CASE WHEN event_type = 'error' THEN cast(NULL AS double)
                ELSE cast(cast(round(value * 100) AS bigint) % 500 AS double) / 10.0D - 10.0D
           END AS temperature""",
        "cast(cast(regexp_extract(props, '[0-9]+', 0) AS bigint) + 1 AS double) AS humidity",
        "cast((event_id * 13) % 250 AS double) / 10.0D AS wind_speed",
        """CASE WHEN event_id % 4 = 0
                THEN cast(cast(round(value * 100) AS bigint) % 120 AS double) / 10.0D
                ELSE 0.0D END AS rain_1h_mm""",
    )


def wx_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation per cell and day."""
    return last_per_day(wx_events(spark, sf_dir), ["event_id"])


def wx_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations spread over thousands of dates."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_suppkey AS cell_id",
        "cast(l_shipdate AS date) AS file_date",
        "l_quantity - 10.0D AS temperature",
        "cast(1 + l_linenumber * 14 AS double) AS humidity",
        "l_discount * 200.0D AS wind_speed",
        "l_tax * 100.0D AS rain_1h_mm",
    )


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical fire points."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS fire_id",
        "41.0D + cast((o_orderkey * 37) % 42000 AS double) / 1000.0D AS latitude",
        "-141.0D + cast((o_orderkey * 101) % 89000 AS double) / 1000.0D AS longitude",
        "o_orderdate AS rep_date",
        "o_totalprice / 100.0D AS size_ha",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed station payload per event, as JSON text.

    The station is picked from the known ones plus two that are not on the list; the kind of
    event number decides which parts of the object are missing, null, empty or of a wrong
    type, and which texts are cut short or are no object.
    """
    listed = list(enumerate([s[0] for s in STATIONS] + UNKNOWN_STATIONS))
    names = local_table(spark, listed, "station_no bigint, station string")
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_id AS n",
        "ts AS fetched_at",
        f"event_id % {len(STATIONS) + len(UNKNOWN_STATIONS)} AS station_no",
        "event_id % 5 AS kind",
        "CASE WHEN event_type = 'error' THEN 'null' ELSE cast(cast(value AS decimal(12,2)) AS string) END AS temp",
        "event_type AS sky",
    )
    body = """concat('{',
        CASE WHEN kind = 4 THEN ''
             ELSE concat('"main":{"temp":', temp, ',"humidity":', if(n % 13 = 0, '"high"', cast(n % 100 + 1 AS string)), ',"pressure":1001',
                         if(n % 3 = 0, concat(',"feels_like":', n % 31, '.5,"temp_min":', n % 17, ',"temp_max":null'), ''), '},') END,
        '"wind":{"speed":', n % 25,
            if(n % 4 = 0, concat(',"deg":', n % 360, ',"gust":', if(n % 8 = 0, 'null', cast(n % 40 AS string))), ''), '},',
        if(n % 3 = 1, concat('"clouds":{"all":', n % 101, '},'), ''),
        CASE WHEN n % 11 = 0 THEN '"visibility":"far",' WHEN n % 6 = 0 THEN concat('"visibility":', n % 9000, ',') ELSE '' END,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN '"rain":null,'
             ELSE concat('"rain":{"1h":', n % 7, if(n % 9 = 0, concat(',"3h":', n % 21), ''), '},') END,
        if(n % 10 = 0, concat('"snow":{"1h":', n % 4, ',"3h":null},'), ''),
        CASE WHEN kind = 3 THEN '"weather":[],'
             ELSE concat('"weather":[{"main":"', sky, '"', if(n % 4 = 1, concat(',"description":"', sky, ' sky"'), ''), '}],') END,
        '"dt":', 1700000000 + n, '}')"""
    text = f"CASE WHEN n % 53 = 7 THEN left({body}, 10) WHEN n % 59 = 8 THEN '[1]' ELSE {body} END"
    return events.join(names, "station_no").selectExpr("event_id", "fetched_at", "station", f"{text} AS payload")
