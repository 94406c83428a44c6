"""The registered queries again, in SQL for another engine.

Written from the formulas, apart from the DataFrame code: the accumulation is a recursive
query that evaluates each whole equation per day, the radius join is a band join, and the
nearest station a plain minimum over all pairs.
"""

from __future__ import annotations

import re

from emberline.constants import (
    DANGER_CLASSES,
    MONTH_FACTORS,
    PROVINCE_BOXES,
    PROVINCE_PRIORITY,
    STATIONS,
)
from emberline.plans.catalog import BACKFILL_WINDOW, BOX, LATE_AFTER, RANGES, SHARES, SPRING, SUMMER
from emberline.plans.fixtures import UNKNOWN_STATIONS


def doubles(sql: str) -> str:
    """Turn decimal literals into double literals."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def f32(column: str) -> str:
    return f"cast(cast({column} AS float) AS double)"


def rnd(column: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({column}, {digits}) + 0.0 AS {name or column}"


WX_EVENTS = """wx_events AS (
  SELECT event_id, user_id AS cell_id,
    41.0 + 0.5 * cast(user_id % 84 AS double) AS lat,
    -141.0 + 0.5 * cast((user_id * 7) % 178 AS double) AS lon,
    cast(ts AS date) AS file_date,
    CASE WHEN event_type = 'error' THEN cast(NULL AS double)
         ELSE cast(cast(round(value * 100) AS bigint) % 500 AS double) / 10.0 - 10.0 END AS temperature,
    cast(cast(regexp_extract(props, '[0-9]+', 0) AS bigint) + 1 AS double) AS humidity,
    cast((event_id * 13) % 250 AS double) / 10.0 AS wind_speed,
    CASE WHEN event_id % 4 = 0
         THEN cast(cast(round(value * 100) AS bigint) % 120 AS double) / 10.0
         ELSE 0.0 END AS rain_1h_mm
  FROM events)"""

WX_DAILY = (
    WX_EVENTS
    + """,
wx_daily AS (
  SELECT * FROM wx_events
  QUALIFY row_number() OVER (PARTITION BY cell_id, file_date ORDER BY event_id DESC) = 1)"""
)

WX_LINE = """wx_line AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    l_suppkey AS cell_id, cast(l_shipdate AS date) AS file_date,
    l_quantity - 10.0 AS temperature, cast(1 + l_linenumber * 14 AS double) AS humidity,
    l_discount * 200.0 AS wind_speed, l_tax * 100.0 AS rain_1h_mm
  FROM lineitem),
line_ranked AS (SELECT *, dense_rank() OVER (ORDER BY file_date DESC) AS date_rank FROM wx_line)"""

FIRES = """fires AS (
  SELECT o_orderkey AS fire_id,
    41.0 + cast((o_orderkey * 37) % 42000 AS double) / 1000.0 AS latitude,
    -141.0 + cast((o_orderkey * 101) % 89000 AS double) / 1000.0 AS longitude
  FROM orders)"""

GRID = """grid AS (
  SELECT range AS cell_id, 41.0 + 0.5 * (range // 178) AS lat, -141.0 + 0.5 * (range % 178) AS lon FROM range(14952))"""

# Lambert conformal conic on GRS80, from the registry parameters.
CONE = """k0 AS (
  SELECT sqrt(f * (2.0 - f)) AS e, radians(49.0) AS p1, radians(77.0) AS p2, radians(63.390675) AS p0
  FROM (SELECT 1.0 / 298.257222101 AS f) c),
k1 AS (
  SELECT e,
    cos(p1) / sqrt(1.0 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1.0 - pow(e * sin(p2), 2)) AS m2,
    tan(pi() / 4 - p0 / 2) / pow((1.0 - e * sin(p0)) / (1.0 + e * sin(p0)), e / 2) AS t0,
    tan(pi() / 4 - p1 / 2) / pow((1.0 - e * sin(p1)) / (1.0 + e * sin(p1)), e / 2) AS t1,
    tan(pi() / 4 - p2 / 2) / pow((1.0 - e * sin(p2)) / (1.0 + e * sin(p2)), e / 2) AS t2
  FROM k0),
k2 AS (SELECT e, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n, m1, t1, t0 FROM k1),
cone AS (
  SELECT e, n, 6378137.0 * m1 / (n * pow(t1, n)) AS s, 6378137.0 * m1 / (n * pow(t1, n)) * pow(t0, n) AS r0
  FROM k2)"""


def projected(name: str, source: str, lat: str = "lat", lon: str = "lon") -> str:
    """CTE ``name``: all columns of ``source`` plus x and y."""
    return f"""{name} AS (
  SELECT * EXCLUDE (rho, theta),
    6200000.0 + rho * sin(theta) AS x,
    3000000.0 + (SELECT r0 FROM cone) - rho * cos(theta) AS y
  FROM (
    SELECT g.*,
      s * pow(tan(pi() / 4 - radians({lat}) / 2)
              / pow((1.0 - e * sin(radians({lat}))) / (1.0 + e * sin(radians({lat}))), e / 2), n) AS rho,
      n * radians({lon} + (91.0 + 52.0 / 60.0)) AS theta
    FROM {source} g, cone) p)"""


STATION_LIST = "station_list AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {text(name)}, {lat!r}, {lon!r})" for i, (name, lat, lon) in enumerate(STATIONS)
) + ") v(station_ord, name, lat, lon))"

# Name of the station that sent an event's payload.
ALL_NAMES = "[" + ", ".join(text(n) for n in [s[0] for s in STATIONS] + UNKNOWN_STATIONS) + "]"
KNOWN = len(STATIONS)
NAMED = len(STATIONS) + len(UNKNOWN_STATIONS)


def accumulated(source: str, month: int, rain: str = f32("rain_1h_mm")) -> str:
    """CTEs ``clean``, ``fold`` and ``codes`` for the days in ``source``."""
    factor = repr(MONTH_FACTORS[month - 1])

    def clip(value: str, default: str, low: str, high: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN {default} ELSE least(greatest({value}, {low}), {high}) END"

    dry_rate = (
        "(0.424 * (1.0 - pow(h / 100.0, 1.7)) + 0.0694 * sqrt(w) * (1.0 - pow(h / 100.0, 8.0)))"
        " * 0.581 * exp(0.0365 * t)"
    )
    wet_rate = (
        "(0.424 * (1.0 - pow((100.0 - h) / 100.0, 1.7)) + 0.0694 * sqrt(w)"
        " * (1.0 - pow((100.0 - h) / 100.0, 8.0))) * 0.581 * exp(0.0365 * t)"
    )
    common = "0.18 * (21.1 - t) * (1.0 - exp(-0.115 * h))"
    return f"""clean AS (
  SELECT cell_id, file_date, row_number() OVER (PARTITION BY cell_id ORDER BY file_date) AS k,
    {clip(f32('temperature'), '15.0', '-50.0', '50.0')} AS t,
    {clip(f32('humidity'), '50.0', '1.0', '100.0')} AS h,
    {clip(f32('wind_speed'), '10.0', '0.0', '100.0')} AS w,
    {clip(rain, '0.0', '0.0', '500.0')} AS r
  FROM {source}),
fold AS (
  SELECT DISTINCT cell_id, cast(0 AS bigint) AS k, 85.0 AS ffmc, 6.0 AS dmc, 15.0 AS dc,
    cast(NULL AS double) AS w, cast(NULL AS date) AS d
  FROM clean
  UNION ALL
  SELECT cell_id, k,
    least(greatest(59.5 * (250.0 - m) / (147.2 + m), 0.0), 101.0) AS ffmc,
    dmc, dc, w, d
  FROM (
    SELECT cell_id, k, dmc, dc, w, d,
      CASE WHEN mr > ed THEN ed + (mr - ed) * pow(10.0, -({dry_rate}))
           WHEN mr < ew THEN ew - (ew - mr) * pow(10.0, -({wet_rate}))
           ELSE mr END AS m
    FROM (
      SELECT *,
        CASE WHEN r > 0.5 THEN least(250.0,
               mo + 42.5 * (r - 0.5) * exp(-100.0 / (251.0 - mo)) * (1.0 - exp(-6.93 / (r - 0.5)))
               + CASE WHEN mo > 150.0 THEN 0.0015 * (mo - 150.0) * (mo - 150.0) * sqrt(r - 0.5) ELSE 0.0 END)
             ELSE mo END AS mr,
        0.942 * pow(h, 0.679) + 11.0 * exp((h - 100.0) / 10.0) + {common} AS ed,
        0.618 * pow(h, 0.753) + 10.0 * exp((h - 100.0) / 10.0) + {common} AS ew
      FROM (
        SELECT c.cell_id, c.k, c.t, c.h, c.w, c.r, c.file_date AS d,
          147.2 * (101.0 - f.ffmc) / (59.5 + f.ffmc) AS mo,
          CASE WHEN c.t < -1.1 THEN least(f.dmc, 500.0)
               ELSE greatest(0.0,
                 CASE WHEN c.r > 1.5 THEN greatest(0.0, least(f.dmc, 500.0) + 1000.0 * (0.92 * c.r - 1.27)
                   / (48.77 + (0.92 * c.r - 1.27) *
                      CASE WHEN least(f.dmc, 500.0) <= 20.0 + 280.0 / exp(0.023 * least(f.dmc, 500.0))
                           THEN 100.0 / (0.5 + 0.3 * least(f.dmc, 500.0))
                           ELSE 14.0 - 1.3 * ln(least(f.dmc, 500.0) + 1.0) END))
                   ELSE least(f.dmc, 500.0) END
                 + CASE WHEN c.t > -1.1
                        THEN 100.0 * 1.894 * (c.t + 1.1) * (100.0 - c.h) * ({factor}) * 0.000001
                        ELSE 0.0 END) END AS dmc,
          CASE WHEN c.t < -2.8 THEN least(f.dc, 1000.0)
               ELSE CASE WHEN c.r > 2.8 THEN greatest(0.0, least(f.dc, 1000.0) - 400.0 * ln(1.0
                      + 3.937 * (0.83 * c.r - 1.27) / (800.0 * exp(-least(f.dc, 1000.0) / 400.0))))
                    ELSE least(f.dc, 1000.0) END
                 + CASE WHEN c.t > -2.8 THEN greatest(0.0, 0.36 * (c.t + 2.8) + ({factor})) ELSE 0.0 END
               END AS dc
        FROM fold f JOIN clean c ON c.cell_id = f.cell_id AND c.k = f.k + 1) s1) s2) s3),
codes AS (
  SELECT cell_id, d AS last_date, w AS last_wind, ffmc, dmc, dc FROM fold
  QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY k DESC) = 1)"""


INDICES = """spread AS (
  SELECT *,
    0.208 * exp(0.05039 * last_wind) * 91.9 * exp(-0.1386 * fm) * (1.0 + pow(fm, 5.31) / 49300000.0) AS isi,
    greatest(0.0, CASE WHEN p <= 0.4 * q THEN 0.8 * p * q / (p + 0.4 * q + 0.001)
      ELSE p - (1.0 - 0.8 * q / (p + 0.4 * q + 0.001)) * (0.92 + pow(0.0114 * p, 1.7)) END) AS bui
  FROM (SELECT *, 147.2 * (101.0 - ffmc) / (59.5 + ffmc) AS fm, least(dmc, 500.0) AS p, least(dc, 1000.0) AS q
        FROM codes) c),
intensity AS (
  SELECT *, 0.1 * least(isi, 100.0) * CASE WHEN least(bui, 500.0) <= 80.0
    THEN 0.626 * pow(least(bui, 500.0), 0.809) + 2.0
    ELSE 1000.0 / (25.0 + 108.64 * exp(-0.023 * least(bui, 500.0))) END AS b
  FROM spread),
rated AS (
  SELECT *, CASE WHEN b > 1.0 THEN exp(2.72 * pow(0.434 * ln(greatest(b, 1.0)), 0.647)) ELSE b END AS fwi
  FROM intensity),
indices AS (SELECT *, 0.0272 * pow(fwi, 1.77) AS dsr FROM rated)"""


def burned(limit: str = "25000.0") -> str:
    """CTE ``flagged``: the grid with its fire flag; needs grid_xy and fires_xy."""
    return f"""banded AS (
  SELECT x, y, cast(floor(y / 25000.0) AS bigint) + d AS band FROM fires_xy, (VALUES (-1), (0), (1)) o(d)),
near AS (
  SELECT DISTINCT g.cell_id
  FROM grid_xy g JOIN banded f ON f.band = cast(floor(g.y / 25000.0) AS bigint)
  WHERE sqrt((f.x - g.x) * (f.x - g.x) + (f.y - g.y) * (f.y - g.y)) < {limit}),
flagged AS (
  SELECT grid.cell_id, grid.lat, grid.lon, cast(near.cell_id IS NOT NULL AS int) AS historical_fire
  FROM grid LEFT JOIN near USING (cell_id))"""


# Distance to the edge of a 64-sided polygon with corners on the circle, in the point's direction.
POLYGON_EDGE = """25000.0 * cos(pi() / 64) / cos(
    (atan2(f.y - g.y, f.x - g.x) + 2 * pi()) - (pi() / 32) * floor((atan2(f.y - g.y, f.x - g.x) + 2 * pi()) / (pi() / 32))
    - pi() / 64)"""

FLAGGED = ",\n".join(
    [FIRES, GRID, CONE, projected("grid_xy", "grid"), projected("fires_xy", "fires", "latitude", "longitude"), burned()]
)


def ladder(column: str, field: int) -> str:
    value = (lambda v: text(v) if isinstance(v, str) else repr(v))
    arms = [
        f"WHEN {column} < {nxt[0]!r} THEN {value(entry[field])}"
        for entry, nxt in zip(DANGER_CLASSES, DANGER_CLASSES[1:])
    ]
    return "CASE " + " ".join(arms) + f" ELSE {value(DANGER_CLASSES[-1][field])} END"


def province_case(lat: str = "lat", lon: str = "lon") -> str:
    arms = []
    for code in PROVINCE_PRIORITY:
        lat0, lon0, lat1, lon1 = PROVINCE_BOXES[code]
        arms.append(f"WHEN {lat} >= {lat0} AND {lat} <= {lat1} AND {lon} >= {lon0} AND {lon} <= {lon1} THEN '{code}'")
    return "CASE " + " ".join(arms) + " ELSE 'Unknown' END"


# Today's snapshot: three columns in 32 bits, rain in 64.
TODAY = f"""today AS (
  SELECT cell_id, lat, lon, file_date, {f32('temperature')} AS temperature, {f32('humidity')} AS humidity,
    {f32('wind_speed')} AS wind_speed, rain_1h_mm
  FROM wx_daily WHERE file_date = (SELECT max(file_date) FROM wx_daily))"""

SHOWN = ", ".join(
    f"round(coalesce({c}, 0.0), 6) + 0.0 AS {c}" for c in ("temperature", "humidity", "wind_speed", "rain_1h_mm")
)
FEATURES = f"""{SHOWN}, 1013.0 AS pressure, 0.0 AS rain_3h_mm, 0.0 AS snow_1h_mm, 0.0 AS snow_3h_mm,
  CASE WHEN temperature > 25.0 THEN 1 ELSE 0 END AS is_hot,
  CASE WHEN humidity < 30.0 THEN 1 ELSE 0 END AS is_dry,
  round(coalesce(humidity / (temperature + 1.0), 0.0), 6) + 0.0 AS humidity_temp_ratio,
  CASE WHEN wind_speed > 15.0 THEN 1 ELSE 0 END AS is_windy,
  coalesce(rain_1h_mm, 0.0) AS total_precip,
  CASE WHEN rain_1h_mm > 0.0 THEN 1 ELSE 0 END AS has_recent_precip,
  0 AS weather_main_encoded"""

SCORED = f"""scored AS (
  SELECT t.*, i.ffmc, i.dmc, i.dc, i.isi, i.bui, i.fwi, i.dsr,
    coalesce(g.historical_fire, 0) AS historical_fire, least(greatest(i.fwi, 0.0), 100.0) AS f
  FROM today t JOIN indices i USING (cell_id) LEFT JOIN flagged g ON g.lat = t.lat AND g.lon = t.lon),
risked AS (
  SELECT *, CASE WHEN historical_fire = 1 THEN least(0.98, base * 1.15) ELSE base END AS risk
  FROM (SELECT *, {ladder('f', 2)} AS base, {ladder('f', 1)} AS danger_class, {ladder('f', 3)} AS color_code
        FROM scored) s),
valid AS (SELECT * FROM risked WHERE temperature IS NULL OR temperature <> -1.0)"""


def scored_ctes(month: int) -> str:
    return ",\n".join([WX_DAILY, TODAY, accumulated("wx_daily", month), INDICES, FLAGGED, SCORED])


PREDICTION_SELECT = f"""SELECT cell_id, lat, lon, concat('Grid_', cell_id) AS location_name,
  {province_case()} AS province, {rnd('risk', 'daily_fire_risk')}, danger_class, color_code,
  0.95 AS model_confidence, {FEATURES}, {rnd('fwi', 'fire_danger_index')},
  {rnd('ffmc')}, {rnd('dmc')}, {rnd('dc')}, {rnd('isi')}, {rnd('bui')}, {rnd('fwi')}, {rnd('dsr')}
FROM valid"""

COUNTS = ", ".join(
    f"count(*) FILTER (WHERE ok AND danger_class = {text(name)}) AS {name.lower().replace(' ', '_')}_count"
    for _, name, *_ in DANGER_CLASSES
)

CLASS_ROWS = ", ".join(
    f"({text(name)}, {text(f'{low:.0f}-{nxt:.0f} FWI' if nxt else f'{low:.0f}+ FWI')}, {text(color)}, {text(desc)})"
    for (low, name, _, color, desc), nxt in zip(DANGER_CLASSES, [c[0] for c in DANGER_CLASSES[1:]] + [None])
)

# Texts that are cut short, and texts that are no object.
CUT, LIST = "event_id % 53 = 7", "event_id % 59 = 8"

PAYLOADS = f"""sent AS (
  SELECT *, event_id AS n, event_id % 5 = 4 AS bare, {ALL_NAMES}[cast(event_id % {NAMED} AS int) + 1] AS station,
    event_id % {NAMED} < {KNOWN} AS known, date_trunc('hour', ts) AS run, cast(ts AS date) AS file_date
  FROM events),
flat AS (
  SELECT event_id, ts, station, known, run, file_date,
    CASE WHEN bare THEN 15.0 WHEN event_type = 'error' THEN NULL
         ELSE cast(cast(value AS decimal(12, 2)) AS double) END AS temperature,
    CASE WHEN bare OR n % 3 <> 0 THEN 15.0 ELSE n % 31 + 0.5 END AS feels_like,
    CASE WHEN bare OR n % 3 <> 0 THEN 15.0 ELSE cast(n % 17 AS double) END AS temp_min,
    CASE WHEN bare OR n % 3 <> 0 THEN 15.0 END AS temp_max,
    CASE WHEN bare THEN 1013.0 ELSE 1001.0 END AS pressure,
    CASE WHEN bare THEN 50.0 WHEN n % 13 = 0 THEN NULL ELSE cast(n % 100 + 1 AS double) END AS humidity,
    cast(n % 25 AS double) AS wind_speed,
    CASE WHEN n % 4 = 0 THEN cast(n % 360 AS double) ELSE 0.0 END AS wind_deg,
    CASE WHEN n % 8 = 0 THEN NULL WHEN n % 4 = 0 THEN cast(n % 40 AS double) ELSE 0.0 END AS wind_gust,
    CASE WHEN n % 3 = 1 THEN cast(n % 101 AS double) ELSE 0.0 END AS clouds_pct,
    CASE WHEN n % 11 = 0 THEN NULL WHEN n % 6 = 0 THEN cast(n % 9000 AS double) ELSE 10000.0 END AS visibility_m,
    CASE WHEN n % 5 IN (1, 2) THEN 0.0 ELSE cast(n % 7 AS double) END AS rain_1h_mm,
    CASE WHEN n % 5 NOT IN (1, 2) AND n % 9 = 0 THEN cast(n % 21 AS double) ELSE 0.0 END AS rain_3h_mm,
    CASE WHEN n % 10 = 0 THEN cast(n % 4 AS double) ELSE 0.0 END AS snow_1h_mm,
    CASE WHEN n % 10 = 0 THEN NULL ELSE 0.0 END AS snow_3h_mm,
    CASE WHEN n % 5 = 3 THEN 'Unknown' ELSE event_type END AS weather_main,
    CASE WHEN n % 5 = 3 THEN 'No description' WHEN n % 4 = 1 THEN event_type || ' sky' END AS weather_description,
    1700000000 + n AS timestamp_utc
  FROM sent WHERE NOT ({CUT}) AND NOT ({LIST}))"""

LAST_RUN = """last_run AS (
  SELECT * FROM flat WHERE known QUALIFY run = max(run) OVER (PARTITION BY file_date)),
station_weather AS (
  SELECT * FROM last_run QUALIFY row_number() OVER (PARTITION BY file_date, station ORDER BY ts DESC, event_id DESC) = 1)"""

CELLS = "cells AS (SELECT DISTINCT cell_id, lat, lon FROM wx_events)"
MAPPED = ",\n".join(
    [
        CELLS, STATION_LIST, CONE, projected("cells_xy", "cells"), projected("stations_xy", "station_list"),
        """mapped AS (
  SELECT cell_id, c.lat, c.lon, name AS nearest_station_name, dist AS station_distance_m
  FROM (SELECT c.*, s.name, s.station_ord, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS dist
        FROM cells_xy c, stations_xy s) c
  QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY dist, station_ord) = 1)""",
    ]
)

WEATHER_NAMES = [
    "temperature", "feels_like", "temp_min", "temp_max", "pressure", "humidity", "wind_speed", "wind_deg",
    "wind_gust", "clouds_pct", "visibility_m", "rain_1h_mm", "rain_3h_mm", "snow_1h_mm", "snow_3h_mm",
    "weather_main", "weather_description", "timestamp_utc",
]


FLAT_SELECT = f"""SELECT event_id, station, {', '.join(WEATHER_NAMES)},
  strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS date FROM flat"""


def freshness(component: str, source: str, stamp: str, min_rows: int) -> str:
    return f"""SELECT {text(component)} AS component, count(*) AS n_rows,
  count(DISTINCT cast({stamp} AS date)) AS n_dates, max({stamp}) AS last_ts,
  epoch_us(timestamp '2024-01-31 01:00:00' - max({stamp})) / 3600000000.0 AS age, {min_rows} AS min_rows
FROM {source}"""


AUDIT = f"""measured AS (
  {freshness('Weather Data', 'events', 'ts', 1)}
  UNION ALL {freshness('Predictions Cache', "(SELECT * FROM events WHERE event_type <> 'error') e", 'ts', 1)}
  UNION ALL {freshness('Fire Points', 'orders', 'o_orderdate', 1)}
  UNION ALL {freshness('Rejects', '(SELECT * FROM events WHERE value < 0) e', 'ts', 0)}),
tiers AS (
  SELECT *, CASE WHEN age IS NULL THEN 'missing' WHEN age < 2 THEN 'fresh' WHEN age < 24 THEN 'stale'
                 ELSE 'very_stale' END AS freshness,
    CASE WHEN n_rows < min_rows OR age IS NULL OR age >= 24 THEN 3 WHEN age < 2 THEN 1 ELSE 2 END AS severity
  FROM measured)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return doubles(f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}")


CODE_SELECT = f"SELECT cell_id, last_date, {rnd('last_wind')}, {rnd('ffmc')}, {rnd('dmc')}, {rnd('dc')} FROM codes"


IN_BOX = " WHERE " + " AND ".join(f"{name} BETWEEN {low} AND {high}" for name, (low, high) in BOX.items())

# Every cell and date is a cell of its own, with the days that a run on that date would see.
EVERY_DATE = f"""{WX_DAILY},
numbered AS (SELECT file_date, row_number() OVER (ORDER BY file_date) AS place FROM (SELECT DISTINCT file_date FROM wx_daily)),
placed AS (SELECT w.*, n.place FROM wx_daily w JOIN numbered n ON n.file_date = w.file_date),
basis AS (
  SELECT a.cell_id * 1000 + a.place AS cell_id, b.file_date, b.temperature, b.humidity, b.wind_speed, b.rain_1h_mm
  FROM placed a JOIN placed b ON b.cell_id = a.cell_id AND b.place <= a.place AND b.place > a.place - {BACKFILL_WINDOW}),
{accumulated('basis', SUMMER)}"""


def build() -> dict[str, str]:
    accumulated_daily = f"{WX_DAILY},\n{accumulated('wx_daily', SUMMER)}"
    scored = scored_ctes(SUMMER)
    return {
        "daily_snapshot": with_(
            WX_DAILY,
            f"""SELECT event_id, cell_id, file_date, {f32('temperature')} AS temperature, {f32('humidity')} AS humidity,
  {f32('wind_speed')} AS wind_speed, {f32('rain_1h_mm')} AS rain_1h_mm FROM wx_daily""",
        ),
        "latest_n_dates": with_(WX_LINE, "SELECT * EXCLUDE (date_rank) FROM line_ranked WHERE date_rank <= 45"),
        "retention_drop_list": with_(WX_LINE, "SELECT DISTINCT file_date FROM line_ranked WHERE date_rank > 45"),
        "latest_snapshot": with_(
            WX_EVENTS, "SELECT * FROM wx_events WHERE file_date = (SELECT max(file_date) FROM wx_events)"
        ),
        "line_window_codes": with_(
            f"""{WX_LINE},
line_daily AS (
  SELECT * FROM line_ranked WHERE date_rank <= 45
  QUALIFY row_number() OVER (PARTITION BY cell_id, file_date
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1),
{accumulated('line_daily', SUMMER)}""",
            f"SELECT cell_id, last_date, {rnd('ffmc')}, {rnd('dmc')}, {rnd('dc')} FROM codes",
            True,
        ),
        "sanitize_inputs": with_(
            WX_EVENTS,
            """SELECT event_id,
  CASE WHEN temperature IS NULL THEN 15.0 ELSE least(greatest(temperature, -50.0), 50.0) END AS temperature,
  least(greatest(humidity, 1.0), 100.0) AS humidity, least(greatest(wind_speed, 0.0), 100.0) AS wind_speed,
  least(greatest(rain_1h_mm, 0.0), 500.0) AS rain FROM wx_events""",
        ),
        "weather_features": with_(
            f"""{WX_DAILY},
narrow AS (
  SELECT cell_id, file_date, {f32('temperature')} AS temperature, {f32('humidity')} AS humidity,
    {f32('wind_speed')} AS wind_speed, rain_1h_mm FROM wx_daily)""",
            f"""SELECT cell_id, file_date, {FEATURES} FROM narrow
WHERE temperature IS NULL OR temperature <> -1.0""",
        ),
        "rejects_by_reason": with_(
            WX_DAILY,
            f"""SELECT 'ratio_divides_by_zero' AS reject_reason, count(*) AS n_rows
FROM wx_daily WHERE {f32('temperature')} = -1.0 HAVING count(*) > 0""",
        ),
        "single_day_codes": with_(
            f"{WX_DAILY},\nnumbered_daily AS (SELECT row_number() OVER (ORDER BY cell_id, file_date) AS n, * FROM wx_daily),\n"
            + accumulated(
                "(SELECT n AS cell_id, file_date, temperature, humidity, wind_speed, rain_1h_mm FROM numbered_daily) d",
                SUMMER,
            ),
            f"""SELECT d.cell_id, d.file_date, {rnd('c.ffmc', 'ffmc')}, {rnd('c.dmc', 'dmc')}, {rnd('c.dc', 'dc')}
FROM codes c JOIN numbered_daily d ON d.n = c.cell_id""",
            True,
        ),
        "accumulated_codes": with_(accumulated_daily, CODE_SELECT, True),
        "stream_equals_batch": with_(accumulated_daily, CODE_SELECT, True),
        "state_store_codes": with_(accumulated_daily, CODE_SELECT, True),
        "fire_indices": with_(
            f"{WX_DAILY},\n{accumulated('wx_daily', SPRING)},\n{INDICES}",
            "SELECT cell_id, " + ", ".join(rnd(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr"))
            + " FROM indices",
            True,
        ),
        "risk_scores": with_(scored, PREDICTION_SELECT, True),
        "stored_result": with_(scored, PREDICTION_SELECT, True),
        "predictions_in_box": with_(scored, PREDICTION_SELECT + IN_BOX, True),
        "scores_of_every_date": with_(EVERY_DATE, "SELECT cell_id // 1000 AS cell_id, " + CODE_SELECT.removeprefix("SELECT cell_id, "), True),
        "risk_quantiles_by_range": with_(
            f"""{WX_DAILY},
ranges(range_name, first, last) AS (VALUES {', '.join(f"({text(n)}, DATE '{a}', DATE '{b}')" for n, a, b in RANGES)}),
shares(share) AS (VALUES {', '.join(f'({share})' for share in SHARES)})""",
            """SELECT range_name, share, count(DISTINCT file_date) AS n_dates, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells,
  true AS rank_held, true AS cells_held
FROM wx_daily JOIN ranges ON file_date BETWEEN first AND last CROSS JOIN shares GROUP BY range_name, share""",
        ),
        "stored_predictions": with_(scored, PREDICTION_SELECT + " WHERE risk >= 0.65", True),
        "danger_class_counts": with_(
            f"{scored},\nlisting AS (SELECT * FROM (VALUES {CLASS_ROWS}) v(danger_class, fwi_range, color, description))",
            """SELECT l.danger_class, l.fwi_range, l.color, l.description, count(v.cell_id) AS n_cells
FROM listing l LEFT JOIN valid v USING (danger_class) GROUP BY ALL""",
            True,
        ),
        "run_stats": with_(
            scored,
            f"""SELECT count(*) AS total_locations, count(*) FILTER (WHERE ok) AS processed_successfully,
  count(*) FILTER (WHERE NOT ok) AS processing_errors,
  round(coalesce(min(risk) FILTER (WHERE ok), 0.0), 6) + 0.0 AS min_risk,
  round(coalesce(max(risk) FILTER (WHERE ok), 0.0), 6) + 0.0 AS max_risk,
  round(coalesce(avg(risk) FILTER (WHERE ok), 0.0), 6) + 0.0 AS mean_risk, {COUNTS}
FROM (SELECT *, coalesce(temperature <> -1.0, true) AS ok FROM risked) r""",
            True,
        ),
        "run_log_records": with_(
            f"{WX_DAILY},\n{TODAY}",
            "SELECT count(*) AS training_records FROM today WHERE temperature IS NULL OR temperature <> -1.0",
        ),
        "fallback_history": with_(
            f"""{WX_DAILY},
ranked AS (SELECT *, dense_rank() OVER (ORDER BY file_date DESC) AS date_rank FROM wx_daily),
newest AS (SELECT * FROM ranked WHERE date_rank = 1),
before AS (SELECT * FROM ranked WHERE date_rank > 1 AND cell_id % 3 <> 0),
basis AS (
  SELECT cell_id, file_date, temperature, humidity, wind_speed, {f32('rain_1h_mm')} AS rain_1h_mm FROM before
  WHERE cell_id IN (SELECT cell_id FROM newest)
  UNION ALL
  SELECT cell_id, file_date, temperature, humidity, wind_speed, rain_1h_mm FROM newest
  WHERE cell_id NOT IN (SELECT cell_id FROM before)),
{accumulated('basis', SUMMER, 'rain_1h_mm')},
{INDICES}""",
            "SELECT cell_id, " + ", ".join(rnd(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr"))
            + " FROM indices",
            True,
        ),
        "grid_coverage": with_(
            f"{WX_EVENTS},\n{GRID},\nseen AS (SELECT lat, lon, count(*) AS n FROM wx_events GROUP BY lat, lon)",
            """SELECT grid.cell_id, grid.lat, grid.lon, coalesce(seen.n, 0) AS n_observations
FROM grid LEFT JOIN seen ON seen.lat = grid.lat AND seen.lon = grid.lon""",
        ),
        "fire_projection": with_(
            f"{FIRES},\n{CONE},\n{projected('fires_xy', 'fires', 'latitude', 'longitude')}",
            f"SELECT fire_id, {rnd('x', digits=2)}, {rnd('y', digits=2)} FROM fires_xy",
        ),
        "nearest_station": with_(
            f"{WX_EVENTS},\n{MAPPED}",
            f"""SELECT cell_id, lat, lon, nearest_station_name, {rnd('station_distance_m', digits=2)} FROM mapped""",
        ),
        "historical_fire_flag": with_(FLAGGED, "SELECT * FROM flagged"),
        "grid_job": with_(FLAGGED, "SELECT lat, lon, historical_fire FROM flagged"),
        "mapping_job": with_(f"{WX_EVENTS},\n{MAPPED}", "SELECT lat, lon, nearest_station_name FROM mapped"),
        "fire_scan": with_(
            FIRES,
            """SELECT latitude, longitude, cast(o_orderdate AS date) AS rep_date, o_totalprice / 100.0 AS size_ha
FROM fires JOIN orders ON o_orderkey = fire_id""",
        ),
        "historical_fire_flag_polygon": with_(
            ",\n".join(
                [FIRES, GRID, CONE, projected("grid_xy", "grid"),
                 projected("fires_xy", "fires", "latitude", "longitude"), burned(POLYGON_EDGE)]
            ),
            "SELECT * FROM flagged",
        ),
        "province_of_cell": with_(
            f"{WX_EVENTS},\n{GRID},\nseen AS (SELECT lat, lon, count(*) AS n FROM wx_events GROUP BY lat, lon)",
            f"""SELECT grid.cell_id, grid.lat, grid.lon, coalesce(seen.n, 0) AS n_observations,
  {province_case('grid.lat', 'grid.lon')} AS province
FROM grid LEFT JOIN seen ON seen.lat = grid.lat AND seen.lon = grid.lon""",
        ),
        "payload_flatten": with_(PAYLOADS, FLAT_SELECT),
        "payload_documents": with_(PAYLOADS, FLAT_SELECT),
        "late_payloads": with_(
            f"""{PAYLOADS},
marked AS (SELECT *, event_id % 2 = 0 AS early, date_trunc('milliseconds', max(ts) FILTER (event_id % 2 = 0) OVER ()) - INTERVAL {LATE_AFTER} AS mark FROM sent)""",
            """SELECT file_date, 'accepted' AS outcome, count(*) AS n_payloads FROM marked WHERE early OR ts > mark GROUP BY file_date
UNION ALL SELECT NULL, 'repeated', count(*) FROM marked WHERE early AND ts > mark
UNION ALL SELECT NULL, 'late', count(*) FROM marked WHERE ts <= mark""",
        ),
        "station_fanout": with_(
            f"{WX_EVENTS},\n{MAPPED},\n{PAYLOADS},\n{LAST_RUN}",
            f"""SELECT m.cell_id, m.lat, m.lon, m.nearest_station_name AS nearest_station, d.file_date,
  {', '.join('w.' + c for c in WEATHER_NAMES)}
FROM mapped m CROSS JOIN (SELECT DISTINCT file_date FROM last_run) d
LEFT JOIN station_weather w ON w.station = m.nearest_station_name AND w.file_date = d.file_date""",
        ),
        "stream_ingest": with_(
            f"{WX_EVENTS},\n{MAPPED},\n{PAYLOADS},\n{LAST_RUN}",
            f"""SELECT m.lat, m.lon, m.nearest_station_name AS nearest_station, d.file_date,
  {', '.join('w.' + c for c in WEATHER_NAMES)},
  strftime(make_timestamp(w.timestamp_utc * 1000000) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS date
FROM mapped m CROSS JOIN (SELECT DISTINCT file_date FROM last_run) d
LEFT JOIN station_weather w ON w.station = m.nearest_station_name AND w.file_date = d.file_date""",
        ),
        "fetch_summary": with_(
            f"{WX_EVENTS},\n{MAPPED},\n{PAYLOADS}",
            """SELECT r.run, s.n AS n_stations, coalesce(d.n, 0) AS n_success, s.n - coalesce(d.n, 0) AS n_failed
FROM (SELECT DISTINCT run FROM sent) r
CROSS JOIN (SELECT count(DISTINCT nearest_station_name) AS n FROM mapped) s
LEFT JOIN (SELECT run, count(DISTINCT station) AS n FROM flat
           WHERE known AND station IN (SELECT nearest_station_name FROM mapped) GROUP BY run) d ON d.run = r.run""",
        ),
        "payload_rejects": with_(
            PAYLOADS,
            f"""SELECT event_id, station, CASE WHEN {CUT} THEN 'payload_no_json' ELSE 'payload_no_object' END AS reject_reason
FROM sent WHERE ({CUT}) OR ({LIST})""",
        ),
        "unknown_stations": with_(
            PAYLOADS, "SELECT station, count(*) AS n_payloads FROM sent WHERE NOT known GROUP BY station"
        ),
        "union_daily": with_(WX_EVENTS, "SELECT * FROM wx_events"),
        "partition_overwrite": with_(
            f"""{WX_DAILY},
first_daily AS (
  SELECT * FROM wx_events
  QUALIFY row_number() OVER (PARTITION BY cell_id, file_date ORDER BY event_id) = 1)""",
            """SELECT * FROM wx_daily WHERE file_date < (SELECT max(file_date) FROM wx_daily)
UNION ALL SELECT * FROM first_daily WHERE file_date = (SELECT max(file_date) FROM wx_daily)""",
        ),
        "bad_file_skip": with_(
            f"""{WX_DAILY},
bad AS (SELECT DISTINCT file_date FROM wx_daily
        WHERE (temperature IS NULL AND humidity = 100.0) OR (day(file_date) % 6 = 2 AND cell_id % 50 = 0))""",
            """SELECT cell_id, file_date, lat, lon, temperature, humidity, wind_speed,
  CASE WHEN day(file_date) % 6 <> 4 THEN rain_1h_mm END AS rain_1h_mm
FROM wx_daily WHERE file_date NOT IN (SELECT file_date FROM bad)""",
        ),
        "prediction_export": with_(
            scored,
            f"""SELECT cell_id, concat('Grid_', cell_id) AS location_name, {rnd('risk', 'daily_fire_risk')}, danger_class,
  round(coalesce(humidity / (temperature + 1.0), 0.0), 6) + 0.0 AS humidity_temp_ratio, {rnd('fwi')},
  true AS success, (SELECT count(*) FROM risked) AS total_locations, '2024-01-31 00:00:00' AS run
FROM valid""",
            True,
        ),
        "rejects_report": with_(
            f"""{WX_DAILY},\n{PAYLOADS},
bad AS (SELECT DISTINCT cast(file_date AS varchar) AS file_name FROM wx_daily
        WHERE temperature IS NULL AND humidity = 100.0)""",
            f"""SELECT 'row' AS level, '' AS file_name, 'ratio_divides_by_zero' AS reject_reason, count(*) AS n_rows
FROM wx_daily WHERE {f32('temperature')} = -1.0 HAVING count(*) > 0
UNION ALL SELECT 'file', file_name, 'unreadable_number', cast(NULL AS bigint) FROM bad
UNION ALL SELECT 'payload', '', CASE WHEN {CUT} THEN 'payload_no_json' ELSE 'payload_no_object' END, count(*)
FROM sent WHERE ({CUT}) OR ({LIST}) GROUP BY ALL""",
        ),
        "freshness_audit": with_(
            AUDIT,
            """SELECT component, n_rows, n_dates, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_updated,
  coalesce(round(age, 2), 0.0) AS age_hours, coalesce(age < 2, false) AS is_fresh, freshness,
  ['healthy', 'degraded', 'unhealthy'][severity] AS status,
  ['healthy', 'degraded', 'unhealthy'][(SELECT max(severity) FROM tiers)] AS overall_status
FROM tiers""",
        ),
        "json_clean_values": with_(
            WX_EVENTS,
            """SELECT event_id, coalesce(temperature, 0.0) AS temperature,
  CASE WHEN wind_speed > 12.0 THEN 0.0 ELSE wind_speed END AS wind_speed, temperature AS kept_null,
  coalesce(temperature, 0.0) AS first_reading, humidity AS second_reading FROM wx_events""",
        ),
    }
