"""Fixed values the results depend on, written out in one place.

Nothing here is computed: these are the published or agreed values that every
plan shares.  Code elsewhere refers to them by name.
"""

# Weather stations as (name, latitude, longitude).  The position in
# the list decides ties between equally near stations.
STATIONS = [
    ("Vancouver", 49.2827, -123.1207),
    ("Kelowna", 49.8880, -119.4960),
    ("Kamloops", 50.6745, -120.3273),
    ("Calgary", 51.0447, -114.0719),
    ("Edmonton", 53.5461, -113.4938),
    ("Fort McMurray", 56.7266, -111.3790),
    ("Saskatoon", 52.1579, -106.6702),
    ("Regina", 50.4452, -104.6189),
    ("Winnipeg", 49.8951, -97.1384),
    ("Thunder Bay", 48.3809, -89.2477),
    ("Ottawa", 45.4215, -75.6972),
    ("Toronto", 43.6510, -79.3470),
    ("Sudbury", 46.4917, -80.9930),
    ("Montreal", 45.5019, -73.5674),
    ("Quebec City", 46.8139, -71.2080),
    ("Halifax", 44.6488, -63.5752),
    ("Whitehorse", 60.7212, -135.0568),
    ("Yellowknife", 62.4540, -114.3718),
    ("Prince George", 53.9171, -122.7497),
    ("Victoria", 48.4284, -123.3656),
    ("Smithers", 54.7800, -127.1743),
    ("Dease Lake", 58.4356, -130.0089),
    ("Fort St. John", 56.2524, -120.8466),
    ("High Level", 58.5169, -117.1360),
    ("Peace River", 56.2333, -117.2833),
    ("La Ronge", 55.1000, -105.3000),
    ("Flin Flon", 54.7682, -101.8779),
    ("Churchill", 58.7684, -94.1650),
    ("Moosonee", 51.2794, -80.6463),
    ("Timmins", 48.4758, -81.3305),
    ("Val-d'Or", 48.1086, -77.7972),
    ("Chibougamau", 49.9167, -74.3667),
    ("Schefferville", 54.8000, -66.8167),
    ("Goose Bay", 53.3019, -60.3267),
    ("St. John's", 47.5615, -52.7126),
    ("Iqaluit", 63.7467, -68.5170),
    ("Rankin Inlet", 62.8090, -92.0853),
    ("Cambridge Bay", 69.1167, -105.0667),
]

# Province boxes as code -> (min_lat, min_lon, max_lat, max_lon), all
# edges inclusive.  The boxes overlap, so the order below decides which one wins.
PROVINCE_BOXES = {
    "BC": (48.3, -139.1, 60.0, -114.1),
    "AB": (49.0, -120.0, 60.0, -110.0),
    "SK": (49.0, -110.0, 60.0, -101.4),
    "MB": (49.0, -102.0, 60.0, -88.9),
    "ON": (41.7, -95.2, 56.9, -74.3),
    "QC": (45.0, -79.8, 62.6, -57.1),
    "NB": (44.6, -69.1, 48.1, -63.7),
    "NS": (43.4, -66.4, 47.1, -59.7),
    "PE": (45.9, -64.4, 47.1, -62.0),
    "NL": (46.6, -67.8, 60.4, -52.6),
    "YT": (60.0, -141.0, 69.6, -124.0),
    "NT": (60.0, -136.0, 78.8, -102.0),
    "NU": (60.0, -110.0, 83.1, -61.0),
}
PROVINCE_PRIORITY = ["NL", "PE", "NS", "NB", "QC", "ON", "MB", "SK", "AB", "BC", "YT", "NT", "NU"]

# Danger classes as (lower FWI bound, name, base risk, colour, description).
# A class ends where the next one starts; the last is open.
DANGER_CLASSES = [
    (0.0, "Very Low", 0.05, "#4CAF50", "Fires start easily but spread slowly"),
    (1.0, "Low", 0.15, "#8BC34A", "Fires start easily and spread at low to moderate rates"),
    (3.0, "Moderate", 0.35, "#FFEB3B", "Fires start easily and spread at moderate rates"),
    (7.0, "High", 0.65, "#FF9800", "Fires start easily and spread at high rates"),
    (17.0, "Very High", 0.85, "#F44336", "Fires start very easily and spread at very high rates"),
    (30.0, "Extreme", 0.95, "#9C27B0", "Fires start very easily and spread at extreme rates"),
]

# Day-length factor per month, January first, and the value for any
# other month number.  The same table feeds the duff code and the drought code.
MONTH_FACTORS = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]
MONTH_FACTOR_OTHER = 1.4

# Accepted input ranges of the index formulas as
# name -> (default when missing, low, high).
INPUT_RANGES = {
    "temperature": (15.0, -50.0, 50.0),
    "humidity": (50.0, 1.0, 100.0),
    "wind_speed": (10.0, 0.0, 100.0),
    "rain": (0.0, 0.0, 500.0),
    "ffmc": (85.0, 0.0, 101.0),
    "dmc": (6.0, 0.0, 500.0),
    "dc": (15.0, 0.0, 1000.0),
    "isi": (1.0, 0.0, 100.0),
    "bui": (10.0, 0.0, 500.0),
    "fwi": (5.0, 0.0, 100.0),
}

# Index values reported when a formula has no finite result.
INDEX_DEFAULTS = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0, "isi": 1.0, "bui": 10.0, "fwi": 5.0, "dsr": 1.0}

# Start of every accumulation.
START_CODES = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}

# Risk scoring.
RISK_WHEN_INVALID = 0.15
FIRE_HISTORY_UPLIFT = 1.15
FIRE_HISTORY_RISK_CAP = 0.98
MODEL_CONFIDENCE = 0.95
MODEL_INFO = {
    "model_type": "Canadian Fire Weather Index System",
    "version": "2.0.0",
    "methodology": "45-Day Historical Weather Accumulation",
    "risk_range": [0.05, 0.95],
    "features_used": ["FFMC", "DMC", "DC", "ISI", "BUI", "FWI"],
}

# Weather payload fields as (path, flat column, default when the key is
# absent).  An explicit JSON null stays null.
PAYLOAD_FIELDS = [
    ("$.main.temp", "temperature", 15.0),
    ("$.main.feels_like", "feels_like", 15.0),
    ("$.main.temp_min", "temp_min", 15.0),
    ("$.main.temp_max", "temp_max", 15.0),
    ("$.main.pressure", "pressure", 1013.0),
    ("$.main.humidity", "humidity", 50.0),
    ("$.wind.speed", "wind_speed", 0.0),
    ("$.wind.deg", "wind_deg", 0.0),
    ("$.wind.gust", "wind_gust", 0.0),
    ("$.clouds.all", "clouds_pct", 0.0),
    ("$.visibility", "visibility", 10000.0),
    ("$.rain.1h", "rain_1h", 0.0),
    ("$.rain.3h", "rain_3h", 0.0),
    ("$.snow.1h", "snow_1h", 0.0),
    ("$.snow.3h", "snow_3h", 0.0),
]
PAYLOAD_TEXT_FIELDS = [
    ("main", "weather_main", "Unknown"),
    ("description", "weather_description", "No description"),
]
PAYLOAD_RENAMES = {
    "visibility": "visibility_m",
    "rain_1h": "rain_1h_mm",
    "rain_3h": "rain_3h_mm",
    "snow_1h": "snow_1h_mm",
    "snow_3h": "snow_3h_mm",
}
SNAPSHOT_ZONE = "America/Edmonton"

# Precipitation columns whose sum is the day's rain.
PRECIP_COLUMNS = ["rain_1h_mm", "rain_3h_mm", "snow_1h_mm", "snow_3h_mm"]

# Weather columns read as 32-bit floats, in the history and in today's
# snapshot (where precipitation keeps its 64 bits).
FLOAT32_HISTORY = ["temperature", "humidity", "wind_speed", "pressure"] + PRECIP_COLUMNS
FLOAT32_TODAY = ["temperature", "humidity", "wind_speed", "pressure"]

# What a feature falls back to when today's table lacks the column.
TODAY_DEFAULTS = {
    "temperature": 15.0,
    "humidity": 50.0,
    "wind_speed": 10.0,
    "pressure": 1013.0,
    "rain_1h_mm": 0.0,
    "rain_3h_mm": 0.0,
    "snow_1h_mm": 0.0,
    "snow_3h_mm": 0.0,
}

# Text a weather CSV may hold in a numeric column to mean "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The grid, end-exclusive, and its two radii in metres.
GRID_LAT = (41.0, 83.0)
GRID_LON = (-141.0, -52.0)
GRID_STEP = 0.5
FIRE_RADIUS_M = 25000.0

# Days of history kept and folded.
WINDOW_DATES = 45

# Freshness limits in hours.
FRESH_HOURS = 2.0
STALE_HOURS = 24.0

# EPSG:3347 (Statistics Canada Lambert) on the GRS80 ellipsoid, from the
# public EPSG registry.
LAMBERT = {
    "semi_major": 6378137.0,
    "inverse_flattening": 298.257222101,
    "standard_parallels": (49.0, 77.0),
    "origin_lat": 63.390675,
    "origin_lon": -(91.0 + 52.0 / 60.0),
    "false_easting": 6200000.0,
    "false_northing": 3000000.0,
}
