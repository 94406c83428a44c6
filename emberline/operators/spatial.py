"""Grid generation, radius join and nearest-neighbour search in the projected plane."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import FIRE_RADIUS_M, GRID_LAT, GRID_LON, GRID_STEP, STATIONS
from emberline.functions.geo import distance, inside_buffer, lambert_xy
from emberline.session import BROADCAST_ROWS, fits_broadcast, local_table

# A set of points up to this size is carried along as one array literal.
ARRAY_POINTS = 10_000
# A bucket with more points than this is split before a shuffle join.
HOT_BUCKET_ROWS = 1_000_000


def grid_shape(step: float = GRID_STEP) -> tuple[int, int]:
    """Rows and columns of the end-exclusive grid."""
    rows, cols = (math.ceil(round((high - low) / step, 9)) for low, high in (GRID_LAT, GRID_LON))
    return rows, cols


def grid_cells(spark: SparkSession, step: float = GRID_STEP) -> DataFrame:
    """The latitude/longitude grid in latitude-major order, built from one range of ids."""
    rows, cols = grid_shape(step)
    row, col = F.floor(F.col("id") / cols), F.col("id") % cols
    return spark.range(rows * cols).select(
        F.col("id").alias("cell_id"),
        (GRID_LAT[0] + step * row).alias("lat"),
        (GRID_LON[0] + step * col).alias("lon"),
    )


def stations(spark: SparkSession) -> DataFrame:
    """The station list with its order."""
    rows = [(i, *station) for i, station in enumerate(STATIONS)]
    return local_table(spark, rows, "station_ord int, name string, lat double, lon double")


def projected(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``x`` and ``y`` in metres."""
    east, north = lambert_xy(lat, lon)
    return points.selectExpr("*", f"{east} AS x", f"{north} AS y")


def join_split(
    many: DataFrame,
    few: DataFrame,
    on: list[str],
    identity: list[str],
    hot_rows: int = HOT_BUCKET_ROWS,
    few_identity: list[str] | None = None,
) -> DataFrame:
    """Inner join by shuffle in which no key brings more than about ``hot_rows`` rows of ``many`` together.

    Keys with more rows are split into parts by a hash of ``identity``, and their rows of
    ``few`` are repeated per part.  With ``few_identity`` the other side is split likewise, and
    each part of one side meets each part of the other.  Counting combines on the map side.
    There is at most one such key per ``hot_rows`` rows, so the lists of them are left to the
    optimizer, which knows their size when it has to join them.
    """

    def hot(df: DataFrame, parts: str) -> DataFrame:
        counts = df.groupBy(*on).count().filter(F.col("count") > hot_rows)
        return counts.selectExpr(*on, f"cast(ceil(count / {hot_rows}) AS bigint) AS {parts}")

    def number(columns: list[str], parts: str) -> str:
        return f"pmod(xxhash64({', '.join(columns)}), coalesce({parts}, 1L))"

    every = "explode(sequence(0L, coalesce({}, 1L) - 1L))"
    left = many.join(hot(many, "parts"), on, "left").selectExpr(*many.columns, f"{number(identity, 'parts')} AS part")
    right = few.join(hot(many, "parts"), on, "left").selectExpr(*few.columns, f"{every.format('parts')} AS part")
    if few_identity is None:
        return left.join(right, [*on, "part"]).drop("part")
    others = hot(few, "other_parts")
    left = left.join(others, on, "left").selectExpr(*many.columns, "part", f"{every.format('other_parts')} AS other_part")
    right = right.join(others, on, "left").selectExpr(*few.columns, "part", f"{number(few_identity, 'other_parts')} AS other_part")
    return left.join(right, [*on, "part", "other_part"]).drop("part", "other_part")


def cells_near(
    cells: DataFrame,
    points: DataFrame,
    radius: float = FIRE_RADIUS_M,
    mode: str = "circle",
    max_broadcast: int = BROADCAST_ROWS,
    hot_rows: int = HOT_BUCKET_ROWS,
) -> DataFrame:
    """Distinct ``cell_id`` of the cells (``cell_id, x, y``) that have a point (``x, y``) in reach.

    Both sides are cut into square buckets one radius wide, so a point can only be in reach
    of cells in its own bucket or the eight around it; the cells are copied to those nine and
    the join is an equality on the bucket.

    * The cells are the side that does not grow with the data.  Up to ``max_broadcast`` rows
      they are broadcast: the points are never shuffled, so a bucket holding a third of them
      is no hot spot, and only distinct cell ids leave the map side.
    * A finer grid is joined by shuffle instead.  Copies of a point are merged first, and
      buckets that still exceed ``hot_rows`` are split into as many parts as needed, with
      their cells repeated per part.
    """
    # Never NULL: otherwise the join's null check would be pushed down to the points and
    # compute their projection a second time.  A point without position matches no distance.
    bx, by = (f"coalesce(floor({c} / {float(radius)}D), 0L)" for c in ("x", "y"))
    reach = (
        cells.selectExpr("cell_id", "x AS cx", "y AS cy", f"{by} AS own", f"explode(sequence({bx} - 1, {bx} + 1)) AS bx")
        .selectExpr("cell_id", "cx", "cy", "bx", "explode(sequence(own - 1, own + 1)) AS by")
    )
    probe = points.selectExpr("x", "y", f"{bx} AS bx", f"{by} AS by")
    if fits_broadcast(cells, max_broadcast // 9):
        pairs = probe.join(F.broadcast(reach), ["bx", "by"])
    else:
        pairs = join_split(probe.distinct(), reach, ["bx", "by"], ["x", "y"], hot_rows, ["cell_id"])
    return pairs.filter(inside_buffer("x - cx", "y - cy", radius, mode)).select("cell_id").distinct()


def flag_fire_history(
    grid: DataFrame, fires: DataFrame, radius: float = FIRE_RADIUS_M, mode: str = "circle", **limits: int
) -> DataFrame:
    """Add ``historical_fire`` (0/1): whether a fire burned within ``radius`` of the cell."""
    cells = projected(grid).select("cell_id", "x", "y")
    points = projected(fires, "latitude", "longitude").select("x", "y")
    burned = cells_near(cells, points, radius, mode, **limits).withColumn("historical_fire", F.lit(1))
    return grid.join(burned, "cell_id", "left").withColumn(
        "historical_fire", F.coalesce("historical_fire", F.lit(0))
    )


def nearest_station(
    cells: DataFrame, targets: DataFrame, max_array: int = ARRAY_POINTS, hot_rows: int = HOT_BUCKET_ROWS
) -> DataFrame:
    """Add ``nearest_station_name`` and ``station_distance_m`` to cells with ``lat, lon``.

    ``targets`` has ``station_ord, name, lat, lon``; equal distances go to the lower order.
    A target without a position is no target.
    A small set of targets is gathered once into an array and every cell takes its minimum
    over it: one narrow step, no join, no pairs.  A larger set is searched through tiles.
    """
    targets = targets.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    sites = projected(targets).selectExpr("station_ord", "name", "x AS sx", "y AS sy")
    placed = projected(cells)
    if not fits_broadcast(targets, max_array):
        return _nearest_through_tiles(placed, sites, hot_rows).drop("x", "y")
    listed = sites.agg(F.expr("sort_array(collect_list(struct(station_ord, name, sx, sy)))")).scalar()
    return (
        placed.withColumn("listed", listed)
        # A filter on the name (a join by it brings one) would be pushed below whatever made the
        # cells distinct and repeat the search there; one on what ``explode`` yields stays above it.
        .selectExpr("*", f"explode(array(array_min(transform(listed, s -> {_candidate('s.')})))) AS best")
        .selectExpr(*cells.columns, *BEST_COLUMNS)
    )


def _candidate(site: str) -> str:
    """A site seen from a cell, ordered by distance and then by list position."""
    far = distance(f"x - {site}sx", f"y - {site}sy")
    return f"struct({far} AS far, {site}station_ord AS station_ord, {site}name AS name)"


# A cell without position has no nearest site.
BEST_COLUMNS = [
    "if(best.far IS NULL, NULL, best.name) AS nearest_station_name",
    "best.far AS station_distance_m",
]


def _nearest_through_tiles(
    cells: DataFrame, sites: DataFrame, hot_rows: int, tile: float = 100_000.0
) -> DataFrame:
    """Exact nearest site for large site sets.

    Sites are summarised into square tiles, whose number is limited by the mapped area and not
    by the number of sites.  One site per tile gives each cell an upper bound of its distance;
    only tiles that reach closer than that bound are joined with their sites.
    """
    tiled = sites.selectExpr("*", f"floor(sx / {tile}D) AS tx", f"floor(sy / {tile}D) AS ty")
    tiles = tiled.groupBy("tx", "ty").agg(F.expr("min_by(struct(sx, sy), station_ord) AS sample"))
    if not fits_broadcast(tiles, ARRAY_POINTS):
        return _nearest_through_tiles(cells, sites, hot_rows, tile * 2)
    listed = tiles.agg(F.expr("collect_list(struct(tx, ty, sample))")).scalar()

    def gap(index: str, coordinate: str) -> str:
        low = f"{index} * {tile}D"
        return f"greatest({low} - {coordinate}, {coordinate} - ({low} + {tile}D), 0D)"

    reach = distance("x - t.sample.sx", "y - t.sample.sy")
    # A hair of slack keeps a tile whose edge is exactly at the bound.
    near = f"{distance(gap('t.tx', 'x'), gap('t.ty', 'y'))} <= bound * (1 + 1e-9D)"
    wanted = (
        cells.withColumn("listed", listed)
        .selectExpr("cell_id", "x", "y", "listed", f"array_min(transform(listed, t -> {reach})) AS bound")
        .selectExpr("cell_id", "x", "y", f"inline(transform(filter(listed, t -> {near}), t -> struct(t.tx, t.ty)))")
    )
    best = (
        join_split(tiled, wanted, ["tx", "ty"], ["station_ord", "name"], hot_rows, ["cell_id", "x", "y"])
        .groupBy("cell_id")
        .agg(F.expr(f"min({_candidate('')}) AS best"))
    )
    return cells.join(best, "cell_id", "left").selectExpr(*cells.columns, *BEST_COLUMNS)
