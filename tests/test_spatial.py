"""Grid, projection, radius join and nearest neighbour against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import inside_buffer, province
from emberline.operators import spatial
from emberline.session import local_table
from emberline.plans import fixtures as fx


def xy(df, key):
    rows = df.orderBy(key).collect()
    return np.array([r[key] for r in rows]), np.array([[r["x"], r["y"]] for r in rows])


def test_grid_shape_and_order(spark):
    grid = spatial.grid_cells(spark)
    assert grid.count() == 14952 and spatial.grid_shape() == (84, 178)
    rows = grid.filter("cell_id IN (0, 1, 178, 14951)").orderBy("cell_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, 41.0, -141.0), (1, 41.0, -140.5), (178, 41.5, -141.0), (14951, 82.5, -52.5)
    ]


def test_finer_grid(spark):
    assert spatial.grid_shape(0.1) == (420, 890)
    assert spatial.grid_cells(spark, 0.1).agg(F.max("lat"), F.max("lon")).first()[0] == pytest.approx(82.9)


def test_projection_goldens(spark):
    rows = spark.createDataFrame([(63.390675, -(91 + 52 / 60)), (55.0, -100.0)], "lat double, lon double")
    origin, cell = spatial.projected(rows).collect()
    assert (origin["x"], origin["y"]) == pytest.approx((6200000.0, 3000000.0), abs=1e-3)
    assert (cell["x"], cell["y"]) == pytest.approx((5690756.755, 2122393.089), abs=1e-3)


def test_nearest_station_goldens(spark):
    mapped = spatial.nearest_station(spatial.grid_cells(spark), spatial.stations(spark)).cache()
    name = lambda lat, lon: mapped.filter(f"lat = {lat} AND lon = {lon}").first()
    assert name(55.0, -100.0)["nearest_station_name"] == "Flin Flon"
    assert name(55.0, -100.0)["station_distance_m"] == pytest.approx(120949.47, abs=0.01)
    assert name(41.0, -141.0)["nearest_station_name"] == "Victoria"
    assert name(82.5, -52.5)["nearest_station_name"] == "Cambridge Bay"
    assert mapped.select("nearest_station_name").distinct().count() == 38
    mapped.unpersist()


def test_nearest_station_needs_no_join(spark, plan_of):
    plan = plan_of(spatial.nearest_station(spatial.grid_cells(spark), spatial.stations(spark)))
    assert "Join" not in plan and "Cartesian" not in plan


def test_a_join_by_station_searches_once_per_cell(spark, plan_of):
    """The filter that a join by name brings stays above the search and the distinct cells."""
    cells = spark.range(1000).selectExpr("id % 7 AS cell_id", "50D + id % 7 AS lat", "-100D AS lon").distinct()
    names = spatial.nearest_station(cells, spatial.stations(spark)).select("nearest_station_name").distinct()
    joined = spatial.stations(spark).join(names, F.col("name") == F.col("nearest_station_name"), "left_semi")
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 1
    assert joined.count() == names.count() > 0


def test_tile_search_equals_array_search(spark, sf):
    cells = spatial.grid_cells(spark)
    # A third of the targets crowd into one spot.
    targets = fx.fires(spark, sf).selectExpr(
        "cast(fire_id AS int) AS station_ord", "concat('s', fire_id) AS name",
        "if(fire_id % 3 = 0, 55 + (fire_id % 100) / 1000D, latitude) AS lat",
        "if(fire_id % 3 = 0, -100 + (fire_id % 90) / 1000D, longitude) AS lon",
    )
    small = spatial.nearest_station(cells, targets)
    large = spatial.nearest_station(cells, targets, max_array=10, hot_rows=50)
    assert small.exceptAll(large).isEmpty() and large.count() == 14952


def test_ties_go_to_the_first_target(spark):
    twins = spark.createDataFrame(
        [(2, "late", 50.0, -100.0), (1, "early", 50.0, -100.0), (3, "far", 60.0, -90.0)],
        "station_ord int, name string, lat double, lon double",
    )
    cell = spark.createDataFrame([(1, 51.0, -100.0)], "cell_id bigint, lat double, lon double")
    for limit in (10, 0):
        assert spatial.nearest_station(cell, twins, max_array=limit).first()["nearest_station_name"] == "early"


@pytest.mark.parametrize("mode", ["circle", "polygon64"])
def test_fire_flags_equal_brute_force(spark, sf, mode):
    grid, fires = spatial.grid_cells(spark), fx.fires(spark, sf)
    ids, cells = xy(spatial.projected(grid), "cell_id")
    _, points = xy(spatial.projected(fires, "latitude", "longitude"), "fire_id")
    dx = points[:, None, 0] - cells[None, :, 0]
    dy = points[:, None, 1] - cells[None, :, 1]
    reach = 25000.0
    if mode == "polygon64":
        step = np.pi / 32
        reach = reach * np.cos(step / 2) / np.cos(np.mod(np.arctan2(dy, dx), step) - step / 2)
    expected = set(ids[(np.hypot(dx, dy) < reach).any(axis=0)].tolist())
    flagged = spatial.flag_fire_history(grid, fires, mode=mode)
    assert {r["cell_id"] for r in flagged.filter("historical_fire = 1").collect()} == expected
    assert flagged.count() == 14952


def test_shuffled_radius_join_equals_broadcast(spark, sf):
    grid = spatial.grid_cells(spark)
    # Half of the fires crowd around one spot, many of them copies of each other.
    fires = fx.fires(spark, sf).selectExpr(
        "if(fire_id % 2 = 0, 61.25 + (fire_id % 10) / 10000D, latitude) AS latitude",
        "if(fire_id % 2 = 0, -110.3, longitude) AS longitude",
    )
    broadcast = spatial.flag_fire_history(grid, fires)
    shuffled = spatial.flag_fire_history(grid, fires, max_broadcast=9, hot_rows=2)
    assert broadcast.exceptAll(shuffled).isEmpty() and shuffled.count() == 14952


def test_fires_are_not_shuffled(spark, sf, plan_of):
    points = spatial.projected(fx.fires(spark, sf), "latitude", "longitude").select("x", "y")
    cells = spatial.projected(spatial.grid_cells(spark))
    plan = plan_of(spatial.cells_near(cells, points))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    # The only exchange besides the broadcast carries cell ids.
    assert plan.count("Exchange hashpartitioning") == 1


def test_point_on_the_radius_is_outside(spark):
    rows = spark.createDataFrame([(25000.0, 0.0), (24999.999, 0.0), (0.0, 24980.0)], "dx double, dy double")
    got = rows.selectExpr(
        f"{inside_buffer('dx', 'dy', 25000.0)} AS c", f"{inside_buffer('dx', 'dy', 25000.0, 'polygon64')} AS p"
    ).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True), (True, True)]
    with pytest.raises(ValueError):
        inside_buffer("dx", "dy", 1.0, "square")


def test_polygon_cuts_between_corners(spark):
    angle = np.pi / 64
    rows = spark.createDataFrame([(float(24980 * np.cos(angle)), float(24980 * np.sin(angle)))], "dx double, dy double")
    sql = [f"{inside_buffer('dx', 'dy', 25000.0, m)} AS {m}" for m in ("circle", "polygon64")]
    assert tuple(rows.selectExpr(*sql).first()) == (True, False)


def test_province_counts_over_the_grid(spark):
    named = spatial.grid_cells(spark).selectExpr(f"{province('lat', 'lon')} AS p")
    counts = {r["p"]: r["count"] for r in named.groupBy("p").count().collect()}
    assert counts == {
        "NU": 3654, "Unknown": 3488, "NT": 2078, "ON": 996, "QC": 968, "BC": 924, "NL": 810, "YT": 669,
        "AB": 460, "MB": 413, "SK": 368, "NS": 81, "NB": 33, "PE": 10,
    }


def test_shared_province_edges(spark):
    points = [(60.0, -114.1), (49.0, -110.0), (60.0, -102.0), (41.0, -141.0)]
    rows = spark.createDataFrame(points, "lat double, lon double")
    got = [r["p"] for r in rows.selectExpr(f"{province('lat', 'lon')} AS p").collect()]
    assert got == ["AB", "SK", "MB", "Unknown"]


def test_missing_positions_match_nothing(spark):
    lost = spark.createDataFrame(
        [(None, -100.0), (55.0, None), (float("nan"), -100.0), (None, None)], "latitude double, longitude double"
    )
    grid = spatial.grid_cells(spark)
    for limits in ({}, {"max_broadcast": 9, "hot_rows": 1}):
        flagged = spatial.flag_fire_history(grid, lost, **limits)
        assert flagged.count() == 14952 and flagged.filter("historical_fire = 1").isEmpty()
    cell = spark.createDataFrame([(1, None, -100.0)], "cell_id bigint, lat double, lon double")
    for limit in (100, 1):
        found = spatial.nearest_station(cell, spatial.stations(spark), max_array=limit).first()
        assert (found["nearest_station_name"], found["station_distance_m"]) == (None, None)


def test_sites_without_a_position_do_not_count(spark):
    cells = spatial.grid_cells(spark).filter("cell_id % 997 = 0")
    sites = spatial.stations(spark).unionByName(
        local_table(spark, [(99, "Nowhere", None, None)], "station_ord int, name string, lat double, lon double")
    )
    by_array = spatial.nearest_station(cells, sites)
    by_tiles = spatial.nearest_station(cells, sites, max_array=1)
    plain = spatial.nearest_station(cells, spatial.stations(spark))
    assert by_array.exceptAll(plain).isEmpty() and by_tiles.exceptAll(plain).isEmpty()
    assert by_array.filter("nearest_station_name IS NULL").isEmpty()
