"""Index formulas: published example, range edges, missing values, order independence."""

import datetime
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.constants import DANGER_CLASSES, MONTH_FACTOR_OTHER, MONTH_FACTORS
from emberline.functions import classify, clean, fwi
from emberline.operators import history
from emberline.plans import oracles

DAY = datetime.date(2024, 1, 1)
INPUTS = "cell_id bigint, file_date date, temperature double, humidity double, wind_speed double, rain_1h_mm double"


def weather(spark, rows):
    return spark.createDataFrame(rows, INPUTS)


def indices(spark, rows, month, float32=False):
    codes = history.accumulate_codes(weather(spark, rows), month, float32=float32)
    return {r["cell_id"]: r for r in fwi.with_fire_indices(codes).collect()}


def test_published_example(spark):
    got = indices(spark, [(1, DAY, 17.0, 42.0, 25.0, 0.0)], 4)[1]
    expected = {
        "ffmc": 87.69298, "dmc": 6.17895, "dc": 23.028, "isi": 10.85366,
        "bui": 7.39588, "fwi": 9.52085, "dsr": 1.46833,
    }
    for name, value in expected.items():
        assert got[name] == pytest.approx(value, abs=6e-6), name


EDGES = list(
    itertools.product(
        [None, -60.0, -2.81, -2.8, -1.11, -1.1, -1.0, 25.0, 60.0],
        [None, 0.0, 1.0, 29.99, 100.0, 120.0],
        [None, 0.0, 15.01, 150.0],
        [0.0, 0.5, 0.51, 1.5, 1.51, 2.8, 2.81, 600.0],
    )
)


@pytest.mark.parametrize("month", [1, 7])
def test_edges_match_recursive_sql(spark, month):
    # Three days per cell: the edge, a wet day, the edge again; so the codes differ from the start.
    rows = []
    for cell, (t, h, w, r) in enumerate(EDGES):
        rows += [
            (cell, DAY, t, h, w, r),
            (cell, DAY + datetime.timedelta(1), 20.0, 60.0, 10.0, 20.0),
            (cell, DAY + datetime.timedelta(3), t, h, w, r),
        ]
    got = indices(spark, rows, month)
    con = duckdb.connect()
    con.execute("CREATE TABLE days (cell_id BIGINT, file_date DATE, temperature DOUBLE, humidity DOUBLE, wind_speed DOUBLE, rain_1h_mm DOUBLE)")
    con.executemany("INSERT INTO days VALUES (?, ?, ?, ?, ?, ?)", rows)
    ctes = oracles.accumulated("days", month).replace("AS float)", "AS double)")
    names = fwi.INDEX_NAMES
    con.execute(oracles.with_(f"{ctes},\n{oracles.INDICES}", f"SELECT cell_id, {', '.join(names)} FROM indices", True))
    expected = con.fetchall()
    assert len(expected) == len(EDGES) == len(got)
    for cell, *values in expected:
        for name, value in zip(names, values):
            assert got[cell][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (EDGES[cell], name)


def test_long_fold_stays_in_range_and_ignores_row_order(spark):
    rows = (
        spark.range(40 * 45)
        .selectExpr(
            "id % 40 AS cell_id", "date_add(DATE'2024-05-01', cast(id div 40 AS int)) AS file_date",
            "(hash(id, 1) % 600) / 10D AS temperature", "(abs(hash(id, 2)) % 1100) / 10D AS humidity",
            "(abs(hash(id, 3)) % 400) / 10D AS wind_speed",
            "if(id % 3 = 0, (abs(hash(id, 4)) % 300) / 10D, 0D) AS rain_1h_mm",
        )
    )
    one = history.accumulate_codes(rows.coalesce(1), 7)
    other = history.accumulate_codes(rows.repartition(7, F.rand(3)), 7)
    a, b = (fwi.with_fire_indices(x).orderBy("cell_id").collect() for x in (one, other))
    assert a == b and len(a) == 40
    for r in a:
        assert 0 <= r["ffmc"] <= 101
        assert min(r["dmc"], r["dc"], r["bui"], r["isi"], r["fwi"], r["dsr"]) >= 0


def test_month_factor(spark):
    rows = spark.createDataFrame([(m,) for m in (0, 1, 7, 12, 13, None)], "m int")
    got = {r["m"]: r["f"] for r in rows.selectExpr("m", f"{fwi.month_factor('m')} AS f").collect()}
    assert got == {0: MONTH_FACTOR_OTHER, 1: MONTH_FACTORS[0], 7: 6.4, 12: MONTH_FACTORS[11], 13: MONTH_FACTOR_OTHER, None: MONTH_FACTOR_OTHER}
    assert fwi.month_factor(13) == "1.4D" and fwi.month_factor(7) == "6.4D"


def test_bounded_and_finite(spark):
    values = ["NaN", "Infinity", "-Infinity", "abc", None, "-80", "12.5", "99"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    sql = rows.selectExpr(f"{clean.bounded('v', 'temperature')} AS b", f"{clean.finite('v')} AS f")
    assert [tuple(r) for r in sql.collect()] == [
        (15.0, None), (15.0, None), (15.0, None), (15.0, None), (15.0, None),
        (-50.0, -80.0), (12.5, 12.5), (50.0, 99.0),
    ]


def test_missing_precipitation_makes_the_sum_missing(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 2.0)], "rain_1h_mm double, snow_3h_mm double")
    total = clean.total_precip(rows.columns)
    assert [r["t"] for r in rows.selectExpr(f"{total} AS t").collect()] == [3.0, None, None]


def test_absent_input_columns_use_defaults(spark):
    rows = spark.createDataFrame([(1,)], "k int")
    assert tuple(clean.index_inputs(rows, ["k"]).first()) == (1, 15.0, 50.0, 10.0, 0.0)


def test_text_inputs(spark):
    rows = spark.createDataFrame(
        [("20", "abc", "", "1e300"), ("NaN", "-5", "inf", None)],
        "temperature string, humidity string, wind_speed string, rain_1h_mm string",
    )
    expected = [(20.0, 50.0, 10.0, 0.0), (15.0, 1.0, 10.0, 0.0)]
    assert [tuple(r) for r in clean.index_inputs(rows, []).collect()] == expected
    assert clean.index_inputs(rows, [], float32=False).first()["rain"] == 500.0


def test_single_precision_inputs(spark):
    rows = weather(spark, [(1, DAY, 17.3, 42.0, 25.0, 0.0)])
    assert clean.index_inputs(rows, []).first()["temperature"] == 17.299999237060547
    assert clean.index_inputs(rows, [], float32=False).first()["temperature"] == 17.3


def test_classes_and_risk(spark):
    values = [-5.0, 0.0, 0.999, 1.0, 2.999, 3.0, 7.0, 16.9, 17.0, 30.0, 120.0, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr(f"{clean.bounded('v', 'fwi')} AS v")
    got = rows.selectExpr(
        f"{classify.danger_class('v')} AS c", f"{classify.base_risk('v')} AS r", f"{classify.color_code('v')} AS k"
    ).collect()
    order = [0, 0, 0, 1, 1, 2, 3, 3, 4, 5, 5, 2, 2]
    assert [tuple(r) for r in got] == [DANGER_CLASSES[i][1:4] for i in order]


def test_risk_adjustment(spark):
    rows = spark.createDataFrame([(0.65, 1), (0.95, 1), (0.95, 0), (None, 0)], "b double, h int")
    got = [r["x"] for r in rows.selectExpr(f"{classify.adjusted_risk('b', 'h')} AS x").collect()]
    assert got == pytest.approx([0.65 * 1.15, 0.98, 0.95, 0.15])


def test_class_listing(spark):
    rows = classify.danger_classes(spark).orderBy("class_ord").collect()
    assert [r["fwi_range"] for r in rows] == ["0-1 FWI", "1-3 FWI", "3-7 FWI", "7-17 FWI", "17-30 FWI", "30+ FWI"]


def test_json_clean_reaches_every_depth(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [(1, nan, (float("inf"), [(nan, "a"), (2.0, None)]), [1.0, nan, None]), (2, None, None, None)],
        "id int, v double, s struct<x: double, items: array<struct<y: double, t: string>>>, a array<double>",
    )
    first, second = clean.json_clean(rows).orderBy("id").collect()
    assert first["v"] == 0.0 and first["s"]["x"] == 0.0 and first["a"] == [1.0, 0.0, None]
    assert [tuple(i) for i in first["s"]["items"]] == [(0.0, "a"), (2.0, None)]
    assert tuple(second) == (2, None, None, None)
