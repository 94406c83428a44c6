"""The data source of date-named files: headers, bad files, uneven rows, filters, one opening per file."""

import datetime
import io

import pyarrow as pa
import pytest

from emberline.constants import MISSING_TOKENS
from emberline.sources import daily_files as d
from emberline.sources import weather

COLUMNS = ["lat", "lon", "date", "temperature", "humidity"]
NUMBERS = ["lat", "lon", "temperature", "humidity"]


def rules(columns=COLUMNS):
    return d.Rules(columns, NUMBERS, weather.NUMBER, list(MISSING_TOKENS))


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / (name.removeprefix("d").replace("_", "-") + ".csv")).write_text(text)


def load(spark, folder, n=45):
    return weather.load_history(spark, str(folder), n, COLUMNS)


def test_headers_order_and_bad_files(spark, tmp_path):
    write(
        tmp_path / "in",
        d2024_06_01="lat,lon,date,temperature,humidity\n50.0,-110.0,x,1.5,40\n51.0,-110.0,\"a, b\",,41\n",
        d2024_06_02="﻿temperature,lat,lon\r\n2.5,50.0,-110.0\r\n",
        d2024_06_03="lat,lon,temperature\n50.0,-110.0,1d\n",
        d2024_06_04="lat,lon,temperature\n50.0,-110.0\n\n51.0,-110.0, 7 \n52.0,-110.0,nan\n",
        d2024_06_05="lat,lon,temperature\n50.0,-110.0,1,2\n",
        d2024_06_06="lat,lon,temperature\n",
        d2024_06_07="",
        notes="lat,lon,temperature\n1,2,3\n",
    )
    rows = load(spark, tmp_path / "in").collect()
    got = {(row.file_date.day if row.file_date else None, row.lat): (row.temperature, row.humidity, row.date) for row in rows}
    nan = got.pop((4, 52.0))
    assert nan[0] != nan[0]
    assert got == {
        (1, 50.0): (1.5, 40.0, "x"), (1, 51.0): (None, 41.0, "a, b"), (2, 50.0): (2.5, None, None), (4, 50.0): (None, None, None),
        (4, 51.0): (7.0, None, None), (None, 1.0): (3.0, None, None),
    }


def test_the_window_counts_files_before_bad_ones_go(spark, tmp_path):
    write(tmp_path / "in", **{f"d2024_06_0{i}": f"lat,temperature\n{i},{'bad' if i == 3 else i}\n" for i in range(1, 5)})
    assert sorted(row.lat for row in load(spark, tmp_path / "in", 3).collect()) == [2.0, 4.0]
    with pytest.raises(Exception, match="no daily weather files"):
        (tmp_path / "none").mkdir()
        load(spark, tmp_path / "none").collect()


def test_filters_on_the_date_leave_out_files(spark, tmp_path):
    write(tmp_path / "in", **{f"d2024_06_0{i}": f"lat,temperature\n{i},{i}\n" for i in range(1, 6)})
    reader = d.DailyFilesReader(
        d.StructType([]), {"path": str(tmp_path / "in"), "columns": "[]", "numbers": "[]", "number": '""', "missing": "[]"}
    )
    day = lambda i: datetime.date(2024, 6, i)
    rest = list(reader.pushFilters([d.GreaterThan(("file_date",), day(2)), d.LessThanOrEqual(("file_date",), day(4)), d.EqualTo(("lat",), "3")]))
    assert rest == [d.EqualTo(("lat",), "3")]
    assert [part.name for part in reader.partitions()] == ["2024-06-04.csv", "2024-06-03.csv"]
    some = load(spark, tmp_path / "in").where("file_date > DATE'2024-06-02' AND file_date <= DATE'2024-06-04'")
    assert some.rdd.getNumPartitions() == 2 and sorted(row.lat for row in some.collect()) == [3.0, 4.0]
    assert load(spark, tmp_path / "in").where("file_date IN (DATE'2024-06-01', DATE'2030-01-01')").count() == 1
    assert load(spark, tmp_path / "in").where("file_date = DATE'2030-01-01'").count() == 0




def counting(text):
    opened = []

    def open_file():
        opened.append(1)
        return pa.PythonFile(io.BytesIO(text.encode()), mode="r")

    return open_file, opened


def test_a_file_is_opened_once_unless_it_is_too_large_to_hold():
    text = "lat,lon,date,temperature,humidity\n" + "".join(f"{i},1,x,2,3\n" for i in range(200_000))
    for held, times in ((1 << 30, 1), (1 << 20, 2)):
        open_file, opened = counting(text)
        assert sum(batch.num_rows for batch in d.rows_of_file(open_file, rules(), held)) == 200_000
        assert len(opened) == times
    open_file, opened = counting(text + "a,1,x,2,3\n")
    assert list(d.rows_of_file(open_file, rules(), 1 << 20)) == [] and len(opened) == 1


def test_equal_to_the_scan_by_spark(spark, tmp_path):
    write(tmp_path / "in", **{f"d2024_06_{i:02d}": f"lat,lon,temperature\n{i},2,{'x' if i % 4 == 0 else i}\n3.5,,NULL\n" for i in range(1, 12)})
    paths = weather.newest_files(spark, str(tmp_path / "in"), 9)
    scanned = weather.typed_daily(weather.read_daily_files(spark, paths, COLUMNS), NUMBERS)
    read = load(spark, tmp_path / "in", 9).select(scanned.columns)
    assert sorted(map(str, read.collect())) == sorted(map(str, scanned.collect())) and read.count() == 14
