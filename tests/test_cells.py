"""Windows of cells in keyed state: order of arrival, restarts, replays, trimming, added columns."""

import datetime
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from emberline.functions import fwi
from emberline.operators import history
from emberline.plans import fixtures as fx
from emberline.streaming import cells, state

SCHEMA = "cell_id bigint, file_date date, seq bigint, temperature double, humidity double, wind_speed double, rain_1h_mm double, pressure double"


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Folder:
    """A folder of landed rows with its stream."""

    def __init__(self, spark, path, window):
        self.spark, self.window = spark, window
        self.source, self.out, self.checkpoint = (str(path / name) for name in ("in", "out", "cp"))

    def run(self, added=()):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source)
        inputs = state.day_inputs(stream, "seq")
        if added:
            inputs = stream.select("cell_id", "file_date", "seq", *cells.INPUTS, *added)
        cells.start_cell_stream(inputs, self.out, self.checkpoint, window=self.window, added=added).awaitTermination()

    def land(self, *rows, added=()):
        self.spark.createDataFrame([(*row, 1000.0)[:8] for row in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        self.run(added)

    def days(self):
        rows = cells.current_windows(self.spark, self.out, self.window).collect()
        return {(row.cell_id, row.file_date.day): row.temperature for row in rows}

    def forget_last_commit(self):
        """As if the process had ended before the last micro-batch was noted as done."""
        commits = os.path.join(self.checkpoint, "commits")
        last = max((name for name in os.listdir(commits) if name.isdigit()), key=int)
        for name in (last, f".{last}.crc"):
            if os.path.exists(os.path.join(commits, name)):
                os.remove(os.path.join(commits, name))


def day(n):
    return datetime.date(2024, 6, n)


@pytest.mark.parametrize("window", [45, 6])
def test_shuffled_arrival_restart_and_replay_equal_batch(spark, sf, tmp_path, window):
    rows = fx.wx_events(spark, sf).selectExpr(
        "cell_id", "file_date", "event_id AS seq", "temperature", "humidity", "wind_speed", "rain_1h_mm", "cast(NULL AS double) AS pressure"
    )
    folder = Folder(spark, tmp_path, window)
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == half).repartition(2, "seq").write.mode("append").parquet(folder.source)
        folder.run()
    folder.forget_last_commit()
    folder.run()
    got = state.codes_of_days(cells.current_windows(spark, folder.out, window), 7)
    daily = history.last_per_day(history.newest_dates(rows.drop("pressure"), window), ["seq"])
    expected = fwi.with_fire_indices(history.accumulate_codes(daily, 7)).select(*got.columns)
    got, expected = (sorted(map(tuple, df.collect())) for df in (got, expected))
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-12)


def test_a_micro_batch_writes_only_the_cells_it_touched(spark, tmp_path):
    folder = Folder(spark, tmp_path, 3)
    folder.land((1, day(1), 1, 20.0, 40.0, 5.0, 0.0), (2, day(1), 2, 21.0, 40.0, 5.0, 0.0))
    folder.land((2, day(2), 3, 22.0, 40.0, 5.0, 0.0), (None, day(2), 4, 9.0, 40.0, 5.0, 0.0))
    touched = {}
    for row in cells.read_windows(spark, folder.out).collect():
        touched.setdefault(row.batch, set()).add(row.cell_id)
    assert [touched[batch] for batch in sorted(touched)] == [{1, 2}, {2}]
    assert folder.days() == {(1, 1): 20.0, (2, 1): 21.0, (2, 2): 22.0}
    cells.compact_windows(spark, folder.out, str(tmp_path / "compact"))
    compacted = cells.read_windows(spark, str(tmp_path / "compact"))
    assert compacted.count() == 3 and compacted.select("batch").distinct().count() == 1
    folder.out = str(tmp_path / "compact")
    folder.land((1, day(2), 5, 25.0, 40.0, 5.0, 0.0))
    assert folder.days() == {(1, 1): 20.0, (1, 2): 25.0, (2, 1): 21.0, (2, 2): 22.0}


def test_windows_are_trimmed_and_old_snapshots_change_nothing(spark, tmp_path):
    folder = Folder(spark, tmp_path, 3)
    folder.land(*[(1, day(n), n, 20.0 + n, 40.0, 5.0, 0.0) for n in range(1, 5)])
    assert folder.days() == {(1, 2): 22.0, (1, 3): 23.0, (1, 4): 24.0}
    # Too old; an older snapshot of a day; a newer one; two of a day in one micro-batch.
    folder.land(
        (1, day(1), 9, 50.0, 1.0, 5.0, 0.0), (1, day(4), 3, -9.0, 40.0, 5.0, 0.0), (1, day(3), 10, 30.0, 40.0, 5.0, 0.0),
        (1, day(2), 12, 32.0, 40.0, 5.0, 0.0), (1, day(2), 11, 31.0, 40.0, 5.0, 0.0),
    )
    assert folder.days() == {(1, 2): 32.0, (1, 3): 30.0, (1, 4): 24.0}
    # Another cell moves the window of all cells on.
    folder.land((2, day(6), 20, 6.0, 40.0, 5.0, 0.0), (2, day(7), 21, 7.0, 40.0, 5.0, 0.0))
    assert folder.days() == {(1, 4): 24.0, (2, 6): 6.0, (2, 7): 7.0}


def test_a_column_can_be_added_to_stored_state(spark, tmp_path):
    folder = Folder(spark, tmp_path, 3)
    folder.land((1, day(1), 1, 20.0, 40.0, 5.0, 0.0), (2, day(1), 2, 21.0, 40.0, 5.0, 0.0))
    folder.land((1, day(2), 3, 22.0, 40.0, 5.0, 0.0, 990.0), added=("pressure",))
    rows = cells.current_windows(spark, folder.out, 3).collect()
    assert {(row.cell_id, row.file_date.day): row.pressure for row in rows} == {(1, 1): None, (1, 2): 990.0, (2, 1): None}
    assert folder.days() == {(1, 1): 20.0, (1, 2): 22.0, (2, 1): 21.0}


class Value:
    """A value state that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Handle:
    def __init__(self):
        self.state = Value()

    def getValueState(self, name, schema, *args):
        return self.state


def test_the_store_is_asked_twice_per_cell_however_many_days():
    window, handle = cells.CellWindow(30), Handle()
    window.init(handle)
    row = Row("day", *window.columns)
    for n, days in enumerate((range(20), range(10, 40)), 1):
        out = list(window.handleInputRows((7,), iter([row(d, 100 * n + d, None, 1.0, 2.0, float(d)) for d in days]), None))
        assert handle.state.calls == 2 * n
    assert [tuple(r) for r in out] == [(7, d, 200 + d, None, 1.0, 2.0, float(d)) for d in range(10, 40)]


def test_other_streams_keep_their_store(spark, tmp_path):
    """A stream that drops duplicates does not take the encoding of the keyed state."""
    before = {name: spark.conf.get(name, None) for name in cells.STORE}
    folder = Folder(spark, tmp_path, 3)
    folder.land((1, day(1), 1, 20.0, 40.0, 5.0, 0.0))
    assert {name: spark.conf.get(name, None) for name in cells.STORE} == before
