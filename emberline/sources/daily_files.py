"""Folders of date-named CSV files as a data source of their own.

A file is one partition.  Its task opens it, reads the header and then the rows as Arrow
batches, and leaves the whole file out if a number in it cannot be read; nothing is read on
the driver but the listing.  A filter on ``file_date`` leaves out files by their names, and
``newest`` keeps the last so many names before that.

What is known of a file is held until its last row is sound, up to ``HELD_BYTES``; a larger
one is read once to be judged and a second time for its rows.

The folder is listed and read with pyarrow, so it must be on a file system that pyarrow
knows; the readers in ``weather`` go through Spark's own file systems.  This module is sent to
workers as a whole and imports nothing of this package.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import DateType, StringType, StructField, StructType

HELD_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
SUFFIX = ".csv"

COMPARED: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
}


class BadFile(ValueError):
    """A file that is left out as a whole."""


@dataclass(frozen=True)
class Rules:
    """The wanted columns, those that must be numbers, what a number looks like, what counts as missing."""

    columns: list[str]
    numbers: list[str]
    number: str
    missing: list[str]

    def check(self, batch: pa.RecordBatch) -> None:
        for name in self.numbers:
            if name in batch.schema.names:
                column = batch.column(name)
                missing = pc.is_in(column, pa.array(self.missing, pa.string()))
                sound = pc.match_substring_regex(pc.utf8_trim(column, " "), self.number)
                if pc.any(pc.invert(pc.or_(missing, pc.fill_null(sound, True)))).as_py():
                    raise BadFile(name)


def header_of(first: bytes) -> list[str]:
    """The names in a first line."""
    line = first.decode("utf-8-sig").rstrip("\r\n")
    return [name.strip() for name in next(csv.reader([line]), [])]


def first_line(file: Any) -> bytes:
    """The first line of an open file, which then stands behind it."""
    found = b""
    while b"\n" not in found and (more := file.read(4_096)):
        found += more
    line, end, _ = found.partition(b"\n")
    file.seek(len(line) + len(end))
    return line


def text_batches(file: Any) -> Iterator[pa.RecordBatch]:
    """The rows of an open file as text; a row that is too short ends in nulls, one too long spoils the file."""
    names = header_of(first_line(file))
    if not names:
        return
    short: list[str] = []

    def uneven(row: pacsv.InvalidRow) -> str:
        short.append(row.text if row.actual_columns < row.expected_columns else "")
        return "skip"

    def padded() -> Iterator[pa.RecordBatch]:
        if "" in short:
            raise BadFile("a row with too many values")
        for values in csv.reader(io.StringIO("\n".join(short))):
            cells = [value or None for value in values] + [None] * (len(names) - len(values))
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.string()) for cell in cells], names=names)

    rest = file.read(1)
    if not rest:
        return
    file.seek(file.tell() - 1)
    reader = pacsv.open_csv(
        file,
        read_options=pacsv.ReadOptions(column_names=names, block_size=BLOCK_BYTES, use_threads=False),
        parse_options=pacsv.ParseOptions(invalid_row_handler=uneven, newlines_in_values=True),
        convert_options=pacsv.ConvertOptions(
            column_types={name: pa.string() for name in names}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False
        ),
    )
    yield from reader
    yield from padded()


def rows_of_file(open_file: Callable[[], Any], rules: Rules, held_bytes: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a sound file; none of another."""
    held: list[pa.RecordBatch] = []
    size, whole = 0, True
    try:
        with open_file() as file:
            for batch in text_batches(file):
                rules.check(batch)
                size += batch.nbytes
                whole = whole and size <= held_bytes
                held = [*held, batch] if whole else []
    except BadFile:
        return
    if whole:
        yield from held
    else:
        with open_file() as file:
            yield from text_batches(file)


def day_of(name: str) -> date | None:
    try:
        return date.fromisoformat(name.removesuffix(SUFFIX))
    except ValueError:
        return None


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if folder.startswith("file:/"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def newest_names(folder: str, newest: int) -> list[tuple[str, str]]:
    """Names and paths of the files of a folder, the last names first; all if ``newest`` is negative."""
    files, inside = file_system(folder)
    listed = files.get_file_info(pafs.FileSelector(inside))
    named = sorted(((info.base_name, info.path) for info in listed if info.is_file and info.base_name.endswith(SUFFIX)), reverse=True)
    if not named:
        raise FileNotFoundError("no daily weather files")
    return named if newest < 0 else named[:newest]


@dataclass
class DayFile(InputPartition):
    """One file."""

    path: str
    name: str


class DailyFilesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.folder = options["path"]
        self.newest = int(options.get("newest", -1))
        self.rules = Rules(*(json.loads(options[key]) for key in ("columns", "numbers", "number", "missing")))
        self.kept: list[tuple[type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if type(one) in COMPARED and one.attribute == ("file_date",) and one.value is not None:
                self.kept.append((type(one), one.value))
            else:
                yield one

    def partitions(self) -> list[DayFile]:
        def wanted(day: date | None) -> bool:
            return all(day is not None and COMPARED[kind](day, value) for kind, value in self.kept)

        return [DayFile(path, name) for name, path in newest_names(self.folder, self.newest) if wanted(day_of(name))] or [DayFile("", "")]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = file_system(self.folder)
        for batch in rows_of_file(lambda: files.open_input_file(partition.path), self.rules):
            n = batch.num_rows
            columns = [batch.column(name) if name in batch.schema.names else pa.nulls(n, pa.string()) for name in self.rules.columns]
            fixed = [pa.array([partition.name] * n, pa.string()), pa.array([day_of(partition.name)] * n, pa.date32())]
            yield pa.RecordBatch.from_arrays([*columns, *fixed], names=[field.name for field in self.schema.fields])


class DailyFiles(DataSource):
    """``spark.read.format("daily_files")``; see ``read_daily_folder``."""

    @classmethod
    def name(cls) -> str:
        return "daily_files"

    def schema(self) -> StructType:
        names = json.loads(self.options["columns"])
        return StructType([*(StructField(name, StringType()) for name in [*names, "file_name"]), StructField("file_date", DateType())])

    def reader(self, schema: StructType) -> DailyFilesReader:
        return DailyFilesReader(schema, dict(self.options))


def read_daily_folder(
    spark: SparkSession, folder: str, columns: list[str], numbers: list[str], number: str, missing: list[str], newest: int = -1
) -> DataFrame:
    """``columns`` of all sound files of a folder as text, with ``file_name`` and ``file_date``.

    A column that a file lacks is NULL in its rows, others of a file are left out.
    """
    newest_names(folder, newest)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DailyFiles)
    options = {"columns": columns, "numbers": numbers, "number": number, "missing": missing}
    reader = spark.read.format("daily_files").options(**{key: json.dumps(value) for key, value in options.items()})
    return reader.option("newest", newest).load(folder)
