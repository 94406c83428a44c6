"""What the operators of this folder share: words, columns, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import scratch_dir

# Fixed value: what separates words; all else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# First field of rows kept as a struct, so that the struct is never empty; no column has this name.
PRESENT = "__present__"


def words_of(text: str | bytes) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at just the characters of BLANKS."""
    return (text.encode() if isinstance(text, str) else text).split()


def n_words(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_repeat(rows: DataFrame) -> bool:
    """Whether a value of ``id`` other than null stands in several rows."""
    return not rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number ``row`` that no other row has: the id (no nulls), unless ids repeat.

    Then the rows are written out with a number each, so that it stays theirs.
    """
    if not ids_repeat(rows):
        return rows.withColumn("row", F.col("id"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


# Rows of an Arrow batch: few, as a row may hold a very long text.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands rows to Python in batches of BATCH_ROWS at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str, flush: int = 20_000) -> DataFrame:
    """Rows made by ``rows(*values)`` from each row of ``df``; batches hold about ``flush`` rows.

    A batch is handed on as soon as it is full, so that a task holds one batch of input
    and one of output.
    """
    arrow = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            columns = [column.to_pylist() if column.type != pa.null() else [None] * len(column) for column in batch.columns]
            for values in zip(*columns):
                out.extend(rows(*values))
                if len(out) >= flush:
                    yield to_batch(out, arrow)
                    out = []
        if out:
            yield to_batch(out, arrow)

    return small_batches(df).mapInArrow(run, schema)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows), arrow)], schema=arrow)


def arrays_to_batch(columns: list[np.ndarray | list], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(columns, arrow)], schema=arrow)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


arrow_schema = _arrow_schema
