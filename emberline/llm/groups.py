"""Whole groups of a sorted table, handed to a function in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
ROWS_AT_ONCE = 250


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    work: Callable[[pa.Table], pa.RecordBatch | None],
    schema: str,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``work`` over tables that hold whole groups of equal ``keys``, sorted by keys and ``order``.

    Small groups are put together up to about ``batch_bytes``, so the cost of a call is
    shared.  The caller bounds the size of one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys, batch_bytes):
            made = work(part)
            if made is not None and made.num_rows:
                yield made

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], batch_bytes: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            piece = batch.slice(at, ROWS_AT_ONCE)
            held.append(piece)
            size += piece.get_total_buffer_size() if piece.num_rows == batch.num_rows else piece.nbytes
            if size < batch_bytes:
                continue
            together = pa.Table.from_batches(held)
            cut = last_group_start(together, keys)
            if cut:
                yield together.slice(0, cut)
                # Copied, so that the rest does not keep the whole in memory.
                rest = pa.Table.from_batches([pa.concat_batches(together.slice(cut).to_batches())])
                held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def last_group_start(rows: pa.Table, keys: list[str]) -> int:
    """The place where the last group begins."""
    n = rows.num_rows
    start = 0
    for key in keys:
        column = rows.column(key)
        same = pc.fill_null(pc.equal(column, column[n - 1]), column[n - 1].as_py() is None)
        different = pc.indices_nonzero(pc.invert(same))
        if len(different):
            start = max(start, different[-1].as_py() + 1)
    return start
