"""Windows of text that occur more than once in a corpus: what is common to the operators on them.

A text is a sequence of items (bytes or words).  Each window of ``width`` items is named by
its anchor: the least hash among the runs of ``gram`` items in it.  Equal windows have equal
anchors, so it is enough to compare windows of the same anchor.  Consecutive windows mostly
share their anchor and stay together as one segment of text, which is about as long as the
window itself; a segment, not each of its windows, is what moves between machines.

1. Anchors that occur once in the corpus are dropped (twice in one segment counts as twice).  That leaves the text that may repeat.
2. Segments of equal text are merged, so a copy costs a row of numbers and no text.
3. The different segments of an anchor are brought together with their text and given to an
   operator, many small groups at a time.  Groups over ``group_items`` are split further:
   there each window goes its own way, by a digest of its items.
4. What was found is joined to the documents, and applied only where the text is the same.

A group that holds a third of all rows is counted before the shuffle in 1 and 2, and never
gathered in one task in 3.  Rows are joined by a number of their own; the id only orders the
corpus, so that rows of one id, or without one, are documents like all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberline.llm.common import PRESENT, arrays_to_batch, arrow_schema, numbered, small_batches, stored
from emberline.llm.groups import map_groups
from emberline.llm.hashing import mix, run_hashes, sliding_min

NO_ID = -(2**63)
# A place: the first window in the upper 32 bits, whether the anchor occurs twice in the
# segment, so that windows of it may equal each other, and the number of windows.
TWICE = 2**31
WINDOWS = TWICE - 1
SEGMENTS = "key long, seg long, id long, row long, place long"
TEXTS = "key long, seg long, id long, row long, place long, copies long, content binary"
FOUND = "row long, place long, a int, b int"


@dataclass(frozen=True)
class Items:
    """How a text is a sequence of items.

    ``split`` gives the text in the form in which equal windows are equal bytes, a hash per
    item, and where items start and end; ``codes`` numbers the items of several contents so
    that the order of numbers is the order of items and no item has number 0.
    """

    width: int
    gram: int
    split: Callable[[bytes], tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]
    codes: Callable[[list[bytes]], list[np.ndarray]]
    batch_bytes: int
    group_items: int


@dataclass
class Piece:
    """One segment given to an operator: its codes, where it lies, how often it occurs."""

    codes: np.ndarray
    id: int
    row: int
    start: int
    copies: int

    @property
    def order(self) -> tuple[int, int, int]:
        """Its place in the corpus."""
        return self.id, self.row, self.start


def segments(hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: anchor, first window, number of windows,
    and whether the anchor occurs in it twice."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = run_hashes(hashes, gram)
    anchors = sliding_min(grams, width - gram + 1)
    lows = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
    keys, counts = anchors[lows], np.diff(np.append(lows, len(anchors)))

    # Where the anchors occur: found by their upper bits first, which few other runs share.
    likely = np.zeros(1 << 14, bool)
    likely[(keys >> np.uint64(50)).astype(np.int64)] = True
    near = np.flatnonzero(likely[(grams >> np.uint64(50)).astype(np.int64)])
    known = np.unique(keys)
    number = np.minimum(np.searchsorted(known, grams[near]), len(known) - 1)
    real = known[number] == grams[near]
    span = len(grams) + 1
    occurs = np.sort(number[real] * span + near[real])
    base = np.searchsorted(known, keys) * span + lows
    twice = np.searchsorted(occurs, base + counts + width - gram) - np.searchsorted(occurs, base) > 1
    return mix(keys), lows, counts, twice


def _content(data: bytes, starts: np.ndarray, ends: np.ndarray, low: int, windows: int, width: int) -> bytes:
    return data[int(starts[low]) : int(ends[low + windows + width - 2])]


def _segment_hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content) - 2**63


def text_segments(docs: DataFrame, items: Items, hashed: bool) -> DataFrame:
    """Rows of SEGMENTS for ``docs`` (``id, row, text``); see ``TWICE`` for ``place``.

    ``seg`` is the hash of the segment's text if ``hashed``, else 0.
    """
    arrow = arrow_schema(docs, SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0

        def flush() -> pa.RecordBatch:
            batch = arrays_to_batch([np.concatenate(column) for column in held], arrow)
            for column in held:
                column.clear()
            return batch

        for batch in batches:
            for doc_id, row, text in zip(*batch.columns):
                data, hashes, starts, ends = items.split((text.as_py() or "").encode())
                keys, lows, counts, twice = segments(hashes, items.width, items.gram)
                if not len(keys):
                    continue
                if hashed:
                    a, b = starts[lows].tolist(), ends[lows + counts + (items.width - 2)].tolist()
                    seg = np.array([_segment_hash(data[x:y]) for x, y in zip(a, b)], np.int64)
                else:
                    seg = np.zeros(len(keys), np.int64)
                for column, values in zip(held, (keys.view(np.int64), seg, np.full(len(keys), doc_id.as_py()), np.full(len(keys), row.as_py()), (lows << 32) | (twice * TWICE) | counts)):
                    column.append(values)
                size += len(keys)
                if size >= 50_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return small_batches(docs.select("id", "row", "text")).mapInArrow(run, SEGMENTS)


def repeated_stretches(
    docs: DataFrame, items: Items, find: Callable[[list[Piece], int, bool], list[np.ndarray]], later_only: bool
) -> DataFrame:
    """Rows of FOUND: the items ``a`` to ``b`` of a segment (by its start) lie in repeated windows.

    ``docs`` has ``id, row, text``, see ``numbered``.  ``find(pieces, width, later_only)`` gives, for each piece,
    the windows in it that occur elsewhere in the pieces; with ``later_only`` only those
    that occur earlier, in order of id and place.
    """
    width = items.width
    twice = F.col("place").bitwiseAND(F.lit(TWICE)) != 0
    occurs = F.sum(F.when(twice, 2).otherwise(1))
    shared = text_segments(docs, items, hashed=False).groupBy("key").agg(occurs.alias("n")).where("n > 1").select("key")
    again = stored(text_segments(docs, items, hashed=True).join(shared, "key"), "repeats")
    kinds = stored(
        again.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("id", "row", "place")).alias("first"))
        .select("key", "seg", "copies", "first.id", "first.row", "first.place"),
        "repeat-kinds",
    )
    windows = F.col("place").bitwiseAND(F.lit(WINDOWS))
    held = F.sum(windows + (width - 1)).alias("items")
    sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max(twice).alias("twice"), held).where("kinds > 1 OR twice")

    # Segments that occur as a whole more than once.
    copied = again.join(kinds.where("copies > 1").select("key", "seg", F.col("row").alias("first_row"), F.col("place").alias("first_place")), ["key", "seg"])
    if later_only:
        copied = copied.where("row <> first_row OR place <> first_place")
    whole = copied.select("row", "place", F.lit(0).alias("a"), (windows + (width - 1)).cast("int").alias("b"))

    # Different segments of one anchor.
    texts = stored(_with_texts(docs, kinds.join(sizes.select("key", "items"), "key"), items), "repeat-texts")
    small = texts.where(F.col("items") <= items.group_items).drop("items")
    large = texts.where(F.col("items") > items.group_items).drop("items")
    arrow = arrow_schema(docs, FOUND)

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        columns = rows.select(["id", "row", "place", "copies"]).to_pydict()
        pieces = [
            Piece(codes, doc_id, row, place >> 32, copies)
            for codes, doc_id, row, place, copies in zip(items.codes(rows.column("content").to_pylist()), *columns.values())
        ]
        out = []
        for i, starts in enumerate(find(pieces, width, later_only)):
            if later_only or pieces[i].copies == 1:
                out += [(pieces[i].row, columns["place"][i], a, b) for a, b in stretches(starts, width)]
        return arrays_to_batch(list(zip(*out)), arrow) if out else None

    # Sorted by place, so that an operator sees the pieces in the order of the corpus.
    parts = map_groups(small, ["key"], ["id", "row", "place"], work, FOUND, items.batch_bytes)
    found = whole.unionByName(parts)
    if not large.isEmpty():
        found = found.unionByName(_by_window(large, items, later_only))
    return found


def stretches(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The stretches covered by the windows at ascending ``starts``; touching ones are one."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > width)
    lows, highs = np.append(starts[0], starts[breaks + 1]), np.append(starts[breaks], starts[-1]) + width
    return list(zip(lows.tolist(), highs.tolist()))


def _with_texts(docs: DataFrame, kinds: DataFrame, items: Items) -> DataFrame:
    """``kinds`` with the text of each segment: rows of TEXTS and the size of their group."""
    wanted = kinds.groupBy("row").agg(F.collect_list(F.struct("key", "seg", "id", "place", "copies", "items")).alias("wanted"))
    schema = TEXTS + ", items long"
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row, text, segs in zip(*batch.columns):
                row = row.as_py()
                data, hashes, starts, ends = items.split((text.as_py() or "").encode())
                for seg in segs.as_py():
                    low, windows = seg["place"] >> 32, seg["place"] & WINDOWS
                    content = _content(data, starts, ends, low, windows, items.width)
                    rows.append((seg["key"], seg["seg"], seg["id"], row, seg["place"], seg["copies"], content, seg["items"]))
                    size += len(content)
                if size > 4 << 20:
                    yield arrays_to_batch(list(zip(*rows)), arrow)
                    rows, size = [], 0
        if rows:
            yield arrays_to_batch(list(zip(*rows)), arrow)

    return docs.select("row", "text").join(wanted, "row").select("row", "text", "wanted").mapInArrow(run, schema)


def _by_window(texts: DataFrame, items: Items, later_only: bool) -> DataFrame:
    """The same for groups too large to hold: every window is a row of its digest and place."""
    schema = "digest binary, id long, row long, place long, at int, copies long"
    arrow = arrow_schema(texts, schema)
    width = items.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.select(["id", "row", "place", "copies", "content"]).to_pydict()
            rows = []
            for doc_id, row, place, copies, content in zip(*columns.values()):
                data, _, starts, ends = items.split(content)
                rows += [
                    (xxhash.xxh3_128_digest(data[a:b]), doc_id, row, place, at, copies)
                    for at, (a, b) in enumerate(zip(starts.tolist(), ends[width - 1 :].tolist()))
                ]
                if len(rows) > 50_000:
                    yield arrays_to_batch(list(zip(*rows)), arrow)
                    rows = []
            if rows:
                yield arrays_to_batch(list(zip(*rows)), arrow)

    windows = texts.mapInArrow(run, schema)
    order = F.struct("id", "row", (F.shiftright("place", 32) + F.col("at")).alias("start"))
    counts = windows.groupBy("digest").agg(F.sum("copies").alias("n"), F.min(order).alias("first")).where("n > 1")
    repeated = windows.join(counts, "digest").withColumn("order", order)
    repeated = repeated.where(F.col("order") != F.col("first")) if later_only else repeated.where("copies = 1")
    return repeated.select("row", "place", F.col("at").alias("a"), (F.col("at") + width).cast("int").alias("b"))


def apply_stretches(
    docs: DataFrame,
    found: DataFrame,
    items: Items,
    result: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], tuple],
    schema: str,
    carry: list[str],
) -> DataFrame:
    """The columns ``carry`` and ``result(text in normal form, starts, ends, removed)`` of every row of ``docs``.

    ``docs`` has ``row, text``.  ``removed`` is a flag for each item.
    """
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("place", "a", "b")).alias("found"))
    joined = docs.join(by_row, "row", "left").select("text", "found", *carry)
    made = StructType([joined.schema[name] for name in carry] + StructType.fromDDL(schema).fields)
    kinds = arrow_schema(docs, schema)

    def flags(n: int, stretched: list[dict]) -> np.ndarray:
        removed = np.zeros(n + 1, np.int32)
        for one in stretched:
            low = one["place"] >> 32
            removed[low + one["a"]] += 1
            removed[low + one["b"]] -= 1
        return np.cumsum(removed[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                rows = []
                for text, stretched in zip(part.column("text"), part.column("found")):
                    data, _, starts, ends = items.split((text.as_py() or "").encode())
                    rows.append(result(data, starts, ends, flags(len(starts), stretched.as_py() or [])))
                values = [pa.array(column, kind.type) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in carry), *values], names=[*carry, *kinds.names])

    return joined.mapInArrow(run, made)


def with_ids(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_id, id, row, text``: the id without nulls, and a number of the row."""
    doc_id = F.col(id_col).cast("long")
    return numbered(docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.col(text).alias("text")))


def with_whole_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``whole, id, row, text``: the same, and each row as a whole as the struct ``whole``."""
    whole = F.struct(F.lit(True).alias(PRESENT), *[F.col(f"`{name}`") for name in docs.columns])
    packed = docs.select(whole.alias("whole"))
    return numbered(
        packed.select(
            "whole", F.coalesce(F.col("whole").getField(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col("whole").getField(text).alias("text")
        )
    )


def spans(removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
