"""Best-fit packing of tokenised documents, improved by swaps.

A document's ids (and a closing id) make one piece, or several of exactly the full length
if it is longer; what is left over is then its first piece.  Full pieces are sequences of
their own.  The others are dealt by a number of their own, so equal rows too, into groups of a bounded number of pieces, and
each group is packed by itself: best fit in order of length, then local search on the
sequences that are not full.  The search moves a piece, swaps one for one, or two for one,
whenever that raises the sum of squared fills, which pushes pieces out of the emptiest
sequences until they are gone.  Every open sequence of the group and every pair of lengths
can take part, and the search ends when nothing is left that gains.  A group has thousands of pieces, so dealing costs a
fraction of a sequence per group.

The ids are those of the tokenizer file; texts are cut at single spaces, between which the
tokenizer never looks across, and the ids of each part are kept in a bounded cache.

Defined results: a null text is empty and has the closing id only; rows of equal id are
packed each; rows with a null id too; other columns are not read; an empty table gives no
sequence.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, small_batches, stored, to_batch
from emberline.llm.groups import map_groups

CAPACITY = 1_024
CLOSING_ID = 2
GROUP_PIECES = 10_000
CACHED_PARTS = 400_000
SPECIAL = {"<|endoftext|>": 50_256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

# The white space of texts besides the plain space.
OTHER_SPACES = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def may_be_cut(text: str) -> bool:
    """Whether every plain space stands between two characters that are no white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any(space in text and (f" {space}" in text or f"{space} " in text) for space in OTHER_SPACES)


class _Parts(dict):
    """Ids of what follows a space, made when first asked for."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, part: str) -> bytes:
        found = self[part] = array("I", self.encode(" " + part)).tobytes()
        return found


class Tokenizer:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.parts = _Parts(self.encoding)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not may_be_cut(text) or any(special in text for special in SPECIAL):
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        first, *rest = text.split(" ")
        return array("I", self.encoding.encode_ordinary(first)).tobytes() + b"".join(map(self.parts.__getitem__, rest))


_tokenizers: dict[tuple, Tokenizer] = {}


def tokenizer(ranks: str, pattern: str) -> Tokenizer:
    """One per worker; ``ranks`` is a path, or the name of a file of the public package."""
    if (ranks, pattern) not in _tokenizers:
        path = ranks
        if "/" not in ranks:
            import public_tokenizers

            path = public_tokenizers.path(ranks)
        _tokenizers[ranks, pattern] = Tokenizer(path, pattern)
    return _tokenizers[ranks, pattern]


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter."""
    first = (n_ids - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, n_ids, capacity))]


def token_pieces(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    with_ids: bool = False,
) -> DataFrame:
    """The columns of PIECES for every document, and the ids of each piece on demand."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    arrow = arrow_schema(docs, schema)
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks, pattern).ids
        for batch in batches:
            rows = []
            for doc_id, value in zip(*batch.columns):
                ids = encode(value.as_py() or "") + closing
                for place, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    values = (doc_id.as_py(), place, start, length, zlib.crc32(own))
                    rows.append((*values, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else values)
                if len(rows) >= (1_000 if with_ids else 20_000):
                    yield to_batch(rows, arrow)
                    rows = []
            if rows:
                yield to_batch(rows, arrow)

    return small_batches(docs.select(F.col(id_col).cast("long"), F.col(text))).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths``: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for place in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[place], -1))
        if at == len(room):
            left, number = capacity, len(bins)
            bins.append([])
        else:
            left, number = room.pop(at)
        bins[number].append(place)
        if left > lengths[place]:
            insort(room, (left - lengths[place], number))
    return bins


class _Open:
    """Bins that are not full, indexed by their room and the lengths of their pieces.

    ``masks[room]`` has bit ``room + length`` set for each length of a piece in any bin of
    that room, and bit ``room``: what can be given to a bin of that room if that piece, or
    none, comes back for it.  Bins of equal lengths share their entries.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.masks: dict[int, int] = {}
        self.bins: dict[int, dict[int, dict[int, None]]] = {}

    def add(self, number: int, own: dict[int, list[int]], room: int) -> None:
        at = self.bins.setdefault(room, {})
        mask = self.masks.get(room, 0)
        for back in (0, *own):
            at.setdefault(back, {})[number] = None
            mask |= 1 << (room + back)
        self.masks[room] = mask

    def remove(self, number: int, own: dict[int, list[int]], room: int) -> None:
        at = self.bins[room]
        for back in (0, *own):
            del at[back][number]
            if not at[back]:
                del at[back]
                self.masks[room] &= ~(1 << (room + back))
        if not at:
            del self.bins[room], self.masks[room]

    def best_step(self, sums: int, least: int) -> tuple[int, int, int, int] | None:
        """Rest, room, size to give and size to take back of the step that leaves the least room.

        ``sums`` has a bit for each size that can be given; bins with more room than
        ``least`` are emptier than the one that gives.
        """
        rooms = sorted(room for room in self.masks if room <= least)
        if not rooms:
            return None
        # A step that leaves the rest r gains room - r, so only bins with more room count.
        unions, together = [0] * len(rooms), 0
        for i in range(len(rooms) - 1, -1, -1):
            together |= self.masks[rooms[i]]
            unions[i] = together
        first = 0
        for rest in range(rooms[-1]):
            while rooms[first] <= rest:
                first += 1
            if sums & (unions[first] >> rest):
                for room in rooms[first:]:
                    both = sums & (self.masks[room] >> rest)
                    if both:
                        size = (both & -both).bit_length() - 1
                        return rest, room, size, size + rest - room
        return None


def _sums(own: dict[int, list[int]]) -> tuple[int, int]:
    """A bit for each length, and for each length or sum of two pieces."""
    single = 0
    for length in own:
        single |= 1 << length
    sums = single
    for length, places in own.items():
        sums |= (single if len(places) > 1 else single & ~(1 << length)) << length
    return single, sums


def _take(own: dict[int, list[int]], length: int) -> int:
    place = own[length].pop()
    if not own[length]:
        del own[length]
    return place


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and swaps between underfull bins; drop empty ones.

    Each step takes a bin, the emptiest first, and changes it against a bin at least as
    full so that the fuller one gains: a piece moves over, a longer piece is given for a
    shorter one, or two pieces are given for one shorter than both together.  Of all such
    changes the one that leaves the least room is taken, looked up by room and lengths.
    The search ends when no bin has a change left; each raises the sum, so it does end.
    """
    done, open_bins, fill = [], {}, {}
    index = _Open(capacity)
    for number, places in enumerate(bins):
        total = sum(lengths[i] for i in places)
        if total == capacity:
            done.append(places)
            continue
        own: dict[int, list[int]] = {}
        for i in places:
            own.setdefault(lengths[i], []).append(i)
        open_bins[number], fill[number] = own, total
        index.add(number, own, capacity - total)
    changed = True
    # Bins of equal lengths have equal changes: one that has none is asked once until something moves.
    hopeless: set[tuple] = set()
    while changed:
        changed = False
        for low in sorted(open_bins, key=lambda n: (fill[n], n)):
            if low not in open_bins:
                continue
            own = open_bins[low]
            kind = tuple(sorted((length, len(places)) for length, places in own.items()))
            if kind in hopeless:
                continue
            index.remove(low, own, capacity - fill[low])
            moved = False
            while own:
                single, sums = _sums(own)
                step = index.best_step(sums, capacity - fill[low])
                if step is None:
                    break
                rest, room, size, back = step
                moved = True
                high = next(iter(index.bins[room][back]))
                other = open_bins[high]
                index.remove(high, other, room)
                if single >> size & 1:
                    given = [_take(own, size)]
                else:
                    half = next(a for a in own if size - a in own and (size != 2 * a or len(own[a]) > 1))
                    given = [_take(own, half), _take(own, size - half)]
                if back:
                    own.setdefault(back, []).append(_take(other, back))
                for i in given:
                    other.setdefault(lengths[i], []).append(i)
                fill[low] -= size - back
                fill[high] = capacity - rest
                if rest:
                    index.add(high, other, rest)
                else:
                    done.append([i for places in open_bins.pop(high).values() for i in places])
            if moved:
                changed = True
                hopeless.clear()
            else:
                hopeless.add(kind)
            if own:
                index.add(low, own, capacity - fill[low])
            else:
                del open_bins[low]
    return done + [[i for places in own.values() for i in places] for own in open_bins.values()]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The columns of PACKED for the rows of ``pieces`` (PIECES).

    A group number takes the upper bits of a sequence's id, its place in the group the lower.
    """
    # Numbered as it is written, so that the number of a row stays the same.
    columns = [name.split()[0] for name in PIECES.split(", ")]
    pieces = stored(pieces.select(*columns, F.monotonically_increasing_id().alias("number")), "token-pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    dealt = pieces.withColumn("deal", F.xxhash64("number")).withColumn("group", F.pmod(F.shiftrightunsigned("deal", 8), F.lit(groups)))
    arrow = arrow_schema(pieces, PACKED)

    def work(rows: pa.Table) -> pa.RecordBatch:
        made = []
        columns = rows.select([field.name for field in arrow][:5] + ["group"]).to_pydict()
        values = list(zip(*columns.values()))
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and values[end][5] == values[at][5]:
                end += 1
            group = values[at:end]
            bins = pack_lengths([row[3] for row in group], capacity)
            for number, places in enumerate(bins):
                offset = 0
                for place in places:
                    row = group[place]
                    made.append((*row[:5], (row[5] << 32) + number, offset))
                    offset += row[3]
            at = end
        return to_batch(made, arrow)

    packed = map_groups(dealt.where(F.col("length") < capacity).drop("deal", "number"), ["group"], ["doc_id", "piece", "length", "ids_crc32"], work, PACKED)
    alone = dealt.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(alone)


def packed_documents(docs: DataFrame, ranks: str, pattern: str, **settings) -> DataFrame:
    """Tokenise, cut and pack every row of ``docs``."""
    return pack(token_pieces(docs, ranks, pattern, **settings), settings.get("capacity", CAPACITY))
