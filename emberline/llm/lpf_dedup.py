"""Substring deduplication by longest-previous-factor arrays.

The segments of text that may repeat (see ``repeats``) are laid end to end in the order of
the corpus, and their suffixes are sorted.  For a suffix, the nearest suffixes before and
after it in that order which start earlier in the text are the ones with which it can have
the longest earlier match; the length of that match is its longest previous factor.  A place
whose factor reaches ``width`` bytes starts a copy of earlier text.  The same array over the
reversed order of places tells which places have a later copy.

``keep="first"`` removes later copies only, ``keep="none"`` every byte of a repeated string.

Defined results: strings are judged on the texts as given, as UTF-8 bytes; overlaps count; a
match never crosses documents; a null text is empty.  Every row is a document of its own;
the corpus is in the order of ids (null first), rows of one id in the order in which they are
read.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.hashing import BYTE_VALUES
from emberline.llm.repeats import Items, Piece, apply_stretches, repeated_stretches, spans, with_ids, with_whole_rows
from emberline.llm.suffixes import laid_end_to_end, suffix_order

WIDTH = 400
GRAM = 48
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def split_bytes(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    places = np.arange(len(data) + 1)
    return data, BYTE_VALUES[np.frombuffer(data, np.uint8)], places[:-1], places[1:]


def byte_codes(contents: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(content, np.uint8).astype(np.uint16) + np.uint16(1) for content in contents]


def byte_items(width: int = WIDTH, gram: int = GRAM, batch_bytes: int = 1 << 18, group_items: int = 4 << 20) -> Items:
    return Items(width, min(gram, width), split_bytes, byte_codes, batch_bytes, group_items)


def nearest_smaller(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the last one before it with a smaller place, and their common prefix.

    All suffixes look back at once: who points at a greater place goes on to where that one
    points, taking the lesser of the common prefixes along.  ``-1`` if there is none.
    """
    n = len(places)
    previous, shared = np.arange(n) - 1, common.astype(np.int64)
    active = np.flatnonzero(previous >= 0)
    active = active[places[previous[active]] > places[active]]
    while len(active):
        through = previous[active]
        shared[active] = np.minimum(shared[active], shared[through])
        previous[active] = previous[through]
        active = active[previous[active] >= 0]
        active = active[places[previous[active]] > places[active]]
    shared[previous < 0] = 0
    return previous, shared


def longest_previous_factor(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest common prefix of each suffix in order with one of a smaller place."""
    _, before = nearest_smaller(places, common)
    # The other way round, the common prefix belongs to the suffix behind.
    _, after = nearest_smaller(places[::-1], np.append(common[1:], 0)[::-1])
    return np.maximum(before, after[::-1])


def repeated_windows(pieces: list[Piece], width: int, later_only: bool) -> list[np.ndarray]:
    """The windows of each piece that occur elsewhere in the pieces, or only those that occur earlier."""
    by_place = sorted(range(len(pieces)), key=lambda i: pieces[i].order)
    codes, owner, left = laid_end_to_end([pieces[i].codes for i in by_place])
    # A factor of the width lies within a stretch of the order in which all share so much.
    order, common = suffix_order(codes, width, left >= width)
    factor = longest_previous_factor(order, common)
    if not later_only:
        factor = np.maximum(factor, longest_previous_factor(-order, common))
    matched = np.zeros(len(codes), bool)
    matched[order[factor >= width]] = True
    hits = np.flatnonzero(matched)
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    cuts = np.searchsorted(hits, np.append(firsts, len(codes)))
    for rank, i in enumerate(by_place):
        out[i] = hits[cuts[rank] : cuts[rank + 1]] - firsts[rank]
    return out


def _digest(data: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> tuple:
    a, b = spans(removed)
    digest, at = hashlib.sha256(), 0
    for low, high in zip(a.tolist(), b.tolist()):
        digest.update(data[at:low])
        at = high
    digest.update(data[at:])
    return len(data), int(removed.sum()), len(a), digest.hexdigest()


def _kept_text(data: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> tuple:
    # A character cut in two is lost as a whole.
    return _digest(data, starts, ends, removed) + (np.frombuffer(data, np.uint8)[~removed].tobytes().decode(errors="ignore"),)


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "first", items: Items | None = None
) -> DataFrame:
    """``doc_id`` and RESULT for every row of ``docs``."""
    items = items or byte_items()
    rows = with_ids(docs, id_col, text)
    found = repeated_stretches(rows, items, repeated_windows, later_only=keep == "first")
    return apply_stretches(rows, found, items, _digest, RESULT, ["doc_id"])


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = None, keep: str = "first", items: Items | None = None
) -> DataFrame:
    """``docs`` without the repeated strings; rows that lose all they have go.

    ``n_chars`` names a column that is to hold the length of the text that is left.
    """
    items = items or byte_items()
    rows = with_whole_rows(docs, id_col, text)
    found = repeated_stretches(rows.select("id", "row", "text"), items, repeated_windows, later_only=keep == "first")
    kept = apply_stretches(rows, found, items, _kept_text, f"{RESULT}, kept_text string", ["whole"])
    kept = kept.where("n_removed = 0 OR n_removed < n_bytes")
    left = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("whole").getField(text))
    replaced = {text: left} | ({n_chars: F.length(left).cast(docs.schema[n_chars].dataType)} if n_chars else {})
    return kept.select([replaced.get(name, F.col("whole").getField(name)).alias(name) for name in docs.columns])
