"""Substring deduplication by suffix trees of groups of suffixes with a common prefix.

The words of all texts are cut into groups of suffixes that fit memory: by a prefix of
``GRAM`` words, their anchor (see ``repeats``), and where that leaves too many together by
prefixes of the whole window.  The suffixes of a group make a subtree: sorted, with the
common prefix of neighbours, an inner node is a stretch of the order whose common prefixes
reach its depth.  Nodes of ``width`` words and more are repeats, their leaves the places
where they occur.

``keep="first"`` removes the later occurrences only, ``keep="none"`` all of them.

Defined results: as in ``lpf_dedup``, with words in place of bytes: windows are judged on
the words as given, never cross documents, and what separates words does not matter; kept
words are joined by one space if any was removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.hashing import word_hashes
from emberline.llm.repeats import Items, Piece, apply_stretches, repeated_stretches, spans, with_ids, with_whole_rows
from emberline.llm.suffixes import laid_end_to_end, suffix_order

WIDTH = 35
GRAM = 8
RESULT = "n_words long, n_removed long, kept_sha256 string, n_spans long"


def split_words(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    joined = b" ".join(data.split())
    return (joined, *word_hashes(joined))


def word_codes(contents: list[bytes]) -> list[np.ndarray]:
    """Words by their rank among all words of the contents, from 1."""
    words = [content.split() for content in contents]
    ranks = {word: rank for rank, word in enumerate(sorted(set().union(*words)), 1)}
    return [np.fromiter(map(ranks.__getitem__, some), np.int64, len(some)) for some in words]


def word_items(width: int = WIDTH, gram: int = GRAM, batch_bytes: int = 4 << 20, group_items: int = 2 << 20) -> Items:
    return Items(width, min(gram, width), split_words, word_codes, batch_bytes, group_items)


def deep_nodes(common: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """The topmost inner nodes of at least ``depth``: first and last leaf in suffix order."""
    deep = np.concatenate(([False], common[1:] >= depth, [False]))
    edge = np.diff(deep.astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def maximal_repeats(codes: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The places of each repeat of ``depth`` codes, in order; one array per deep node.

    Only ``wanted`` places count, if given.
    """
    order, common = suffix_order(codes, depth, wanted)
    return [order[first : last + 1] for first, last in deep_nodes(common, depth)]


def repeated_windows(pieces: list[Piece], width: int, later_only: bool) -> list[np.ndarray]:
    """The windows of each piece that occur elsewhere in the pieces, or only those that occur earlier."""
    by_place = sorted(range(len(pieces)), key=lambda i: pieces[i].order)
    codes, owner, left = laid_end_to_end([pieces[i].codes for i in by_place])
    matched = np.zeros(len(codes), bool)
    for leaves in maximal_repeats(codes, width, left >= width):
        # Leaves of a node stand in order of place: the first is the first occurrence.
        matched[leaves[1:] if later_only else leaves] = True
    hits = np.flatnonzero(matched)
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    cuts = np.searchsorted(hits, np.append(firsts, len(codes)))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    for rank, i in enumerate(by_place):
        out[i] = hits[cuts[rank] : cuts[rank + 1]] - firsts[rank]
    return out


def _kept_words(data: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> bytes:
    a, b = spans(~removed)
    return b" ".join(data[starts[low] : ends[high - 1]] for low, high in zip(a.tolist(), b.tolist()))


def _digest(data: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> tuple:
    kept = _kept_words(data, starts, ends, removed)
    return len(starts), int(removed.sum()), hashlib.sha256(kept).hexdigest(), len(spans(removed)[0])


def _with_kept(data: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> tuple:
    return _digest(data, starts, ends, removed) + (_kept_words(data, starts, ends, removed).decode(),)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "first", items: Items | None = None
) -> DataFrame:
    """``doc_id`` and RESULT for every row of ``docs``."""
    items = items or word_items()
    rows = with_ids(docs, id_col, text)
    found = repeated_stretches(rows, items, repeated_windows, later_only=keep == "first")
    return apply_stretches(rows, found, items, _digest, RESULT, ["doc_id"])


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = None, keep: str = "first", items: Items | None = None
) -> DataFrame:
    """``docs`` without the repeated passages; rows that lose all they have go.

    ``n_chars`` names a column that is to hold the length of the text that is left.
    """
    items = items or word_items()
    rows = with_whole_rows(docs, id_col, text)
    found = repeated_stretches(rows.select("id", "row", "text"), items, repeated_windows, later_only=keep == "first")
    kept = apply_stretches(rows, found, items, _with_kept, f"{RESULT}, kept_text string", ["whole"])
    kept = kept.where("n_removed = 0 OR n_removed < n_words")
    left = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("whole").getField(text))
    replaced = {text: left} | ({n_chars: F.length(left).cast(docs.schema[n_chars].dataType)} if n_chars else {})
    return kept.select([replaced.get(name, F.col("whole").getField(name)).alias(name) for name in docs.columns])
