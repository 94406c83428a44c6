"""Suffix order of short sequences up to a depth, by refining groups of equal prefixes."""

from __future__ import annotations

import numpy as np

# Suffixes are dropped once they depend on so few others each.
FEW_OFFSETS = 8


def suffix_order(codes: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` codes, and the common prefix with the one before.

    Equal prefixes stand in order of place.  Prefix lengths are exact from ``depth`` on and
    otherwise rounded down to the step at which the two were told apart.  The first step
    sorts by as many codes as one number holds.  Then only groups that still hold several
    suffixes are sorted again, each time to about twice the length.  Behind the end every
    code counts as least.

    With ``wanted``, a flag per place, only those suffixes are returned that share ``depth``
    codes with another one.  The rest is left unsorted as soon as no wanted suffix that
    still shares its prefix depends on it.
    """
    n = len(codes)
    common = np.zeros(n, np.int32)
    if n == 0:
        return np.zeros(0, np.int64), common
    bits = max(1, int(codes.max()).bit_length())
    length = min(depth, max(1, 62 // bits))
    packed = np.zeros(n, np.int64)
    for offset in range(length):
        packed <<= bits
        packed[: max(0, n - offset)] |= codes[offset:].astype(np.int64)
    order = np.argsort(packed)
    ordered = packed[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    open_ = order[np.repeat(sizes > 1, sizes)]
    last_step = _last_step(length, depth)
    while length < depth and len(open_):
        step = min(length, depth - length)
        if wanted is not None and 2 * length * FEW_OFFSETS >= depth:
            open_ = open_[_needed(open_[wanted[open_]], n, depth, 2 * length, last_step)[open_]]
            if not len(open_):
                break
        after = np.zeros(len(open_), np.int64)
        inside = open_ + step < n
        after[inside] = rank[open_[inside] + step] + 1
        key = (rank[open_] << 32) | after
        by = np.argsort(key)
        key, moved = key[by], open_[by]
        old = key >> 32
        new_group = np.concatenate(([True], key[1:] != key[:-1]))
        old_group = np.concatenate(([True], old[1:] != old[:-1]))
        places = np.arange(len(key))
        fresh = old + np.maximum.accumulate(np.where(new_group, places, 0)) - np.maximum.accumulate(np.where(old_group, places, 0))
        common[fresh[new_group & ~old_group]] = length
        rank[moved] = fresh
        sizes = np.diff(np.append(np.flatnonzero(new_group), len(key)))
        open_ = moved[np.repeat(sizes > 1, sizes)]
        length += step
    if wanted is not None:
        tied = open_[wanted[open_]]
        tied = tied[np.lexsort((tied, rank[tied]))]
        common = np.zeros(len(tied), np.int32)
        common[1:][rank[tied[1:]] == rank[tied[:-1]]] = depth
        return tied, common
    # A rank is the place of a group's first suffix; those of one group follow by place.
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    if len(open_):
        tied = open_[np.lexsort((open_, rank[open_]))]
        ranked = rank[tied]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        starts = np.flatnonzero(first)
        within = np.arange(len(tied)) - np.repeat(starts, np.diff(np.append(starts, len(tied))))
        order[ranked + within] = tied
        common[(ranked + within)[~first]] = depth
    return order, common


def _last_step(length: int, depth: int) -> int:
    """How far the last step looks ahead."""
    while 2 * length < depth:
        length *= 2
    return max(0, depth - length)


def _needed(starts: np.ndarray, n: int, depth: int, length: int, last_step: int) -> np.ndarray:
    """The places whose order by ``length`` codes the suffixes at ``starts`` still depend on."""
    flags = np.zeros(n, bool)
    for offset in sorted({base + far for base in (0, last_step) for far in range(0, depth, length)}):
        places = starts + offset
        flags[places[places < n]] = True
    return flags


def laid_end_to_end(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all parts with a least code after each; each place's part, and codes left in it."""
    lengths = np.array([len(part) for part in parts]) + 1
    codes = np.concatenate([piece for part in parts for piece in (part, np.zeros(1, part.dtype))])
    owner = np.repeat(np.arange(len(parts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes)) - 1
    return codes, owner, left


