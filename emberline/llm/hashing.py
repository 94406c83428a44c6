"""Vectorised 64-bit hashes of words and of runs of items, alike on every machine."""

from __future__ import annotations

import numpy as np

from emberline.llm.common import BLANKS

_M1, _M2, _M3 = (np.uint64(value) for value in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 2**64)
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(blank) for blank in BLANKS]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _M3
    values = (values ^ (values >> np.uint64(29))) * _M1
    return values ^ (values >> np.uint64(32))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least ``size`` of each; kept between calls."""
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(1 << size.bit_length(), base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in bytes."""
    edge = np.empty(len(data) + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = _IS_BLANK[np.frombuffer(data, np.uint8)]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[0::2], turns[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a text."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[np.frombuffer(data, np.uint8)] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)), starts, ends


def run_hashes(items: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive items, put together from runs of powers of two."""
    out, done, part, size = None, 0, items, 1
    while True:
        if length & size:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                out = out[:n] * _M2 + part[done : done + n]
            done += size
        if size * 2 > length:
            return mix(out)
        part = part[: len(part) - size] * _M1 + part[size:]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
