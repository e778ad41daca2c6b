"""Words of UTF-8 texts as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

# White space of the contracts: space and the control characters 9 to 13.
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def _reach(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(2 * n, 1 << 16)
        _powers, _inverses = np.full(size, _ODD, np.uint64), np.full(size, _INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverses, out=_inverses)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span, by differences of one running sum modulo 2^64."""
    _reach(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _inverses[starts])


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    gap = np.ones(len(text) + 2, bool)
    gap[1:-1] = _GAP[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    starts, ends = word_spans(text)
    return span_hashes(_BYTE_VALUES[np.frombuffer(text, np.uint8)], starts, ends)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, by its first word."""
    starts = np.arange(max(0, len(hashes) - length + 1))
    return span_hashes(hashes, starts, starts + length)
