"""Words of UTF-8 buffers as 64-bit names, case kept."""

from __future__ import annotations

import numpy as np

from linkloom.llm.minmax_dedup import BASE, SPACE, mixed

#: Bytes whose terms are held at a time.
STEP = 1 << 20
VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but space and control white space."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A name for each word, equal for equal words; whole words are read, a few at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, "right")))
        lengths = ends[first:last] - starts[first:last]
        begin = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(begin, lengths)
        powers = np.full(int(lengths.max()), BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        terms = VALUE[raw[within + np.repeat(starts[first:last], lengths)]] * powers[within]
        out[first:last] = mixed(np.add.reduceat(terms, begin) + lengths.astype(np.uint64))
        first = last
    return out


def window_names(names: np.ndarray, size: int) -> np.ndarray:
    """A name for each run of ``size`` words."""
    out = np.zeros(max(0, len(names) - size + 1), np.uint64)
    for i, factor in enumerate(mixed(np.arange(1, size + 1, dtype=np.uint64) * BASE) | np.uint64(1)):
        out += names[i : i + len(out)] * factor
    return mixed(out)


def in_repeated_windows(names: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a run of ``size`` words that is found twice or more."""
    grams = window_names(names, size)
    covered = np.zeros(len(names), bool)
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for i in range(size if len(twice) else 0):
        covered[twice + i] = True
    return covered
