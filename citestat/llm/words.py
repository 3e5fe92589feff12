"""Words of a whole Arrow string column at once, as numpy arrays.

A column of texts is one buffer of UTF-8 bytes, so words are found and hashed for many
texts in a few array operations. Texts are taken in runs of about `RUN_BYTES`, which bounds
the memory whatever the size of a batch; a text longer than that is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 19

#: Space and the control characters from tab to carriage return end a word.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A to Z become a to z; every other byte stays.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(n, RUN_BYTES + 1), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one map)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Run(NamedTuple):
    """Texts ``first`` .. ``first + len(bounds) - 2`` of a column; words of text i are
    ``bounds[i]:bounds[i + 1]``."""

    first: int
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        inverse = _power(_INVERSE, len(self.sums))
        return mixed((self.sums[ends] - self.sums[self.starts]) * inverse[self.starts])


def runs(texts: pa.Array) -> Iterator[Run]:
    """Lower-cased (A to Z) words of a string column, run by run. A null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        last = min(last, len(texts))
        yield _run(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _run(first: int, data: np.ndarray, offsets: np.ndarray) -> Run:
    n = len(data)
    low = FOLD[data]
    space = np.empty(n + 2, dtype=bool)
    space[0] = space[n + 1] = True
    space[1 : n + 1] = SPACES[low]
    before, after = space[:n].copy(), space[2:].copy()
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[inner] = True
    after[inner[inner > 0] - 1] = True
    word = ~space[1 : n + 1]
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    return Run(first, np.searchsorted(starts, offsets), starts, ends, sums)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each run, the sorted distinct k-word shingles of its texts as 64-bit hashes.

    A text of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    factors = [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(k)]
    for run in runs(texts):
        h = run.hashes()
        window = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            window += h[j : j + len(window)] * factors[j]
        window = mixed(window)
        sets = []
        for a, b in zip(run.bounds[:-1], run.bounds[1:], strict=True):
            if b - a >= k:
                sets.append(np.unique(window[a : b - k + 1]))
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for j in range(b - a):
                    short = mixed(short * factors[j] + h[a + j])
                sets.append(short)
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
        yield run.first, sets
