"""Rolling hashes, content-chosen anchors and the bundles of windows that share one.

A window is ``length`` consecutive symbols (words or bytes) of a document. Its anchor is the k-gram in
it with the smallest hash, the leftmost of equals, so equal windows have equal anchors at the same
place. A bundle is a maximal run of windows with one anchor: about one for every ``length / 2``
symbols, and copies of a long text have equal bundles all along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import WORKER_CACHES

#: Symbols that are worked on at once. A longer document is cut, with overlap; that may cut a bundle in
#: two but changes no window's anchor.
AT_ONCE = 1 << 20
_POSITION = (1 << 24) - 1
#: Odd multipliers. Fixed values.
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}
WORKER_CACHES.append(_grown.clear)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, modulo 2**64: one pair of arrays for each base, made longer when needed."""
    have = _grown.get(base)
    if have is None or len(have[0]) < n:
        up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _grown[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of any runs of an array of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: int = BASE) -> None:
        n = len(symbols)
        size = 1 << max(10, int(n + 1).bit_length())
        up, self.down = _powers(base, size)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(length) if isinstance(length, int) else (self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))


@lru_cache(maxsize=1)
def byte_symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(OTHER_BASE))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes: runs without ASCII white space."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = OTHER_BASE) -> np.ndarray:
    """A 64-bit hash for each word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    symbols = byte_symbols()
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # bounded pieces of a long text
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + AT_ONCE, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        out[at:to] = Rolling(symbols[data[lo:hi]], base).of(starts[at:to] - lo, ends[at:to] - starts[at:to])
        at = to
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` numbers."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _pieces(docs: list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Documents of at least ``length`` symbols as (document, offset, symbols), about AT_ONCE at a time."""
    group, size = [], 0
    for d, x in enumerate(docs):
        for at in range(0, len(x) - length + 1, AT_ONCE):
            part = x[at : at + AT_ONCE + length - 1]
            if size and size + len(part) > AT_ONCE:
                yield group
                group, size = [], 0
            group.append((d, at, part))
            size += len(part)
    if group:
        yield group


def bundles(docs: list[np.ndarray], length: int, k: int) -> dict[str, np.ndarray]:
    """Bundles of each document's windows: ``doc`` (index), ``lo`` and ``hi`` (first and last window's start),
    ``at`` (the anchor's place), ``anchor`` and ``content`` (hashes, signed)."""
    out: dict[str, list[np.ndarray]] = {n: [] for n in ("doc", "lo", "hi", "at", "anchor", "content")}
    for group in _pieces(docs, length):
        x = np.concatenate([p for _, _, p in group])
        x = byte_symbols()[x] if x.dtype == np.uint8 else x
        sizes = np.array([len(p) for _, _, p in group])
        begin = np.cumsum(sizes) - sizes
        roll = Rolling(x)
        grams = roll.of(np.arange(len(x) - k + 1), k)
        keys = (grams & ~np.uint64(_POSITION)) | np.arange(len(grams), dtype=np.uint64)
        anchor_at = (_sliding_min(keys, length - k + 1) & np.uint64(_POSITION)).astype(np.int64)
        inside = np.zeros(len(anchor_at) + 1, dtype=np.int64)
        inside[begin] += 1
        np.add.at(inside, np.minimum(begin + sizes - length + 1, len(anchor_at)), -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]))
        at = anchor_at[starts]
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
        last = np.concatenate((first[1:], [len(starts)])) - 1
        lo, hi, at = starts[first], starts[last], at[first]
        piece = np.searchsorted(begin, lo, side="right") - 1
        shift = np.array([o for _, o, _ in group])[piece] - begin[piece]
        content = roll.of(lo, hi - lo + length) + (at - lo).astype(np.uint64) * np.uint64(OTHER_BASE)
        for name, v in (("doc", np.array([d for d, _, _ in group])[piece]), ("lo", lo + shift), ("hi", hi + shift), ("at", at + shift), ("anchor", grams[at].view(np.int64)), ("content", content.view(np.int64))):
            out[name].append(v)
    return {n: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for n, v in out.items()}


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a span."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
