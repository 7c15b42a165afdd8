"""Suffix arrays by induced sorting, and which places of a text have a long common prefix elsewhere."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol, a unique least one, counts so."""
    last = np.concatenate((np.flatnonzero(t[1:] != t[:-1]), [len(t) - 1]))  # of each run of equal symbols
    small = np.ones(len(last), dtype=bool)
    small[:-1] = t[last[:-1]] < t[last[:-1] + 1]
    return np.repeat(small, np.diff(last, prepend=-1))


class _Buckets:
    def __init__(self, t: np.ndarray, small: np.ndarray) -> None:
        self.t, self.small, self.sigma = t, small, int(t.max()) + 1
        self.count = np.bincount(t, minlength=self.sigma)
        self.head = np.cumsum(self.count) - self.count
        self.used = np.flatnonzero(self.count)

    def _put(self, sa: np.ndarray, wave: np.ndarray, small: bool, place: np.ndarray, step: int) -> None:
        """Put the predecessors of ``wave`` that have the asked type at the next places of their buckets."""
        pred = wave[wave > 0] - 1
        pred = pred[self.small[pred] == small]
        if len(pred):
            chars = self.t[pred]
            order = np.argsort(chars, kind="stable")
            by, n_of = chars[order], np.bincount(chars, minlength=self.sigma)
            within = np.arange(len(by)) - (np.cumsum(n_of) - n_of)[by]
            sa[place[by] + step * within] = pred[order]
            place += step * n_of

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """Order of all suffixes from the order of ``lms``, the leftmost smaller ones. Larger suffixes are
        induced from left to right, then smaller ones from right to left. A bucket is handled at
        once; suffixes that fall into the bucket at hand make the next wave."""
        sa = np.full(len(self.t), -1, dtype=np.int64)
        chars = self.t[lms]
        n_of = np.bincount(chars, minlength=self.sigma)
        start = np.cumsum(n_of) - n_of
        grouped = lms[np.argsort(chars, kind="stable")]
        place = self.head.copy()
        for c in self.used:
            done = self.head[c]
            while done < place[c]:
                wave, done = sa[done : place[c]].copy(), place[c]
                self._put(sa, wave, False, place, 1)
            self._put(sa, grouped[start[c] : start[c] + n_of[c]], False, place, 1)
        larger_end = place
        place = self.head + self.count - 1
        for c in self.used[::-1]:
            done = self.head[c] + self.count[c] - 1
            while done > place[c]:
                wave, done = sa[place[c] + 1 : done + 1][::-1].copy(), place[c]
                self._put(sa, wave, True, place, -1)
            self._put(sa, sa[self.head[c] : larger_end[c]][::-1], True, place, -1)
        sa[0] = len(self.t) - 1
        return sa


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost smaller suffixes; ``ordered`` has them in order."""
    following = np.empty(len(t), dtype=np.int64)
    following[lms] = np.append(lms[1:], len(t) - 1)
    size = following[ordered] - ordered + 1
    a, b = ordered[:-1], ordered[1:]
    same = size[:-1] == size[1:]
    live, k = np.flatnonzero(same), 0
    while len(live):
        differ = t[a[live] + k] != t[b[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ]
        live = live[size[live] > k]
    return np.concatenate(([0], np.cumsum(~same)))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (small integers from 1 on) in the order of their first ``depth`` symbols.

    Suffixes are classified as smaller or larger than the next; the substrings between leftmost smaller
    ones are sorted by induction and named; where names repeat, the named string is sorted by doubling
    up to ``depth`` (a name covers two symbols at least); the whole array is induced from that.
    The least suffix, of the sentinel that is added, is left out.
    """
    t = np.append(text, 0).astype(np.int64 if int(text.max(initial=0)) > 65_535 else np.uint16)
    small = _types(t)
    lms = np.flatnonzero(small & ~np.concatenate(([True], small[:-1])))
    if len(t) == 1:
        return np.zeros(0, dtype=np.int64)
    buckets = _Buckets(t, small)
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    first = buckets.induce(lms)
    ordered = first[is_lms[first]]
    names = _names(t, lms, ordered)
    if names[-1] + 1 < len(ordered):
        rank = np.empty(len(t), dtype=np.int64)
        rank[ordered] = names
        rank = rank[lms]
        h = 1
        while h * 2 < 2 * depth and rank.max() + 1 < len(rank):
            after = np.zeros_like(rank)
            after[:-h or None] = rank[h:] + 1 if h < len(rank) else 0
            rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
            h *= 2
        ordered = lms[np.argsort(rank, kind="stable")]
    return buckets.induce(ordered)[1:]


#: Every so many places a common prefix is measured from its start; in between, from what the last one leaves.
SAMPLE = 32


def _extend(t: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Common prefixes of the suffixes at ``a`` and ``b``, of which ``known`` symbols agree; counted up to ``most``. Four symbols
    are compared at once, and pairs drop out where they differ."""
    padded = np.concatenate((t, np.arange(2, 6, dtype=np.uint16)))
    words = np.ndarray((len(padded) - 3,), dtype="<u8", buffer=padded.data, strides=(2,))
    most = np.minimum(most, len(t) - np.maximum(a, b))
    out = np.minimum(known, most)
    live = np.flatnonzero(out < most)
    last = len(t) - 1
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) <= last
        differ = np.where(inside, words[np.minimum(x, last)] ^ words[np.minimum(y, last)], np.uint64(1))
        equal = np.where(differ == 0, 4, np.where(differ & np.uint64(0xFFFF), 0, np.where(differ & np.uint64(0xFFFF0000), 1, np.where(differ & np.uint64(0xFFFF00000000), 2, 3))))
        out[live] += equal
        live = live[(equal == 4) & (out[live] < most[live])]
    return np.minimum(out, most)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``t``: the suffix before its own in ``sa`` (-1 for the first), and how long a prefix both share, in the
    order of places and not of suffixes. A place has at most one symbol less in common than the place before it, so prefixes are measured
    in full at each SAMPLE-th place only; others begin with what is left of it. Counted up to ``length``."""
    before = np.full(len(t), -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(len(t), dtype=np.int64)
    some = np.arange(0, len(t), SAMPLE)
    some = some[before[some] >= 0]
    full = np.zeros(len(t), dtype=np.int64)
    full[some] = _extend(t, some, before[some], np.zeros(len(some), dtype=np.int64), length + SAMPLE)
    place = np.flatnonzero(before >= 0)
    known = np.maximum(0, full[place // SAMPLE * SAMPLE] - place % SAMPLE)
    shared[place] = _extend(t, place, before[place], known, length)
    return before, shared


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which starts of its ``length``-byte strings are of strings that start elsewhere, too."""
    lengths = np.array([len(x) for x in texts])
    begin = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    t = data.astype(np.uint16) + 2
    t[begin + lengths] = 1
    valid = np.zeros(len(data) + 1, dtype=np.int64)
    long = lengths >= length
    valid[begin[long]] += 1
    np.add.at(valid, begin[long] + lengths[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    before, shared = permuted_common_prefixes(t, suffix_array(t, length), length)
    flags = np.zeros(len(t), dtype=bool)
    found = np.flatnonzero((shared >= length) & valid)
    flags[found] = flags[before[found]] = True
    return [flags[s : s + max(0, n - length + 1)] for s, n in zip(begin, lengths, strict=True)]
