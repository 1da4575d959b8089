"""A compressed full-text index over word sequences: BWT, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bitmap a level, with a directory of the ones before each word."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, s = [], symbols
        for level in reversed(range(self.depth)):
            bit = (s >> level & 1).astype(bool)
            padded = np.zeros(len(s) // 64 * 64 + 64, np.uint8)
            padded[: len(s)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((level, words, np.cumsum(ones) - ones, int((~bit).sum())))
            s = np.concatenate([s[~bit], s[bit]])
        self.base = self.walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, directory, zeros in self.levels:
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = directory[block] + np.bitwise_count(words[block] & below)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.walk(symbols, at) - self.base[symbols]


class FmIndex:
    """Index of one shard's word sequence, which begins and ends with the separator 0.

    Suffixes are ordered by their first ``order`` words, which is all that
    matches of up to that length need. ``common`` has the words, up to
    ``order``, that a suffix begins with like the one before it.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, order: int = 32) -> None:
        n = len(symbols)
        rank, length = symbols.astype(np.int64), 1
        while length < order:
            step = min(length, order - length)  # the last two halves may overlap
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:] + 1
            _, rank = np.unique(rank * (n + sigma + 2) + later, return_inverse=True)
            length += step
        self.order = order
        self.suffixes = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(symbols[self.suffixes - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.common = self._common(symbols)
        self.borders: dict[int, np.ndarray] = {}

    def _common(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        common = np.zeros(n, np.int64)
        alike = np.arange(1, n)
        for t in range(self.order):
            one, two = self.suffixes[alike] + t, self.suffixes[alike - 1] + t
            inside = np.maximum(one, two) < n
            alike = alike[inside][symbols[one[inside]] == symbols[two[inside]]]
            common[alike] += 1
        return common

    def shorter(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that begin with the same ``length`` words as the suffix at each place."""
        if length not in self.borders:
            self.borders[length] = np.append(np.flatnonzero(self.common < length), len(self.common))
        borders = self.borders[length]
        which = np.searchsorted(borders, at, "right")
        return borders[which - 1], borders[which]

    def extended(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals with a word put before what they match."""
        return self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)

    def search(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern ``symbols[start : start + length]``, by backward search."""
        c = symbols[starts + length - 1]
        lo, hi = self.before[c], self.before[c + 1]
        for j in range(length - 2, -1, -1):
            lo, hi = self.extended(symbols[starts + j], lo, hi)
        return lo, hi

    def statistics(
        self, symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray, most: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed passages ``symbols[begin : begin + length]``: (matched, lo, hi) at each place.

        ``matched`` is how many words from that place on occur together in the
        index, at most ``most`` and not beyond the passage, and lo, hi the
        suffix interval of these. All passages are read from their ends at
        once. A word is put before the match; where that occurs nowhere, or the
        match has ``most`` words, the match first gives up words at its end.
        Symbols that the index lacks are given as ``len(before) - 1`` or more.
        """
        matched, low, high = (np.zeros(len(symbols), np.int64) for _ in range(3))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        length = np.zeros(len(begins), np.int64)
        lo, hi = np.zeros(len(begins), np.int64), np.full(len(begins), len(self.suffixes))
        for step in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -step, "left"))  # those with a word left
            at = begins[:m] + lengths[:m] - 1 - step
            c = symbols[at]
            known = c < len(self.before) - 1
            full = np.flatnonzero(length[:m] == most)
            lo[full], hi[full] = self.shorter(lo[full], most - 1)
            length[full] = most - 1
            length[:m][~known], lo[:m][~known], hi[:m][~known] = 0, 0, len(self.suffixes)
            left = np.flatnonzero(known)
            while len(left):
                a, b = self.extended(c[left], lo[left], hi[left])
                found = a < b
                done = left[found]
                lo[done], hi[done] = a[found], b[found]
                length[done] += 1
                left = left[~found]
                left = left[length[left] > 0]
                # to the next shorter match that more suffixes have: no other can be followed by more words
                less = np.maximum(self.common[lo[left]], np.append(self.common, 0)[hi[left]])
                less = np.minimum(less, length[left] - 1)
                for short in np.unique(less):
                    of = left[less == short]
                    lo[of], hi[of] = self.shorter(lo[of], short) if short else (0, len(self.suffixes))
                    length[of] = short
            matched[at], low[at], high[at] = length[:m], lo[:m], hi[:m]
        return matched, low, high
