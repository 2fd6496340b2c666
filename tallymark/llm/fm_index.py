"""A compressed index of word sequences: Burrows-Wheeler transform, wavelet matrix, backward search.

Suffixes are sorted by their first ``depth`` words only, which is all that matches of at most so many words need. Kept are
the transform as bits of a wavelet matrix with counts every 64 bits, the words' first ranks, and the ranks at which the
first words change, for the lengths to which matches are cut; neither the text nor, once compressed, its suffix array. All searches are made for many sequences at
once, in numpy.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits with rank: how many ones are before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.pad(packed, (0, 8 + -len(packed) % 8)).tobytes(), dtype="<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """rank(symbol, place): how often the symbol occurs before the place."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.levels, self.shifts = [], list(range(max(1, (kinds - 1).bit_length()) - 1, -1, -1))
        for s in self.shifts:
            one = (symbols >> s & 1).astype(bool)
            self.levels.append(Bits(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        each = np.arange(kinds)
        self.starts = np.zeros(kinds, dtype=np.int64)
        self.starts = self._down(each, self.starts)  # where each symbol's block begins in the last level

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for s, bits in zip(self.shifts, self.levels, strict=True):
            r = bits.rank(at)
            at = np.where(symbol >> s & 1, bits.zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.starts[symbol]


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The places of a text of small numbers in the order of the ``depth`` words from there on, what is past the end being
    least; where the order says something new; and each place's rank by 1, 2, 4, ... words. A last overlapping step makes up
    the depth."""
    n, most = len(text), int(text.max(initial=0))
    rank, done, ranks = text + 1, 1, []
    order = np.argsort(rank)
    new = np.r_[True, rank[order][1:] != rank[order][:-1]]
    while True:
        ranks.append(rank)
        if done == depth:
            return order, new, ranks
        step = min(done, depth - done)
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (max(most, n) + 2) + after
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        done += step


class FMIndex:
    """Of sequences of word numbers (1 and up, without large gaps), laid one after the other with a 0 after each."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.depth, self.n = depth, len(text)
        order, self.new, self._ranks = suffix_ranks(text, depth)
        self.order = order
        counts = np.bincount(text)
        self.wavelet = WaveletMatrix(text[order - 1], len(counts))
        self.first = np.r_[0, np.cumsum(counts)]
        self._cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cuts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranks at which the first ``length`` words change, and the end; and each rank's number among these."""
        if length not in self._cuts:
            new = self.new if length == self.depth else self._changes(length)
            self._cuts[length] = np.r_[np.flatnonzero(new), self.n], np.cumsum(new, dtype=np.int32) - 1
        return self._cuts[length]

    def _changes(self, length: int) -> np.ndarray:
        """By two overlapping ranks of a power of two of words."""
        power = length.bit_length() - 1
        rank, shift = self._ranks[power], length - (1 << power)
        later = np.r_[rank, np.zeros(shift, dtype=np.int64)][self.order + shift]
        rank = rank[self.order]
        return np.r_[True, (rank[1:] != rank[:-1]) | (later[1:] != later[:-1])]

    def group(self, rank: np.ndarray) -> np.ndarray:
        """The number of the group of suffixes that agree in ``depth`` words."""
        return self.cuts(self.depth)[1][rank]

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each group, the least of the values that the places of the text have."""
        return np.minimum.reduceat(values[self.order], self.cuts(self.depth)[0][:-1])

    def compress(self, *lengths: int) -> None:
        """Leaves the suffix array and the ranks of its making; matches can then be cut to these lengths only."""
        for k in lengths:
            self.cuts(k)
        del self.order, self._ranks

    def widen(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first ``length`` words at the ranks ``low``: the match loses words at its right end."""
        if length == 0:
            return np.zeros_like(low), np.full_like(low, self.n)
        cuts, number = self.cuts(length)
        at = number[low]
        return cuts[at], cuts[at + 1]

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval with the word before it."""
        known = word < len(self.first) - 1
        w = np.where(known, word, 0)
        base = self.first[w]
        lo, hi = base + self.wavelet.rank(w, low), base + self.wavelet.rank(w, high)
        return lo, np.where(known, hi, lo)

    def matching_statistics(self, streams: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of every stream: how many words from there on (at most ``depth``) occur in the text, and the
        least rank of a suffix that has them. Streams are rows of word numbers, aligned at the right; all take a step to
        the left at a time. Where a match can't be extended it loses words at its right end until it can."""
        rows, width = streams.shape
        found, ranks = np.zeros((rows, width), dtype=np.int8), np.zeros((rows, width), dtype=np.int64)
        low, high, held = np.zeros(rows, dtype=np.int64), np.full(rows, self.n, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        for at in range(width - 1, -1, -1):
            open_ = np.flatnonzero(lengths >= width - at)
            full = open_[held[open_] == self.depth]
            if len(full):
                held[full] -= 1
                low[full], high[full] = self.widen(low[full], self.depth - 1)
            while len(open_):
                lo, hi = self.step(streams[open_, at], low[open_], high[open_])
                good = hi > lo
                done = open_[good]
                low[done], high[done] = lo[good], hi[good]
                held[done] += 1
                open_ = open_[~good]
                open_ = open_[held[open_] > 0]  # the empty match fails for a word that the text lacks: nothing is held
                held[open_] -= 1
                for k in np.unique(held[open_]):
                    some = open_[held[open_] == k]
                    low[some], high[some] = self.widen(low[some], int(k))
            found[:, at], ranks[:, at] = held, low
        return found, ranks
