"""A word-level FM-index in numpy: the Burrows-Wheeler transform in a wavelet matrix of packed bits.

Suffixes are ordered by their first symbols only, which is exact for patterns up to the window.
All searches take arrays: many patterns step through the index together.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with the number of ones before each word: one and a half bits for a bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.zeros(len(self.words), dtype=np.int32)
        self.counts[1:] = np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32)

    def before(self, places: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        at = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[at] + np.bitwise_count(self.words[at] & mask)


class FmIndex:
    """What stays of a text: its transform in a wavelet matrix, where suffixes that agree in window - 1 symbols begin, and
    a value for each suffix. The text, the order of its suffixes and their ranks are gone after the build."""

    def __init__(self, symbols: np.ndarray, window: int, values: np.ndarray):
        """symbols: integers from 0 (a separator that no pattern holds), a separator last. values: one for each of them, as of whose it is."""
        if len(symbols) and symbols[-1] != 0:
            raise ValueError("the last symbol must be a separator")
        self.n, self.window = len(symbols), window
        order, ranks = _suffixes(symbols, window)
        sigma = int(symbols.max(initial=0)) + 1
        self.symbols_before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        begins = _begins(order, ranks, window - 1)
        self.begin_bits, self.begins = Bits(begins), np.append(np.flatnonzero(begins), self.n).astype(np.int32)
        del ranks, begins
        self.values = values[order]
        self._build_wavelet(symbols[order - 1], sigma)

    def _build_wavelet(self, bwt: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[np.uint32, Bits, int]] = []
        seq = bwt.astype(np.uint32)
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = ((seq >> np.uint32(bit)) & np.uint32(1)).astype(bool)
            self.levels.append((np.uint32(bit), Bits(ones), self.n - int(ones.sum())))
            seq = np.concatenate([seq[~ones], seq[ones]])
        every = np.arange(sigma, dtype=np.uint32)
        self._start = self._down(every, np.zeros(sigma, dtype=np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.before(places)
            places = np.where((symbols >> bit) & np.uint32(1), zeros + ones, places - ones)
        return places

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that have the symbol before what [low, high) start with."""
        both = self._down(np.concatenate([symbols, symbols]).astype(np.uint32), np.concatenate([low, high]))
        shift = self.symbols_before[symbols] - self._start[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def shorten(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes that agree with the one at each place in window - 1 symbols."""
        group = self.begin_bits.before(places + 1) - 1
        return self.begins[group].astype(np.int64), self.begins[group + 1].astype(np.int64)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest value of the suffixes in each interval; intervals are equal or apart, as those of windows are."""
        first, which = np.unique(low, return_inverse=True)
        end = np.zeros(len(first), dtype=np.int64)
        end[which] = high
        padded = np.append(self.values, self.values[:1])
        return np.minimum.reduceat(padded, np.column_stack([first, end]).ravel())[::2][which] if len(first) else padded[:0]


def _suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Order of the suffixes by at least `depth` symbols, and ranks by every power of two up to it, by prefix doubling."""
    n, k = len(symbols), 1
    pad = np.zeros(2 * depth, dtype=np.int32)
    ranks = {1: np.concatenate([symbols.astype(np.int32), pad])}
    order = np.arange(n)
    while k < depth:
        r = ranks[k].astype(np.int64)
        key = r[:n] * (int(r.max(initial=0)) + 1) + r[k : k + n]
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]) if n else ordered
        k *= 2
        ranks[k] = np.concatenate([np.empty(n, dtype=np.int32), pad])
        ranks[k][order] = new
    return order, ranks


def _begins(order: np.ndarray, ranks: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Where in suffix order the first `length` symbols change."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    at, p = 0, 1 << (max(1, length).bit_length() - 1)
    while p:
        if length & p:
            r = ranks[p][order + at]
            new[1:] |= r[1:] != r[:-1]
            at += p
        p >>= 1
    return new


def match_windows(index: FmIndex, streamed: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the streamed texts match the index over at least its window of words.

    Texts end at `ends` in `streamed` and have at least so many words. From each place the matching
    statistic is followed up to the window, right to left: a match of window - 1 words is extended by the
    word before it, and then shortened at its right end. Returns for every place whose matching
    statistic reaches the window: the place in `streamed`, and the low and high end of its suffixes.
    """
    window = index.window
    order = np.argsort(-lengths, kind="stable")
    ends, lengths = ends[order], lengths[order]

    def fresh(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that start with the window - 1 words that end before `last`."""
        low, high = np.zeros(len(last), dtype=np.int64), np.full(len(last), index.n, dtype=np.int64)
        for back in range(1, window):
            low, high = index.extend(low, high, streamed[last - back])
        return low, np.maximum(low, high)

    low, high = fresh(ends)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for back in range(window, int(lengths[0]) + 1 if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -back, side="right"))
        at = ends[:live] - back
        low, high = index.extend(low[:live], high[:live], streamed[at])
        found = high > low
        out.append((at[found], low[found], high[found]))
        low, high = index.shorten(np.minimum(low, index.n - 1))
        if not found.all():  # the statistic is shorter here: search its first words anew
            low[~found], high[~found] = fresh(at[~found] + window - 1)
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([x[i] for x in out]) if out else empty for i in range(3))
