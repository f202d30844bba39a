"""An FM-index over sequences of symbols: suffix array, wavelet matrix, sampled positions.

The indexed text is a list of runs. Symbols are 1, 2, ...; every run ends with a
separator 0. Separators are told apart by their position, so all suffixes differ.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over the ranks that still tie."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        if step > 1 or new.all():
            if new.all():
                return order
        # ranks become the place of the first suffix of a tie; ties are sorted further
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = place
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        members = order[where]
        follow = members + step
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        inner = np.lexsort((key, place[where]))
        order[where] = members[inner]
        key, place = key[inner], place[where]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        rank[order[where]] = where[np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))]
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, highest bit first."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        rest = symbols.astype(np.int64)
        for bit in reversed(range(max(1, int(rest.max(initial=0)).bit_length()))):
            ones = (rest >> bit) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(end)
        for bit, zeros_before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            lo, hi = zeros_before[start], zeros_before[end]
            start = np.where(one, zeros + start - lo, lo)
            end = np.where(one, zeros + end - hi, hi)
        return end - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix, in suffix order
        self.wavelet = WaveletMatrix(self.last)
        self.n_symbols = int(symbols.max(initial=0)) + 1
        counts = np.bincount(symbols, minlength=self.n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        # the walk backwards stops at a sampled position; run starts are always sampled
        kept = np.zeros(len(symbols), bool)
        kept[::SAMPLE_EVERY] = True
        kept[run_starts] = True
        self.sampled = kept[order]
        self.sample_place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases`` at once: their suffix ranges."""
        n, length = phrases.shape
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero((phrases < self.n_symbols).all(axis=1))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(self.last))
        for column in reversed(range(length)):
            symbol = phrases[alive, column]
            lo = self.smaller[symbol] + self.wavelet.rank(symbol, lo)
            hi = self.smaller[symbol] + self.wavelet.rank(symbol, hi)
            found = lo < hi
            alive, lo, hi = alive[found], lo[found], hi[found]
        low[alive], high[alive] = lo, hi
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the next sampled one."""
        steps = np.zeros(len(places), np.int64)
        places = places.copy()
        walking = np.flatnonzero(~self.sampled[places])
        while len(walking):
            at = places[walking]
            symbol = self.last[at]
            places[walking] = self.smaller[symbol] + self.wavelet.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.sampled[places[walking]]]
        return self.samples[self.sample_place[places]] + steps
