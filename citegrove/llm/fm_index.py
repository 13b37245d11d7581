"""An FM-index of one shard of texts in numpy: wavelet-matrix ranks, backward search of many phrases at once, sampled places."""

from __future__ import annotations

import numpy as np

from citegrove.llm.suffix_order import refined


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. 0 separates texts and ends the array; separators differ from each other, in order of place."""
    n = len(symbols)
    count = np.bincount(symbols)
    rank = (np.cumsum(count) - count)[symbols]
    parted = np.flatnonzero(symbols == 0)
    rank[parted] = np.arange(len(parted))
    for rank, _ in refined(rank):  # noqa: B007, B020
        pass
    places = np.empty(n, np.int64)
    places[rank[:-1]] = np.arange(n)
    return places


class Bits:
    """Bits with their number before each place, in words of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(count) - count

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks and reads of a sequence of symbols below 2^width; one level of bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(width - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
        every = np.arange(1 << width)
        self.start = self._down(every, np.zeros(1 << width, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before place at."""
        return self._down(symbol, at) - self.start[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and their ranks there."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits[at], bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Of texts over symbols 1 to top, each between two zeros. Places are sampled at the start of each text and every `step`."""

    def __init__(self, symbols: np.ndarray, top: int, step: int = 16):
        places = suffix_array(symbols)
        last = symbols[places - 1]
        self.first = np.cumsum(np.append(0, np.bincount(symbols, minlength=top + 1)))
        self.ranks = WaveletMatrix(last, max(1, int(top).bit_length()))
        sampled = (last == 0) | (places % step == 0)
        self.sampled, self.samples = Bits(sampled), places[sampled]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that start with each phrase (a row of symbols), by backward search."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        alive = np.flatnonzero(high > low)
        low, high = low.copy(), high.copy()
        for j in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[alive, j]
            low[alive] = self.first[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.ranks.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of these suffixes: steps back through the text until a sampled one."""
        rows, places, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled[rows[left]]
            done = left[known]
            places[done] = self.samples[self.sampled.rank(rows[done])] + steps
            left = left[~known]
            symbol, rank = self.ranks.read(rows[left])
            rows[left] = self.first[symbol] + rank
            steps += 1
        return places
