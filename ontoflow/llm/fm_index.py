"""An FM-index over integer symbols in numpy: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; symbol 0 separates, is smaller than all others, and earlier ones are smaller.

    Prefix doubling, so that long repeats cost a logarithm of their length; only places whose rank
    isn't settled are sorted again.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64)
    separators = np.flatnonzero(rank == 0)
    rank += len(separators)
    rank[separators] = np.arange(len(separators))
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order, n)
    width = 1
    while True:
        sorted_ranks = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:-1] = sorted_ranks[1:] == sorted_ranks[:-1]
        open_at = np.flatnonzero(same[:-1] | same[1:])
        if not len(open_at):
            return order
        places = order[open_at]
        ahead = np.where(places + width < n, rank[np.minimum(places + width, n - 1)] + 1, 0)
        own = rank[places]
        again = np.lexsort((places, ahead, own))
        places, own, ahead = places[again], own[again], ahead[again]
        order[open_at] = places
        # A group keeps the number of its first row; those that split off get that of theirs.
        starts = np.ones(len(places), bool)
        starts[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        first = np.maximum.accumulate(np.where(starts, open_at, 0))
        rank[places] = first
        width *= 2


def _ranks(values: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    starts = np.ones(n, bool)
    starts[1:] = values[1:] != values[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    return rank


class WaveletMatrix:
    """Rank and access on a sequence of small integers, for many places at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = (symbols >> bit & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            at = np.where(one, zeros + before[at], at - before[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for _, before, zeros in self.levels:
            one = before[at + 1] > before[at]
            out = out << 1 | one
            at = np.where(one, zeros + before[at], at - before[at])
        return out


class FMIndex:
    """Backward search and location in runs of symbols (1 and up) that zeros separate."""

    def __init__(self, symbols: np.ndarray, every: int = 16):
        n = len(symbols)
        suffixes = suffix_array(symbols)
        last = symbols[suffixes - 1]  # the row of the first suffix wraps round to the last separator
        top = int(symbols.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.wavelet = WaveletMatrix(last, top)
        #: Every 16th place and the first of each run, so that no walk crosses a separator.
        kept = (suffixes % every == 0) | (last == 0)
        self._known = np.flatnonzero(kept)
        self._sampled = kept
        self._sample_rank = np.cumsum(kept) - 1
        self._places = suffixes[self._known]
        self.size = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase; ``phrases`` is a matrix, filled at the right with zeros."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] > step)]
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - step]
            known = symbol < len(self.before) - 1
            symbol = np.where(known, symbol, 0)
            ranks = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]]))
            base = self.before[symbol]
            low[alive] = np.where(known, base + ranks[: len(alive)], 0)
            high[alive] = np.where(known, base + ranks[len(alive) :], 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix: walk back to a sampled one and count the steps."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        walking = np.flatnonzero(~self._sampled[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.wavelet.access(at)
            rows[walking] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self._sampled[rows[walking]]]
        return self._places[self._sample_rank[rows]] + steps
