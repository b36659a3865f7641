"""FM-index over integer sequences: suffix array, wavelet matrix, backward search, sampled positions. All in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. The text must end with a symbol less than all others, found only there.

    A suffix's rank is the place of its group, so groups of one suffix are final and only the others are sorted again.
    The first sort takes as many symbols as fit in 62 bits.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, min(62 // bits, n))
    key = text.astype(np.int64)
    for k in range(1, width):
        key = key << bits
        key[: n - k] |= text[k:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_places = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_places):
        mine = order[open_places]
        behind = np.minimum(mine + width, n - 1)  # the last suffix is the least and alone
        key = rank[mine] * (n + 1) + np.where(mine + width < n, rank[behind] + 1, 0)
        sort = np.argsort(key, kind="stable")
        mine, k = mine[sort], key[sort]
        order[open_places] = mine
        new = np.append(True, k[1:] != k[:-1])
        rank[mine] = np.maximum.accumulate(np.where(new, open_places, 0))
        open_places = open_places[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class WaveletMatrix:
    """Rank over a sequence of small integers, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[np.ndarray] = []
        now = symbols.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            one = (now >> b) & 1
            self.zeros.append(np.append(0, np.cumsum(1 - one)).astype(np.int32))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position `end`."""
        begin = np.zeros_like(end)
        for level, zeros in enumerate(self.zeros):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            total = int(zeros[-1])
            zb, ze = zeros[begin].astype(np.int64), zeros[end].astype(np.int64)
            begin, end = np.where(one, total + begin - zb, zb), np.where(one, total + end - ze, ze)
        return end - begin


class FMIndex:
    """Index of a text of symbols 1 .. alphabet - 1; symbol 0 ends it."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 16):
        text = np.append(text, 0).astype(np.int64)
        self.n, self.sample = len(text), sample
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=alphabet)))
        self.ranks = WaveletMatrix(self.bwt, max(1, int(alphabet - 1).bit_length()))
        self.sampled = sa % sample == 0
        self.sample_rank = np.append(0, np.cumsum(self.sampled))
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of `patterns`, all searched backwards at once."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            c = patterns[live, k]
            low[live] = self.first[c] + self.ranks.rank(c, low[live])
            high[live] = self.first[c] + self.ranks.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence, by steps back to a sampled suffix."""
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        steps = np.zeros(len(at), np.int64)
        going = np.flatnonzero(~self.sampled[at])
        while len(going):
            here = at[going]
            c = self.bwt[here]
            at[going] = self.first[c] + self.ranks.rank(c, here)
            steps[going] += 1
            going = going[~self.sampled[at[going]]]
        return which, self.samples[self.sample_rank[at]] + steps
