"""Suffix sorting and wavelet ranks in numpy, for the two index operators."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, depth: int | None = None, rank: np.ndarray | None = None, step: int = 1) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; ties beyond ``depth`` symbols stay in text order.

    rank: ranks by the first ``step`` symbols, if they are known.
    """
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) if rank is None else rank
    order = np.argsort(rank, kind="stable")
    while step < n and (depth is None or step < depth):
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = s[1:] != s[:-1]
        np.cumsum(fresh, out=fresh)
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    return order


def byte_suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of bytes, in order by their first ``depth`` bytes at least.

    Bytes 0xFF are separators: each differs from all others and is more than any
    before it. Keys and positions share one word while they fit, so a round is
    one plain sort. ``depth`` beyond the longest piece gives the full order.
    """
    n = len(data)
    place = max(1, int(n).bit_length())
    step = max(1, (63 - place) // 8)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(step):
        key <<= 8
        key[: n - k] |= np.where(ended[: n - k], 0, data[k:])
        ended[: n - k] |= data[k:] == 0xFF
    mask, at = (1 << place) - 1, np.arange(n)
    packed = np.sort(key << place | at)
    first = True
    while True:
        order = packed & mask
        fresh = np.zeros(n, np.int64)
        packed >>= place
        fresh[1:] = packed[1:] != packed[:-1]
        if first:  # separators in keys are equal there, and differ by their place
            fresh[1:] |= ended[order[1:]]
            first = False
        np.cumsum(fresh, out=fresh)
        if step >= depth or fresh[-1] == n - 1:
            return order
        rank = np.empty(n + 1, np.int64)
        rank[order] = fresh + 1
        rank[n] = 0
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[min(step, n) : n]
        if 3 * place + 1 <= 63:
            packed = np.sort((rank[:n] << place | second) << place | at)
        else:
            key = rank[:n] * (n + 1) + second
            order = np.argsort(key)
            # equal keys get equal places above the position bits
            s = key[order]
            fresh[0] = 0
            fresh[1:] = s[1:] != s[:-1]
            packed = np.cumsum(fresh) << place | order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols 0 .. sigma - 1 in a sequence: a bit vector with running counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.sigma = len(seq), sigma
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            k = ones[i]
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + k, i - k)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._down(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbol = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            k = ones[i]
            bit = ones[i + 1] - k
            symbol = (symbol << 1) | bit
            i = np.where(bit == 1, zeros + k, i - k)
        return symbol, i - self.start[symbol]


class FMIndex:
    """Backward search and location over a sequence of symbols from 1 on; 0 ends it."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate([seq, [0]]).astype(np.int64)
        sa = suffix_array(text)
        self.n, self.sigma = len(text), sigma
        self.tree = WaveletMatrix(text[sa - 1], sigma)
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        marked = sa % sample == 0
        self.marks = np.zeros(self.n + 1, np.int64)
        np.cumsum(marked, out=self.marks[1:])
        self.sampled = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, the range of suffixes that it begins."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        at, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            k = self.marks[at]
            done = self.marks[at + 1] > k
            out[live[done]] = self.sampled[k[done]] + steps
            live, at = live[~done], at[~done]
            if len(live):
                symbol, rank = self.tree.access(at)
                at = self.before[symbol] + rank
            steps += 1
        return out
