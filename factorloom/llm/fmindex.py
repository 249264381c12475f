"""FM-index over integer symbols: suffix array, BWT in a wavelet matrix, backward search, locating.

Everything is vectorised over patterns: a step extends all patterns (or walks all rows) at once.
Symbol 0 separates texts and is never part of a pattern.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    new = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    h = 1
    alone = new & np.concatenate([new[1:], [True]]) if n else new
    todo = np.flatnonzero(~alone)  # places in the order whose suffixes are tied
    while len(todo):
        suffix = order[todo]
        after = suffix + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[suffix]
        by = np.lexsort((second, first))
        suffix, first, second = suffix[by], first[by], second[by]
        order[todo] = suffix
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[suffix] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        todo = todo[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.depth = len(symbols), max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        s = symbols
        for k in range(self.depth - 1, -1, -1):
            bit = (s >> k) & 1
            self.levels.append(Bits(bit))
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            s = np.concatenate([s[zero], s[~zero]])
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank1(i)
            i = np.where((c >> k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c is among the first i."""
        return self._down(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each is before its place."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            ones = bits.rank1(i)
            bit = bits.rank1(i + 1) - ones
            c = c << 1 | bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return c, i - self.begin[c]


class FMIndex:
    """Index of ``text`` (symbols below ``sigma``); every ``sample``-th position is kept for locating."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate([text, [0]]).astype(np.int64)
        # the last separator is made the least suffix, so that the steps back form one cycle
        self.n = len(text)
        self.order = sa = suffix_array(np.concatenate([text[:-1] + 1, [0]]))
        bwt = np.where(sa > 0, text[sa - 1] + 1, 0)
        self.wavelet = WaveletMatrix(bwt, sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma + 1))])
        marked = sa % sample == 0
        self.marks, self.samples = Bits(marked), sa[marked]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend patterns with rows lo..hi by the symbol c to the left."""
        c = c + 1
        n = len(lo)
        ranks = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        start = self.before[c]
        return start + ranks[:n], start + ranks[n:]

    def search(self, patterns: np.ndarray, lengths: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each pattern (right-aligned in the matrix); the search ends when fewer than ``least`` rows are left."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for s in range(width):
            live = live[(lengths[live] > s) & (hi[live] - lo[live] >= least)]
            if not len(live):
                break
            lo[live], hi[live] = self.step(patterns[live, width - 1 - s], lo[live], hi[live])
        short = hi - lo < least
        hi[short] = lo[short]
        return lo, hi

    def _common(self, text: np.ndarray, most: int) -> np.ndarray:
        """Symbols (none 0, at most ``most``) that each row's suffix shares with the row before; n + 1 entries, the outer ones 0."""
        text = np.concatenate([text, np.zeros(most + 1, np.int64)])
        out, live = np.zeros(self.n + 1, np.int64), np.arange(1, self.n)
        for k in range(most):
            a = text[self.order[live - 1] + k]
            live = live[(a > 0) & (a == text[self.order[live] + k])]
            if not len(live):
                break
            out[live] += 1
        return out

    def matching_statistics(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the indexed text: the length of the longest run of symbols from there, ``most`` at most, that two
        rows or more begin with, and the first of these rows.

        The streams ``first`` .. ``first + size`` are read from their ends.  Where a match can't be
        extended, it gives way to the longest shorter one with more rows: the run of rows around it
        that have the larger of its two outer common prefixes in common.
        """
        common = self._common(text, most)
        # of each length, the runs of two rows and more that share it: length and first row in one number, and ends
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, most):
            inside = np.concatenate([[False], common[1:] >= k, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            starts.append(k * (self.n + 1) + edge[0::2])
            ends.append(edge[1::2] + 1)
        starts, ends = np.concatenate(starts), np.concatenate(ends)

        def around(row, k):
            at = np.searchsorted(starts, k * (self.n + 1) + row, "right") - 1
            at = np.maximum(at, 0)
            lo = np.where(k > 0, starts[at] - k * (self.n + 1), 0) if len(starts) else np.zeros(len(row), np.int64)
            return lo, np.where(k > 0, ends[at], self.n) if len(starts) else np.full(len(row), self.n)

        length, rows = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        pos, lo, hi, matched = first + size, np.zeros(len(first), np.int64), np.full(len(first), self.n), np.zeros(len(first), np.int64)
        live = np.flatnonzero(size > 0)
        while len(live):
            full = live[matched[live] == most]
            if len(full):
                matched[full] = most - 1
                lo[full], hi[full] = around(lo[full], matched[full])
            a, b = self.step(text[pos[live] - 1], lo[live], hi[live])
            on = b - a > 1
            good, bad = live[on], live[~on]
            lo[good], hi[good] = a[on], b[on]
            matched[good] += 1
            pos[good] -= 1
            length[pos[good]], rows[pos[good]] = matched[good], lo[good]
            none = matched[bad] == 0
            pos[bad[none]] -= 1
            some = bad[~none]
            if len(some):
                matched[some] = np.maximum(common[lo[some]], common[hi[some]])
                lo[some], hi[some] = around(lo[some], matched[some])
            live = live[pos[live] > first[live]]
        return length, rows

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled row, counting steps."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            r = at[live]
            rank = self.marks.rank1(r)
            marked = self.marks.rank1(r + 1) > rank
            out[live[marked]] = self.samples[rank[marked]] + steps
            live = live[~marked]
            c, before = self.wavelet.access(at[live])
            at[live] = self.before[c] + before
            steps += 1
        return out
