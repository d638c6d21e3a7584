"""A compressed full-text index over numbers: Burrows-Wheeler transform in a wavelet matrix.

Neither the text nor its suffix array is kept: the transform, counts, and where the groups of
rows with equal beginnings start are all there is, and every ``sample``-th place where places are
to be located.  Everything is done for many queries at once with NumPy: one backward-search step for a whole vector of intervals
costs one pass over the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class BitVector:
    """Bits in 64-bit words with counts before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """A wavelet tree laid out level by level, the highest bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            vector = BitVector(bit)
            self.levels.append((level, vector, len(values) - vector.ones))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position, plus where the symbol's run begins."""
        for level, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where((symbol >> level & 1).astype(bool), zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        found = np.zeros(len(at), np.int64)
        for _, vector, zeros in self.levels:
            bit, ones = vector[at], vector.rank(at)
            found = found << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return found


class FMIndex:
    """An index over ``text`` (numbers from 1 on; 0 is added as its end).

    ``depth`` symbols are the longest match it can tell; ``values``, one for each place of the
    text, are kept as the least one of each group of places whose next ``depth`` symbols agree.
    Suffixes are sorted by ``depth`` symbols and one more; wholly only with ``sample``.
    """

    def __init__(self, text: np.ndarray, depth: int, values: np.ndarray | None = None, sample: int = 0):
        text = np.append(text, 0).astype(np.int32)
        n = self.size = len(text)
        self.depth = depth
        rank, have = text, 1
        while True:
            key = rank.astype(np.int64)
            key *= n + int(rank.max()) + 2
            key[:-have] += rank[have:]
            key[:-have] += 1
            order = np.argsort(key).astype(np.int32)
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            del key
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32) - 1
            have *= 2
            if (have >= depth + 1 and not sample) or new.all():
                break
        del rank
        self.bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(text[order - 1], self.bits)
        counts = np.bincount(text)
        self.first = np.cumsum(counts) - counts
        self.runs = self.wavelet.rank(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        # rows whose suffixes share ``depth`` symbols; one that ends before is a group of its own
        whole = order + depth <= n
        same = whole[1:] & whole[:-1]
        for i in range(depth):
            x, y = np.minimum(order[:-1] + i, n - 1), np.minimum(order[1:] + i, n - 1)
            same &= text[x] == text[y]
        new = np.r_[True, ~same]
        self.starts = np.append(np.flatnonzero(new), n).astype(np.int32)
        self.groups = BitVector(new)
        self.least = None if values is None else np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max)[order], self.starts[:-1])
        if sample:
            kept = order % sample == 0
            self.sampled, self.places = BitVector(kept), order[kept].astype(np.int32)

    def group_of(self, row: np.ndarray) -> np.ndarray:
        return self.groups.rank(row + 1) - 1

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + match; empty for unknown symbols."""
        known = (symbol > 0) & (symbol < len(self.first))
        symbol = np.where(known, symbol, 0)
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol] - self.runs[symbol]
        return np.where(known, base + both[: len(symbol)], 0), np.where(known, base + both[len(symbol) :], 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of rows, each walked back to a sampled one (an index with ``sample`` alone)."""
        rows, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            out[open_[done]] = self.places[self.sampled.rank(at[done])] + steps[open_[done]]
            open_, at = open_[~done], at[~done]
            symbol = self.wavelet.access(at)
            rows[open_] = self.first[symbol] + self.wavelet.rank(symbol, at) - self.runs[symbol]
            steps[open_] += 1
        return out

    def matching(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics, bounded by the depth, of stretches [first, last) of ``words``.

        All stretches are streamed from their ends at once.  Yields, for places from which
        ``depth`` words stand in the text, (stretch, place, low, high): the interval of their
        occurrences.  Where a match cannot grow, it is taken up again without its last word;
        behind a word that the text does not hold at all, right before that word.
        """
        live = np.flatnonzero(last - first >= self.depth)
        at, end = last[live].copy(), last[live].copy()
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size)
        while len(live):
            at -= 1
            symbol = words[at]
            low, high = self.extend(symbol, low, high)
            found = low < high
            long = found & (end - at > self.depth)
            if long.any():
                # one word too many: widen to all rows that share the first ``depth``
                of = self.group_of(low[long])
                low[long], high[long] = self.starts[of], self.starts[of + 1]
                end[long] -= 1
            hit = found & (end - at == self.depth)
            if hit.any():
                yield live[hit], at[hit], low[hit], high[hit]
            if not found.all():
                lost = ~found
                known = (symbol > 0) & (symbol < len(self.first))
                end = np.where(lost, np.where(known, end - 1, at), end)
                at = np.where(lost, end, at)
                low, high = np.where(lost, 0, low), np.where(lost, self.size, high)
            go = (at > first[live]) & (end - first[live] >= self.depth)
            live, at, end, low, high = live[go], at[go], end[go], low[go], high[go]
