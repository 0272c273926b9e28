"""A succinct FM-index over whole numbers: backward search on a wavelet matrix, matching statistics.

The index holds sequences, each with an end mark. Suffixes are sorted by as many symbols as the
longest has, which orders all that a pattern can be. The BWT lies in a wavelet matrix: per
bit of a symbol one bit vector with ranks, a word of 64 bits and a count for each. Matching
statistics shrink a match that can't be extended to its parent interval, told by the common
prefixes of neighbouring suffixes.
"""

from __future__ import annotations

import numpy as np


class Ranks:
    """Bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        whole = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        whole[: len(bits)] = bits
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class Wavelet:
    """Symbols as bit vectors, the highest bit first; at each level zeros go before ones."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.bits = max(1, int(kinds - 1).bit_length())
        self.levels: list[tuple[Ranks, int]] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append((Ranks(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes by the bits of symbol; less follow(symbol, 0) it is the symbol's rank before i."""
        for b, (ranks, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = ranks.ones(i)
            i = np.where((symbol >> b) & 1 == 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Index of sequences of whole numbers, given as one array of values and their offsets."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.depth = 1 << int(sizes.max(initial=1)).bit_length()
        _, inverse = np.unique(values, return_inverse=True)
        kinds = int(inverse.max(initial=-1)) + 2
        #: The sequences, each followed by the mark 0; starts are their places.
        self.starts = offsets[:-1] + np.arange(len(sizes))
        self.text = np.zeros(len(values) + len(sizes), dtype=np.int64)
        self.text[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = inverse + 1
        n = len(self.text)
        ranks, order = self._sorted()
        self._tree(ranks, order)
        self.wavelet = Wavelet(self.text[order - 1], kinds)
        every = np.arange(kinds)
        self.base = np.searchsorted(np.sort(self.text), every) - self.wavelet.follow(every, np.zeros(kinds, dtype=np.int64))
        self.size = n

    def _sorted(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Ranks of the suffixes by their first 1, 2, 4, ... depth symbols, and their order."""
        n, step = len(self.text), 1
        ranks = [self.text.astype(np.int32)]
        while step < self.depth:
            last = ranks[-1].astype(np.int64)
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = last[step:] + 1
            _, inverse = np.unique(last * (n + 2) + after, return_inverse=True)
            ranks.append(inverse.astype(np.int32))
            step *= 2
        return ranks, np.argsort(ranks[-1], kind="stable")

    def _tree(self, ranks: list[np.ndarray], order: np.ndarray) -> None:
        """Common prefixes of neighbours, and where the next shorter one lies on either side."""
        n = len(order)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n + 1, dtype=np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            fits = (a < n) & (b < n)
            same = np.zeros(n - 1, dtype=bool)
            same[fits] = ranks[level][a[fits]] == ranks[level][b[fits]]
            common[1:-1][same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        self.common = np.minimum(common, self.depth)
        self.left, self.right = np.zeros(n + 1, dtype=np.int32), np.full(n + 1, n, dtype=np.int32)
        small = self.common.astype(np.min_scalar_type(self.depth))
        for depth in np.unique(small[1:-1]):
            if not depth:
                continue
            here, less = np.flatnonzero(small == depth), small < depth
            places = np.flatnonzero(less)  # the first and the last place have 0
            after = np.cumsum(less, dtype=np.int32)[here]
            self.left[here], self.right[here] = places[after - 1], places[after]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the patterns with symbol before them."""
        both = self.wavelet.follow(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.base[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of the longest prefixes that more suffixes begin with, and their lengths."""
        a, b = self.common[low], self.common[high]
        depth = np.maximum(a, b).astype(np.int64)
        root = depth == 0
        low, high = np.where(a == depth, self.left[low], low), np.where(b == depth, self.right[high], high)
        return np.where(root, 0, low), np.where(root, self.size, high), depth

    def statistics(self, streams: np.ndarray, sizes: np.ndarray, least: int = 2) -> np.ndarray:
        """Per place of text: the length of the longest match from there on, within its sequence, with `least` occurrences.

        streams are the starts of the sequences that are read, all of them at once from the back;
        places of others have 0.
        """
        out = np.zeros(self.size, dtype=np.int32)
        at, first = streams + sizes - 1, streams
        low, high, length = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.size, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        while len(at):
            down, up = self.extend(self.text[at], low, high)
            ok = up - down >= least
            stuck = ~ok & (length > 0)
            low, high = np.where(ok, down, low), np.where(ok, up, high)
            if stuck.any():
                low[stuck], high[stuck], length[stuck] = self.parent(low[stuck], high[stuck])
            length += ok
            moved = ~stuck
            out[at[moved]] = length[moved]
            at = at - moved
            on = at >= first
            if not on.all():
                at, first, low, high, length = at[on], first[on], low[on], high[on], length[on]
        return out
