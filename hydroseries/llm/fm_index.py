"""A compressed full-text index over token sequences: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


#: The lowest 0 to 63 bits of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class RankBits:
    """A bit vector in 64-bit words with a count for each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[i & 63])


class WaveletMatrix:
    """Symbols of a sequence by their bits, the highest first; each level sorts zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(RankBits(bit))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def ranks(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """For each position, how often the symbol occurs before it, counted from where the symbol's block begins on the last level."""
        at = np.stack(positions)
        for k, level in enumerate(self.levels):
            ones = level.ones_before(at)
            at = np.where(symbol & (1 << (self.depth - 1 - k)), level.zeros + ones, at - ones)
        return list(at)


class FmIndex:
    """Backward search and matching statistics for up to `depth` tokens. Suffixes are sorted by their first `depth` tokens, which is all that these tell apart."""

    def __init__(self, tokens: np.ndarray, depth: int):
        self.tokens, self.depth = tokens, depth
        n = len(tokens)
        rank = tokens.astype(np.int64)
        step = 1
        while step < depth:
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (n + int(tokens.max(initial=0)) + 2) + after, return_inverse=True)[1]
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        top = int(tokens.max(initial=0))
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=top + 1))))
        self.bwt = WaveletMatrix(tokens[self.suffixes - 1], top)
        self.block = self.bwt.ranks(np.arange(top + 1), np.zeros(top + 1, np.int64))[0]

    def extend_left(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bwt.ranks(symbol, low, high)
        base = self.counts[symbol] - self.block[symbol]
        return base + a, base + b

    def intervals(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern tokens[start:start + length], by backward search."""
        low = np.zeros(len(start), np.int64)
        high = np.full(len(start), len(self.tokens), np.int64)
        for j in range(length - 1, -1, -1):
            low, high = self.extend_left(self.tokens[start + j], low, high)
        return low, high

    def common(self) -> np.ndarray:
        """How many of their first `depth` tokens each suffix shares with the one before it; 0 at both ends."""
        n = len(self.tokens)
        padded = np.concatenate((self.tokens, np.full(self.depth, -1)))
        out = np.zeros(n + 1, np.int64)
        same = np.arange(1, n)
        for j in range(self.depth):
            same = same[padded[self.suffixes[same] + j] == padded[self.suffixes[same - 1] + j]]
            same = same[padded[self.suffixes[same] + j] >= 0]
            out[same] += 1
        return out

    def matching_statistics(self, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, me: np.ndarray) -> np.ndarray:
        """For each token, the length (depth at most) of the longest match from it to its text's end that a lesser owner has too.

        owner: of each token of the index. Text k is tokens[begin[k]:end[k]], me[k] is its own number. All texts are streamed from right to
        left, side by side: a match grows by one token to the left by backward search; where no lesser owner has the longer one,
        it is cut on the right to the next shorter length that more suffixes share, and tried again.
        """
        n, depth = len(self.tokens), self.depth
        common = self.common()
        # By length and suffix: the interval of suffixes that share so many tokens, and its least owner.
        first, after, least = (np.empty((depth + 1, n), np.int32) for _ in range(3))
        by_suffix = owner[self.suffixes]
        for d in range(depth + 1):
            edge = np.flatnonzero(np.concatenate(([True], common[1:n] < d))) if n else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((edge, [n])))
            first[d], after[d] = np.repeat(edge, size), np.repeat(edge + size, size)
            least[d] = np.repeat(np.minimum.reduceat(by_suffix, edge), size) if n else 0
        out = np.zeros(n, np.int64)
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, at, me = begin[order], end[order].copy(), me[order]
        length = at - begin
        alive = np.searchsorted(-length, -np.arange(1, length.max(initial=0) + 1), side="right")
        low, high, have = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64), np.zeros(len(at), np.int64)
        for k in alive.tolist():
            at[:k] -= 1
            symbol = self.tokens[at[:k]]
            full = np.flatnonzero(have[:k] == depth)
            have[full] -= 1
            low[full], high[full] = first[depth - 1, low[full]], after[depth - 1, low[full]]
            going = np.arange(k)
            while len(going):
                a, b = self.extend_left(symbol[going], low[going], high[going])
                longer = have[going] + 1
                found = least[longer, a] < me[going]
                took = going[found]
                low[took], high[took], have[took] = a[found], b[found], longer[found]
                going = going[~found]
                going = going[have[going] > 0]
                cut = np.maximum(common[low[going]], common[high[going]])
                have[going], low[going], high[going] = cut, first[cut, low[going]], after[cut, low[going]]
            out[at[:k]] = have[:k]
        return out
