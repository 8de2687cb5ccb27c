"""A compressed FM-index of one shard: a word-level BWT in a wavelet matrix, searched backward for many queries at once."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A bit vector in 64-bit words with a count before each: ``rank(i)`` is the number of ones before ``i``.

    Where few different words make it up, as in the runs that repeats leave in a BWT, it is held as numbers of the
    smallest fitting type into a table of them.
    """

    def __init__(self, bits: np.ndarray):
        n = bits.size
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: packed.size] = packed
        words = raw.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32)
        self.table, code = np.unique(words, return_inverse=True)
        self.code = code.astype(np.min_scalar_type(self.table.size))
        if self.table.nbytes + self.code.nbytes >= words.nbytes:
            self.table, self.code = words, None
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (ONE << (i & 63).astype(np.uint64)) - ONE
        word = self.table[at if self.code is None else self.code[at]]
        return self.before[at] + np.bitwise_count(word & low)


class Wavelet:
    """A wavelet matrix: bit planes from the highest bit down, each with its zeros moved to the front for the next."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.planes = []
        for k in reversed(range(self.depth)):
            bits = (values >> k & 1).astype(bool)
            self.planes.append(Bits(bits))
            values = np.concatenate((values[~bits], values[bits]))
        self.base = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, plane in zip(reversed(range(self.depth)), self.planes, strict=True):
            ones = plane.rank(at)
            at = np.where(symbol >> k & 1, plane.zeros + ones, at - ones)
        return at


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """By doubling, up to the length at which suffixes must differ; every segment ends in a symbol of its own."""
    n = text.size
    rank, order = text.astype(np.int64), None
    reach = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] + 1
        pair = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(pair, kind="stable")
        step = np.empty(n, bool)
        step[0] = False
        np.not_equal(pair[order[1:]], pair[order[:-1]], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        reach *= 2
        if reach > longest or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Over segments of words, given as one array of word numbers from 0 and the segments' ends (exclusive)."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, kinds: int):
        segments = ends.size
        lengths = np.diff(np.concatenate(([0], ends)))
        closed = np.empty(words.size + segments, np.int64)
        stops = np.cumsum(lengths + 1) - 1
        inside = np.ones(closed.size, bool)
        inside[stops] = False
        closed[inside] = words + segments
        closed[stops] = np.arange(segments)
        order = suffix_array(closed, int(lengths.max()) + 1)
        previous = closed[order - 1]
        bwt = np.where(previous < segments, 0, previous - segments + 1)
        self.counts = np.concatenate(([0, segments], segments + np.cumsum(np.bincount(words, minlength=kinds))))[: kinds + 1]
        self.tree = Wavelet(bwt, kinds + 1)
        self.size = closed.size

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with ``word`` and then what [low, high) begins with."""
        symbol = word + 1
        start = self.counts[symbol] - self.tree.base[symbol]
        return start + self.tree.descend(symbol, low), start + self.tree.descend(symbol, high)


def repeated_windows(index: FMIndex, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For each place in ``words``: does the window of ``width`` words that starts there occur twice or more in the index?

    Only windows inside the queries [begin, end) are looked at.  All queries advance in step.  Each matches backward
    from the end of its leftmost open window.  If no second occurrence is left at word ``i``, all windows up to ``i``
    that hold the match are done, and the next begins past ``i``.  If the window matches whole, its match is extended
    to the right by bisection, which settles all windows inside it.
    """
    marks = np.zeros(words.size + 1, np.int64)
    q = np.flatnonzero(ends - begins >= width)
    stop, s = ends[q], begins[q].copy()
    good, bad = s.copy(), stop + 1  # the longest match known from s, and the shortest end known to have none
    e = s + width
    i, low, high = e.copy(), np.zeros(q.size, np.int64), np.full(q.size, index.size, np.int64)
    live = np.arange(q.size)
    while live.size:
        at = i[live] - 1
        lo, hi = index.extend(words[at], low[live], high[live])
        twice = hi - lo >= 2
        low[live], high[live] = lo, hi
        i[live[twice]] -= 1
        over = np.flatnonzero(~twice | (i[live] == s[live]))
        if not over.size:
            continue
        k, won = live[over], twice[over]
        fail = at[over]  # where a match was lost; it held from fail + 1 to e
        # Lost: what it held is matched all the same.
        lost = k[~won]
        held, until = fail[~won] + 1, e[lost] - width
        some = until >= held
        np.add.at(marks, held[some], 1)
        np.add.at(marks, until[some] + 1, -1)
        first = good[lost] == s[lost]  # not one window from s on has matched yet: skip past the loss
        new, old = lost[first], lost[~first]
        s[new] = fail[~won][first] + 1
        good[new], bad[new] = s[new], stop[new] + 1
        bad[old] = e[old]
        good[k[won]] = e[k[won]]
        # A match that cannot grow settles its windows, and the next window begins behind the last of them.
        grown = k[(good[k] > s[k]) & (good[k] + 1 >= bad[k])]
        np.add.at(marks, s[grown], 1)
        np.add.at(marks, good[grown] - width + 1, -1)
        s[grown] = good[grown] - width + 1
        good[grown], bad[grown] = s[grown], stop[grown] + 1
        fresh = good[k] == s[k]
        wide = (good[k] == s[k] + width) & (bad[k] == stop[k] + 1)  # first try the whole rest
        e[k] = np.where(fresh, s[k] + width, np.where(wide, stop[k], (good[k] + bad[k]) // 2))
        i[k], low[k], high[k] = e[k], 0, index.size
        ended = k[s[k] + width > stop[k]]
        if ended.size:
            live = live[~np.isin(live, ended)]
    return np.cumsum(marks[:-1]) > 0
