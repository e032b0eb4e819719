"""Compact n-gram levels: Elias-Fano sequences and a trie of three words on them.

A level is a flat array; all levels of a trie lie in one buffer, which a task maps without copying (from an Arrow buffer, bytes or
np.memmap of an exported file). Look-ups take many queries at once.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
#: A code is -log10(p) in steps of 1 / CODES.
CODES = 2048
_POP = np.array([i.bit_count() for i in range(256)], np.uint8)
#: _SELECT[byte, r]: place of the byte's one of rank r.
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def code(p: np.ndarray) -> np.ndarray:
    """Quantised -log10 of probabilities or weights."""
    return np.clip(np.rint(-np.log10(p) * CODES), 0, 65535).astype(np.uint16)


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one of that rank in each 64-bit word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(_POP[parts], axis=1, dtype=np.uint8)
    byte = (ends <= rank[:, None]).sum(1)
    row = np.arange(len(words))
    found = parts[row, byte]
    return byte * 8 + _SELECT[found, rank - (ends[row, byte] - _POP[found]).astype(np.int64)]


class Monotone:
    """An Elias-Fano code of a non-decreasing sequence: low bits packed, high parts in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = 64 * np.arange(len(high) + 1) - self.ones

    @staticmethod
    def coded(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        values = values.astype(U64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // max(1, n)).bit_length() - 1)
        at = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((last >> bits) + n + 2, np.uint8)
        high[at] = 1
        low = np.empty((n, bits), np.uint8)
        for i in range(bits):
            low[:, i] = (values >> U64(i)) & U64(1)
        packed = lambda b: np.frombuffer(np.packbits(b, bitorder="little").tobytes().ljust(8 * (-(-b.size // 64) + 1), b"\0"), U64)
        return n, bits, packed(low.ravel()), packed(high)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        p = i * self.bits
        word, off = p >> 6, (p & 63).astype(U64)
        # A shift by 64 would leave the word as it is, so the second part goes by two steps.
        return ((self.low[word] >> off) | ((self.low[np.minimum(word + 1, len(self.low) - 1)] << (U64(63) - off)) << U64(1))) & U64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = 64 * word + _in_word(self.high[word], i - self.ones[word])
        return ((at - i) << self.bits) + self.lows(i).astype(np.int64)

    def _zero(self, h: np.ndarray) -> np.ndarray:
        """Place of the zero of rank h: it ends the elements with a high part of h."""
        word = np.searchsorted(self.zeros, h, side="right") - 1
        return 64 * word + _in_word(~self.high[word], h - self.zeros[word])

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value, by search for its successor; -1 where the successor is another value."""
        out = np.full(len(x), -1)
        if not self.n:
            return out
        h = x >> self.bits
        some = np.flatnonzero(h < self.zeros[-1])
        h, low = h[some], (x[some] & ((1 << self.bits) - 1)).astype(U64)
        place = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0)
        lo = place - h
        # The elements with this high part are the ones up to the next zero, which seldom lies in another word.
        rest = ~self.high[place >> 6] >> (place & 63).astype(U64)
        hi = lo + np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        over = np.flatnonzero(rest == 0)
        hi[over] = self._zero(h[over]) - h[over]
        end = hi.copy()
        while len(wide := np.flatnonzero(lo < hi)):
            mid = (lo[wide] + hi[wide]) >> 1
            less = self.lows(mid) < low[wide]
            lo[wide[less]] = mid[less] + 1
            hi[wide[~less]] = mid[~less]
        inside = np.flatnonzero(lo < np.minimum(end, self.n))
        same = inside[self.lows(lo[inside]) == low[inside]]
        out[some[same]] = lo[same]
        return out


class Ranges:
    """Sorted lists, one for each group, as one monotone sequence: a list starts one above the last value of the one before it, and
    monotone pointers tell where lists start."""

    def __init__(self, values: Monotone, starts: Monotone) -> None:
        self.values = values
        self.start = starts[np.arange(starts.n)]
        first = self.start[:-1]
        self.base = np.where(first > 0, values[np.maximum(first - 1, 0)] + 1, 0) if values.n else np.zeros(len(first), np.int64)

    @staticmethod
    def coded(group: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The two sequences for values sorted by group and, in a group, ascending."""
        start = np.searchsorted(group, np.arange(groups + 1))
        last = np.where(start[1:] > start[:-1], x[np.maximum(start[1:] - 1, 0)].astype(np.int64) + 1, 0) if len(x) else np.zeros(groups, np.int64)
        base = np.concatenate([[0], np.cumsum(last)])[:-1]
        return x.astype(np.int64) + base[group], start

    def find(self, group: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place in the sequence of x in its group's list, -1 where it isn't there or the group is -1."""
        out = np.full(len(x), -1)
        some = np.flatnonzero(group >= 0)
        g = group[some]
        at = self.values.find(self.base[g] + x[some])
        inside = (at >= 0) & (at < self.start[g + 1])
        out[some[inside]] = at[inside]
        return out


#: The sequences of a trie: the middle words, and lists with pointers: successors of a word, words before it (the contexts), and
#: the words after a context, each as its place among the successors of the context's last word.
_LISTS = ("after", "before", "next")


class Trie:
    """Trigram levels around middle words: (w1, w2) -> w3 with quantised smoothed probabilities and back-off weights."""

    def __init__(self, buffer: bytes | memoryview | np.ndarray) -> None:
        data = np.frombuffer(buffer, np.uint8)
        head = int(data[:8].view(np.int64)[0])
        at = 8 + head
        part = {}
        for name, kind, size, meta in json.loads(data[8:at].tobytes()):
            part[name] = (data[at : at + size].view(kind), meta)
            at += -(-size // 8) * 8
        known = lambda name: Monotone(*part[f"{name}.low"][1], part[f"{name}.low"][0], part[f"{name}.high"][0])
        self.words = known("words")
        self.after, self.before, self.next = (Ranges(known(n), known(f"{n}.start")) for n in _LISTS)
        self.back2, self.code2, self.back3, self.code3 = (part[n][0] for n in ("back2", "code2", "back3", "code3"))

    @classmethod
    def load(cls, path: str) -> Trie:
        """An exported trie, mapped from its file."""
        return cls(np.memmap(path, np.uint8, mode="r"))

    @staticmethod
    def built(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, p1: np.ndarray, priors: tuple[float, float], told: np.ndarray | None = None) -> bytes:
        """The levels of distinct trigrams with counts n; p1: codes of w3's own probability; told: counts of w2, (w1, w2) and (w2, w3)
        where these are more than the rows here add up to, else 0. Trigrams with such counts may have n = 0.

        p(w3|w2) = (c23 + a p(w3)) / (c2 + a), p(w3|w1 w2) = (c123 + b p(w3|w2)) / (c12 + b): Dirichlet priors around the lower order.
        """
        told = np.zeros((3, len(n)), np.int64) if told is None else told
        order = np.lexsort((w1, w3, w2))
        w1, w2, w3, n, p1, told = w1[order], w2[order], w3[order], n[order].astype(np.int64), p1[order], told[:, order]
        fresh = lambda *keys: np.concatenate([np.ones(min(1, len(keys[0])), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        total = lambda rows, at, given: np.where(given[rows][at] > 0, given[rows][at], np.add.reduceat(n[rows], at) if len(at) else n[:0])
        a, b = priors
        new2 = fresh(w2)
        at2, i2 = np.flatnonzero(new2), np.cumsum(new2) - 1
        c2 = total(np.arange(len(n)), at2, told[0])
        # A row without a count of its own still tells a pair that is counted elsewhere.
        after = np.flatnonzero((n > 0) | (told[2] > 0))
        new23 = fresh(w2[after], w3[after])
        at23 = np.flatnonzero(new23)
        i23 = np.full(len(n), -1)
        i23[after] = np.cumsum(new23) - 1
        first = after[at23]
        code2 = code((total(after, at23, told[2]) + a * 10.0 ** (-p1[first].astype(np.float64) / CODES)) / (c2[i2[first]] + a))
        start23 = np.searchsorted(i2[first], np.arange(len(at2)))
        before = np.flatnonzero((n > 0) | (told[1] > 0))
        before = before[np.lexsort((i23[before], w1[before], i2[before]))]
        new12 = fresh(i2[before], w1[before])
        at12 = np.flatnonzero(new12)
        c12 = total(before, at12, told[1])
        seen = n[before] > 0
        i12, own = (np.cumsum(new12) - 1)[seen], before[seen]
        code3 = code((n[own] + b * 10.0 ** (-code2[i23[own]].astype(np.float64) / CODES)) / (c12[i12] + b))
        parts: list[tuple[str, np.ndarray, tuple[int, int] | None]] = []

        def sequence(name: str, values: np.ndarray) -> None:
            count, bits, low, high = Monotone.coded(values)
            parts.extend([(f"{name}.low", low, (count, bits)), (f"{name}.high", high, None)])

        sequence("words", w2[at2])
        for name, group, x, groups in (("after", i2[first], w3[first], len(at2)), ("before", i2[before[at12]], w1[before[at12]], len(at2)), ("next", i12, i23[own] - start23[i2[own]], len(at12))):
            values, start = Ranges.coded(group, x, groups)
            sequence(name, values)
            sequence(f"{name}.start", start)
        parts += [("back2", code(a / (c2 + a)), None), ("code2", code2, None), ("back3", code(b / (c12 + b)), None), ("code3", code3, None)]
        head = json.dumps([(name, x.dtype.str, x.nbytes, meta) for name, x, meta in parts]).encode()
        head += b" " * (-len(head) % 8)
        return b"".join([np.int64(len(head)).tobytes(), head, *(x.tobytes() + b"\0" * (-x.nbytes % 8) for _, x, _ in parts)])

    def codes(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """The code of -log10 p(w3|w1 w2): the trigram's own, or back-off weights and the next lower order that is known."""
        # Neighbours that share words share look-ups; sorted queries make the most of it.
        change = lambda *keys: np.concatenate([np.ones(min(1, len(w2)), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        new2, new23 = change(w2), change(w2, w3)
        word = self.words.find(w2[new2])[np.cumsum(new2) - 1]
        second = self.after.find(word[new23], w3[new23])[np.cumsum(new23) - 1]
        context = self.before.find(word, w1)
        near = np.where(second >= 0, second - (self.after.start[np.maximum(word, 0)] if len(self.after.start) else 0), 0)
        third = self.next.find(np.where(second >= 0, context, -1), near)
        own = lambda codes, at: np.where(at >= 0, codes[np.maximum(at, 0)].astype(np.int64), 0) if len(codes) else np.zeros(len(at), np.int64)
        lower = np.where(second >= 0, own(self.code2, second), own(self.back2, word) + p1)
        return np.minimum(np.where(third >= 0, own(self.code3, third), own(self.back3, context) + lower), 65535).astype(np.uint16)
