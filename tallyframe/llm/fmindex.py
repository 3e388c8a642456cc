"""A compressed FM-index over short texts: matching statistics of streamed texts, as far as they reach a threshold.

Held are the wavelet matrix of the Burrows-Wheeler transform with packed ranks, a bit per row that tells where
suffixes begin that differ in their first L - 1 symbols, and the places of every RATE-th symbol. A
streamed text is read from its end backwards. Once its last window of L symbols is found, each window before
it takes two steps: its last symbol is dropped (the rows equal over L - 1 symbols), and the symbol before it is
added by backward search. Where that fails, reading starts anew one symbol before the window's end. All streamed
texts take their steps together. Places are found by walking from row to row to the next one that is held.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Of every text, each RATE-th symbol from the first on has its place held.
RATE = 8


class Bits:
    """A bit string of n bits with rank in constant time: packed words and a count per word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def last1(self, i: np.ndarray) -> np.ndarray:
        """The last bit set at or before i; there is one."""
        w = i >> 6
        word = self.words[w] & (~np.uint64(0) >> (63 - (i & 63)).astype(np.uint64))
        w = np.where(word == 0, self._filled()[0][np.maximum(w - 1, 0)], w)
        word = np.where(word == 0, self.words[w], word)
        return w * 64 + _top(word)

    def next1(self, i: np.ndarray, n: int) -> np.ndarray:
        """The first bit set at or after i, or n."""
        w = np.minimum(i >> 6, len(self.words) - 1)
        word = np.where(i >> 6 == w, self.words[w] & (~np.uint64(0) << (i & 63).astype(np.uint64)), np.uint64(0))
        after = self._filled()[1][np.minimum(w + 1, len(self.words))]
        w = np.where(word == 0, after, w)
        none = w >= len(self.words)
        word = np.where(word == 0, self.words[np.minimum(w, len(self.words) - 1)], word)
        low = word & (~word + _ONE)
        return np.where(none, n, w * 64 + _top(np.where(none, _ONE, low)))

    def _filled(self) -> tuple[np.ndarray, np.ndarray]:
        """For every word the last one at or before it, and the first one at or after it, that has a bit set."""
        if not hasattr(self, "_near"):
            at = np.arange(len(self.words))
            full = self.words != 0
            down = np.maximum.accumulate(np.where(full, at, 0))
            up = np.minimum.accumulate(np.where(full, at, len(at))[::-1])[::-1]
            self._near = down.astype(np.int32), np.append(up, len(at)).astype(np.int32)
        return self._near


def _top(word: np.ndarray) -> np.ndarray:
    """The number of the highest bit set."""
    out = np.zeros(len(word), np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        high = word >> np.uint64(k)
        out += np.where(high != 0, k, 0)
        word = np.where(high != 0, high, word)
    return out


class WaveletMatrix:
    """Rank of a symbol in a sequence, a bit string per bit of the symbols."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        v = values
        for b in range(self.bits - 1, -1, -1):
            bit = (v >> b) & 1
            self.levels.append((b, Bits(bit)))
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        self.base = np.zeros(1 << self.bits, np.int64)
        self.base = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits in self.levels:
            ones = bits.rank1(i)
            i = np.where((c >> b) & 1, bits.zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for b, bits in self.levels:
            one = (bits.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE != 0
            ones = bits.rank1(i)
            i = np.where(one, bits.zeros + ones, i - ones)
            c |= one.astype(np.int64) << b
        return c, i - self.base[c]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._down(c, i) - self.base[c]


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    r = np.empty(len(key), np.int64)
    r[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
    return r


def suffix_order(s: np.ndarray, sigma: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the texts in order, where the end of each text counts as a symbol of its own; and each
    suffix's class by its first window - 1 symbols."""
    n = len(s)
    text = np.cumsum(s == 0) - (s == 0)
    width = max(1, int(sigma).bit_length())
    h = max(1, min(62 // width, window - 1))
    key, tie, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.bool_)
    for i in range(h):
        c = np.zeros(n, np.int64)
        if i < n:
            c[: n - i] = s[i:]
        key = (key << width) | np.where(alive, c, 0)
        ended = alive & (c == 0)
        tie[ended] = text[ended] + 1
        alive &= ~ended
    rank = _ranks(_ranks(key) * (int(text[-1]) + 2) + tie)

    def pair(r: np.ndarray, d: int) -> np.ndarray:
        k = r * (n + 1)
        if d < n:
            k[: n - d] += r[d:] + 1
        return _ranks(k)

    low = rank if h >= window - 1 else None
    while int(rank.max()) < n - 1:
        if low is None and 2 * h >= window - 1:
            low = pair(rank, window - 1 - h)
        rank = pair(rank, h)
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, (rank if low is None else low)


class FMIndex:
    """Index of texts given as one array of symbols from 1 to sigma - 1, with 0 after every text."""

    def __init__(self, s: np.ndarray, starts: np.ndarray, sigma: int, window: int):
        self.n, self.window, self.starts = len(s), window, starts
        sa, cls = suffix_order(s, sigma, window)
        self.wavelet = WaveletMatrix(s[sa - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        c = cls[sa]
        self.begins = Bits(np.append(True, c[1:] != c[:-1]))
        within = np.arange(self.n) - np.repeat(starts, np.diff(np.append(starts, self.n)))
        held = (within % RATE == 0)[sa]
        self.held, self.places = Bits(held), sa[held].astype(np.int32)

    def backward(self, c: np.ndarray, sp: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pattern with c before it, from the rows of the pattern."""
        both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([sp, ep]))
        return self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows: at most RATE - 1 steps to the symbol before."""
        out, live, row, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(live):
            r = row[live]
            here = (self.held.words[r >> 6] >> (r & 63).astype(np.uint64)) & _ONE != 0
            out[live[here]] = self.places[self.held.rank1(r[here])] + steps
            live, r = live[~here], r[~here]
            c, before = self.wavelet.access(r)
            row[live] = self.less[c] + before
            steps += 1
        return out

    def matches(self, pat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For streamed texts at `off` (symbols not in the index are negative): the text, a window's start in it, and
        the place in the index, once for every text of the index and distance between the two that match."""
        L, n = self.window, self.n
        size = np.diff(off)
        live = np.flatnonzero(size >= L)
        end, j = size.copy(), size - 1
        sp, ep, found = np.zeros(len(size), np.int64), np.full(len(size), n, np.int64), np.zeros(len(size), np.bool_)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def report(t: np.ndarray) -> None:
            k = ep[t] - sp[t]
            rows = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(sp[t], k)
            out.append((np.repeat(t, k), np.repeat(end[t] - L, k), rows))

        def restart(t: np.ndarray) -> None:
            end[t] -= 1
            j[t], sp[t], ep[t], found[t] = end[t] - 1, 0, n, False

        while len(live):
            a, b = live[~found[live]], live[found[live]]
            if len(a):
                c = pat[off[a] + j[a]]
                s, e = self.backward(np.maximum(c, 0), sp[a], ep[a])
                dead = (c < 0) | (s >= e)
                t = a[~dead]
                sp[t], ep[t] = s[~dead], e[~dead]
                j[t] -= 1
                whole = t[j[t] < end[t] - L]
                if len(whole):
                    found[whole] = True
                    report(whole)
                restart(a[dead])
            if len(b):
                more = end[b] > L
                end[b[~more]] = 0  # ends below
                b = b[more]
                lo, hi = self.begins.last1(sp[b]), self.begins.next1(ep[b], n)
                c = pat[off[b] + end[b] - L - 1]
                s, e = self.backward(np.maximum(c, 0), lo, hi)
                ok = (c >= 0) & (s < e)
                grown = hi - lo > ep[b] - sp[b]
                t = b[ok]
                end[t] -= 1
                sp[t], ep[t] = s[ok], e[ok]
                if len(g := b[ok & grown]):
                    report(g)
                restart(b[~ok])
            live = live[end[live] >= L]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        t, w, rows = map(np.concatenate, zip(*out))
        p = self.locate(rows)
        order = np.lexsort((w, p - w, owner := self.owner(p), t))
        t, w, p, owner = t[order], w[order], p[order], owner[order]
        new = np.append(True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1]) | ((p - w)[1:] != (p - w)[:-1]))
        return t[new], w[new], p[new]

    def owner(self, p: np.ndarray) -> np.ndarray:
        """Which of the index's texts has each place."""
        return np.searchsorted(self.starts, p, "right") - 1


def extend(s: np.ndarray, off: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, n): windows that match at x of text a and y of text b, extended to both sides as far as the texts agree."""
    x, y, n = x.copy(), y.copy(), np.full(len(a), length, np.int64)
    live = np.arange(len(a))
    while len(live := live[(x[live] > 0) & (y[live] > 0)]):
        live = live[s[off[a[live]] + x[live] - 1] == s[off[b[live]] + y[live] - 1]]
        x[live] -= 1
        y[live] -= 1
        n[live] += 1
    live = np.arange(len(a))
    while len(live := live[(x[live] + n[live] < (off[a + 1] - off[a])[live]) & (y[live] + n[live] < (off[b + 1] - off[b])[live])]):
        live = live[s[off[a[live]] + x[live] + n[live]] == s[off[b[live]] + y[live] + n[live]]]
        n[live] += 1
    return x, y, n
