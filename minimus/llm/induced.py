"""Suffix array with common-prefix values by induced sorting, for one shard of text.

The tuples of the induction (suffix, common-prefix value) run through one queue per first
character. Characters are visited in order, and a tuple popped from the queue of its
character pushes the tuple of the suffix one place before it. As the queues are filled in
sorted order, they are the priority queue of external induced sorting; here a queue is a
list of arrays, and all tuples of a queue are popped and pushed at once.

LMS substrings are sorted by one such induction and named; equal names are told apart by
ranking the string of names (a recursion that doubles the compared length, since its
alphabet is as large as itself); a second induction sorts all suffixes and carries the
common-prefix values: the value of two suffixes that are pushed is one more than the
smallest value between the suffixes that pushed them.

Prefixes are compared up to ``limit`` characters only, as no caller asks for more:
values are cut there, and suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import numpy as np

from .hashing import RangeHash, mix


class _Minima:
    """Minimum over ranges of an array, through tables of powers of two, one after the other in
    one array."""

    def __init__(self, x: np.ndarray, longest: int):
        self.n = len(x)
        rows = max(int(longest).bit_length(), 1)
        flat = np.empty(rows * self.n, x.dtype)
        flat[:self.n] = x
        for k in range(1, rows):
            last, size = (k - 1) * self.n, self.n - (1 << k) + 1
            half = last + (1 << (k - 1))
            np.minimum(flat[last:last + size], flat[half:half + size], out=flat[k * self.n:k * self.n + size])
        self.flat = flat

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min(x[lo:hi]) for each range, none of them empty or longer than ``longest``."""
        level = np.frexp((hi - lo).astype(np.float32 if self.n < 1 << 24 else float))[1] - 1
        base = level.astype(np.int64) * self.n
        return np.minimum(self.flat[base + lo], self.flat[base + hi - (1 << level.astype(np.int64))])


class Queues:
    """One first-in-first-out queue of (suffix, value) tuples per character."""

    def __init__(self, alphabet: int, values: bool):
        self.held: list[list] = [[] for _ in range(alphabet)]
        # smallest value since the last push to each queue; 0 while a queue was never pushed to
        self.since = np.zeros(alphabet, np.int32) if values else None
        self.limit = 0

    def push(self, pos: np.ndarray, ch: np.ndarray, src: np.ndarray, lcp: np.ndarray | None) -> None:
        """Push suffixes ``pos`` with first characters ``ch``, induced by the members
        ``src`` (increasing) of a batch whose members have the values ``lcp`` to the
        member before them."""
        order = np.argsort(ch, kind="stable")  # in linear time, as characters are short integers
        pos, src, ch = pos[order], src[order], ch[order]
        start = np.flatnonzero(np.append(True, ch[1:] != ch[:-1]))
        chars = ch[start]
        stop = np.append(start[1:], len(pos))
        if lcp is not None:
            # from the member after the last one that pushed to the queue (else the first) on
            lo = np.empty(len(pos), np.int64)
            lo[1:] = src[:-1] + 1
            lo[start] = 0
            tail = src[stop - 1] + 1
            more = tail < len(lcp)
            minima = _Minima(lcp, max(int((src + 1 - lo).max()), len(lcp) - int(tail.min())))
            value = minima.of(lo, src + 1)
            value[start] = np.minimum(self.since[chars], value[start])
            value = np.minimum(value + 1, self.limit).astype(lcp.dtype)
            fresh = [not self.held[c] and self.since[c] == -1 for c in chars]
            self.since = np.where(self.since < 0, self.since, np.minimum(self.since, lcp.min()))
            rest = np.full(len(chars), self.limit, np.int32)
            if more.any():
                rest[more] = minima.of(tail[more], np.full(more.sum(), len(lcp)))
            value[start[np.array(fresh, bool)]] = 0
            self.since[chars] = rest
        for c, s, e in zip(chars.tolist(), start.tolist(), stop.tolist(), strict=True):
            self.held[c].append((pos[s:e], None if lcp is None else value[s:e]))

    def watch(self, lcp: np.ndarray) -> None:
        """A batch passed by that pushed nothing."""
        if self.since is not None and len(lcp):
            self.since = np.where(self.since < 0, self.since, np.minimum(self.since, lcp.min()))

    def pop(self, c: int):
        got, self.held[c] = self.held[c], []
        if not got:
            return None
        pos = np.concatenate([g[0] for g in got])
        return pos, (None if got[0][1] is None else np.concatenate([g[1] for g in got]))


class Shard:
    def __init__(self, text: np.ndarray, limit: int):
        """``text``: small integers that end with a unique 0."""
        self.t, self.limit = text, limit
        self.kind = np.int8 if limit < 127 else np.int32  # of common-prefix values
        self.alphabet = int(text.max()) + 1
        n = len(text)
        # a suffix is of type S if it is smaller than the one after it
        change = np.flatnonzero(text[1:] != text[:-1])
        run_end = np.repeat(change, np.diff(change, prepend=-1))
        self.small = np.ones(n, bool)
        self.small[:-1] = text[run_end] < text[run_end + 1]
        lms = self.small.copy()
        lms[0] = False
        lms[1:] &= ~self.small[:-1]
        self.lms = np.flatnonzero(lms)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common-prefix values of pairs of suffixes, by comparison in halving steps."""
        h = self._hash()
        a, b = a.copy(), b.copy()  # how far both are known to agree
        out = np.zeros(len(a), self.kind)
        step = 1 << (self.limit.bit_length() - 1)
        while step:
            all_of = h.every(step)  # no range reaches past the end
            at = np.flatnonzero((np.maximum(a, b) < len(all_of)) & (out <= self.limit - step))
            at = at[all_of[a[at]] == all_of[b[at]]]
            out[at] += step
            a[at] += step
            b[at] += step
            step //= 2
        return out

    def common_of(self, a: int, b: int) -> int:
        """The common-prefix value of one pair."""
        m = min(self.limit, len(self.t) - max(a, b))
        differ = self.t[a:a + m] != self.t[b:b + m]
        return int(differ.argmax()) if differ.any() else m

    def _hash(self) -> RangeHash:
        if not hasattr(self, "_ranges"):
            self._ranges = RangeHash(mix(self.t.astype(np.uint64), 7), 0)
        return self._ranges

    def induce(self, seeds: np.ndarray, lcp: np.ndarray | None):
        """All suffixes in the order that sorted LMS suffixes induce, and their values."""
        t, small, n = self.t, self.small, len(self.t)
        with_lcp = lcp is not None
        first = t[seeds]
        bounds = np.searchsorted(first, np.arange(self.alphabet + 1))

        def run(chars, seeded, want_small, joins):
            """One pass. ``seeded(c)``: tuples that stand behind those induced in c."""
            q = Queues(self.alphabet, with_lcp)
            q.limit = self.limit
            if with_lcp:
                q.since[:] = -1
            found = [[] for _ in range(self.alphabet)]

            def spread(pos, val):
                at = np.flatnonzero(pos > 0)
                prev = pos[at] - 1
                fit = small[prev] == want_small
                at, prev = at[fit], prev[fit]
                if len(prev):
                    q.push(prev, t[prev], at, val)
                elif with_lcp:
                    q.watch(val)

            for c in chars:
                last = None
                while (got := q.pop(c)) is not None:
                    found[c].append(got)
                    spread(*got)
                    last = got[0][-1]
                pos, val = seeded(c)
                if len(pos):
                    if with_lcp:
                        val = val.copy()
                        val[0] = joins(last, pos[0]) if last is not None else 0
                    spread(pos, val)
            return found

        def join(a, b):
            return self.common_of(int(a), int(b))

        def cat(parts):
            if not parts:
                return np.zeros(0, np.int64), np.zeros(0, self.kind)
            return np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) if with_lcp else None)

        def lms_of(c):
            s, e = bounds[c], bounds[c + 1]
            return seeds[s:e], (lcp[s:e] if with_lcp else None)

        large = [cat(x) for x in run(range(self.alphabet), lms_of, False, join)]

        def falling(c):
            pos, val = large[c]
            if not len(pos) or not with_lcp:
                return pos[::-1], val
            return pos[::-1], np.append(0, val[:0:-1]).astype(self.kind)

        smalls = [cat(x) for x in run(range(self.alphabet - 1, -1, -1), falling, True, join)]
        order, values = [], []
        for c in range(self.alphabet):
            pos, val = large[c]
            spos, sval = smalls[c]
            if c == 0:  # the closing 0 is induced by nothing
                spos, sval = np.array([n - 1]), np.zeros(1, self.kind)
            spos = spos[::-1]
            order += [pos, spos]
            if with_lcp:
                sval = np.append(0, sval[:0:-1]).astype(self.kind) if len(spos) else sval
                if len(pos):
                    val = val.copy()
                    val[0] = 0
                    if len(spos):
                        sval[0] = join(pos[-1], spos[0])
                values += [val, sval]
        return np.concatenate(order), (np.concatenate(values) if with_lcp else None)

    def sorted_lms(self) -> np.ndarray:
        """The LMS suffixes in order (up to ``limit`` characters)."""
        lms = self.lms
        start = lms[np.argsort(self.t[lms], kind="stable")]
        order, _ = self.induce(start, None)
        number = np.full(len(self.t), -1)
        number[lms] = np.arange(len(lms))
        order = order[number[order] >= 0]
        # name the LMS substrings (up to the next LMS place) in their order
        end = np.append(lms[1:] + 1, len(self.t))
        h = self._hash().of(lms, end) ^ mix((end - lms).astype(np.uint64))
        k = number[order]
        new = np.ones(len(k), np.int64)
        new[1:] = h[k[1:]] != h[k[:-1]]
        name = np.empty(len(lms), np.int64)
        name[k] = np.cumsum(new)
        # rank the suffixes of the string of names, twice as far each time; LMS places are at
        # least two apart
        reach = 1
        while name.max() < len(name) and 2 * reach < self.limit:
            nxt = np.zeros(len(name), np.int64)
            nxt[:-reach or None] = name[reach:] if reach < len(name) else 0
            key = name * (len(name) + 1) + nxt
            by = np.argsort(key)
            new = np.ones(len(by), np.int64)
            new[1:] = key[by[1:]] != key[by[:-1]]
            name = np.empty(len(by), np.int64)
            name[by] = np.cumsum(new)
            reach *= 2
        return lms[np.argsort(name)]

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        seeds = self.sorted_lms()
        lcp = np.zeros(len(seeds), self.kind)
        lcp[1:] = self.common(seeds[:-1], seeds[1:])
        return self.induce(seeds, lcp)


def suffix_array(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (integers from 1 on; a closing 0 is added) in order, and the
    common-prefix value of each with the one before it, both up to ``limit``."""
    kind = np.int16 if not len(text) or text.max() < 1 << 15 else np.int64
    sa, lcp = Shard(np.append(text, 0).astype(kind), limit).suffix_array()
    return sa[1:], np.append(0, lcp[2:]).astype(np.int32) if len(sa) > 1 else lcp[1:]
