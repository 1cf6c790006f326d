"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor. The substrings from each leftmost S position to
the next one are sorted by digits of 64 bits and named. While names repeat, the leftmost S suffixes are sorted by
recursion on the string of names. One induction a level then places all suffixes.

An induction reads the array once in each direction. It takes as one array operation the longest run of slots that
are filled by then: whatever they induce lands behind the run, so the order is that of a slot-by-slot scan and the
work of the induction is linear. Bytes give runs of whole buckets, long alphabets of names runs of about the root of the
slots read. Where runs stay short, as in one symbol repeated, slots are taken singly.
"""

from __future__ import annotations

import numpy as np

#: Runs of slots shorter than this are read slot by slot.
_SHORT = 24
#: Symbols are placed bucket by bucket where these hold more than so many on average.
_WIDE = 32


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; s ends with a unique smallest symbol."""
    n = len(s)
    # positions within a run of one symbol have the type of the run's end
    ends = np.flatnonzero(s[:-1] != s[1:])
    small = np.repeat(s[ends] < s[ends + 1], np.diff(ends, prepend=-1))
    return np.concatenate([small, np.ones(n - len(small), dtype=bool)])


def _place(sa: np.ndarray, filled: np.ndarray, at: np.ndarray, pos: np.ndarray, sym: np.ndarray, step: int) -> None:
    """Put positions, in order, at the free ends of their symbols' buckets; `at` are the next free slots."""
    m = len(sym)
    if sym.dtype.itemsize <= 2:
        order = np.argsort(sym, kind="stable")  # by digits
        sym = sym[order]
    else:
        # each with its place in one integer: these sort faster than places by their symbols
        order = sym << 32
        order |= np.arange(m)
        order.sort()
        sym = order >> 32
        order &= 0xFFFFFFFF
    pos = pos[order]
    new = np.empty(m, dtype=bool)
    new[0] = True
    np.not_equal(sym[1:], sym[:-1], out=new[1:])
    buckets = int(np.count_nonzero(new))
    if m > _WIDE * buckets:
        # few buckets: each gets a slice
        starts = np.flatnonzero(new).tolist()
        for i, j in zip(starts, [*starts[1:], m], strict=True):
            c = sym[i]
            k = int(at[c])
            low, part = (k, pos[i:j]) if step > 0 else (k - (j - i) + 1, pos[i:j][::-1])
            sa[low : low + j - i] = part
            filled[low : low + j - i] = True
            at[c] = k + step * (j - i)
        return
    slots = at[sym]
    if buckets < m:
        rank = np.arange(m)
        rank -= np.maximum.accumulate(rank * new)
        slots += step * rank
    sa[slots] = pos
    filled[slots] = True
    at[sym] = slots + step  # of a bucket's slots the last one counts


def _scan(s: np.ndarray, small: np.ndarray, sa: np.ndarray, filled: np.ndarray, at: np.ndarray, kind: bool) -> None:
    """Read the slots in order, from the right for S, and place each one's predecessor if it is of the kind."""
    n, step = len(sa), -1 if kind else 1
    ahead, typed = filled[::step], sa[::step]
    # by position the symbol before it, or 0, which precedes nothing, if that is of the other kind; the last entry is for
    # slots that hold -1
    before = np.zeros(n + 1, dtype=np.uint8 if len(at) <= 1 << 8 else np.uint16 if len(at) <= 1 << 16 else np.int64)
    np.copyto(before[1:n], s[:-1], where=small[:-1] == kind, casting="unsafe")
    low, width = 0, 64
    while low < n:
        run = ahead[low : low + width]
        free = int(run.argmin())
        high = low + (free if not run[free] else len(run))
        if high - low < _SHORT and high < n:
            high = min(low + 4 * _SHORT, n)
            for i in range(low, high):
                c = before[typed[i]]
                if c:
                    k = at[c]
                    sa[k], filled[k], at[c] = typed[i] - 1, True, k + step
        else:
            pos = typed[low:high]
            sym = before[pos]
            found = sym != 0
            pos, sym = pos.compress(found), sym.compress(found)
            if len(pos):
                pos -= 1
                _place(sa, filled, at, pos, sym, step)
        width = max(64, 4 * (high - low))
        low = high


def _induce(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order all suffixes from the order of `seeds`, leftmost S positions, at the ends of their buckets."""
    n = len(s)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    larges = np.bincount(s[~small], minlength=len(sizes))  # L suffixes of a bucket come before its S suffixes
    large = np.repeat(np.tile([True, False], len(sizes)), np.stack([larges, sizes - larges], axis=1).ravel())
    sa = np.full(n, -1, dtype=np.int64)
    filled = ~large
    sym = s[seeds]  # in order, as the seeds are
    slots = (ends - np.cumsum(np.bincount(sym, minlength=len(sizes))))[sym] + np.arange(len(seeds))
    sa[slots], filled[slots] = seeds, True
    _scan(s, small, sa, filled, heads.copy(), False)
    sa[~large] = -1
    # the last suffix is the smallest and precedes no other: its slot is known
    filled = large.copy()
    sa[0], filled[0] = n - 1, True
    _scan(s, small, sa, filled, ends - 1, True)
    return sa


def _sorted_pieces(s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the substrings from each leftmost S position to the next one, and which of them differ from the one
    before in that order.

    They are sorted by digits of as many symbols as 64 bits hold, ties by the next digit. One that ends is filled up with
    ones: of two that agree until one ends, the other has an L there and is smaller.
    """
    width = (int(s.max()) + 1).bit_length()
    per = 64 // width
    full = np.uint64(2 ** (per * width) - 1)
    ones = full >> (np.arange(per + 1, dtype=np.uint64) * np.uint64(width))  # by symbols left in a digit
    lens = np.diff(lms, append=len(s) - 1) + 1
    padded = np.concatenate([s, np.zeros(per, s.dtype)])

    def digit(items: np.ndarray | slice, done: int) -> np.ndarray:
        left = np.clip(lens[items] - done, 0, per)
        start = lms[items] + np.where(left > 0, done, 0)
        key = padded[start].astype(np.uint64)
        for i in range(1, per):
            key <<= np.uint64(width)
            key |= padded[start + i].astype(np.uint64)
        key |= ones[left]
        return key

    key = digit(slice(None), 0)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(lms), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    slots, done = np.arange(len(lms)), per
    while True:
        # groups of equal ones with a symbol left
        own = new[slots]
        tied = ~own
        tied[:-1] |= ~own[1:]
        slots = slots.compress(tied)
        items = order[slots]
        group = np.cumsum(own.compress(tied))
        left = np.zeros(len(slots) + 1, dtype=bool)
        left[group[lens[items] > done]] = True
        left = left[group]
        slots, items, group = slots.compress(left), items.compress(left), group.compress(left)
        if not len(slots):
            return order, new
        key = digit(items, done)
        by = np.lexsort((key, group))
        order[slots], key = items[by], key[by]
        new[slots[1:]] |= key[1:] != key[:-1]
        done += per


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s` in order. `s` holds non-negative integers and ends with a unique smallest one."""
    n = len(s)
    small, sizes = _types(s), np.bincount(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1)
    if not len(lms):
        return np.arange(n, dtype=np.int64)[::-1].copy()
    order, new = _sorted_pieces(s, lms)
    if not new.all():
        names = np.empty(len(lms), dtype=np.int64)
        names[order] = np.cumsum(new) - 1
        order = suffix_array(names)
    return _induce(s, small, sizes, lms[order])


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the prefix that its suffix shares with the one before it in order (0 for the first).

    Only irreducible positions are compared; any other has one less than the position before it.
    """
    n = len(s)
    before = np.empty(n, dtype=np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    # a position is reducible if its suffix and the one before it follow the same symbol
    reducible = np.zeros(n, dtype=bool)
    np.equal(s[:-1], s[before[1:] - 1], out=reducible[1:])
    reducible[before <= 0] = False
    a = np.flatnonzero(~reducible & (before >= 0))
    b = before[a]
    del before
    k = np.zeros(len(a), dtype=np.int64)
    # 64 bits at a time: two suffixes differ where the shorter one ends at the latest
    top = int(s.max()).bit_length()
    size = next(i for i in (1, 2, 4, 8) if top <= 8 * i)
    narrow = np.concatenate([s, np.zeros(8, s.dtype)]).astype(f"<u{size}")
    words = np.ndarray((n,), "<u8", narrow, strides=(size,)).astype(np.uint64)
    live, x, y = np.arange(len(a), dtype=np.int64), a, b
    while len(live):
        other = words[x]
        other ^= words[y]
        same = other == 0
        k[live] += np.bitwise_count((other - np.uint64(1)) & ~other) >> 2 + size.bit_length()
        live, x, y = live.compress(same), x.compress(same) + 8 // size, y.compress(same) + 8 // size
    del words
    # the last irreducible position at or before each, and what is left of its prefix
    lcp = np.zeros(n, dtype=np.int64)
    if len(a):
        lcp[a[0] :] = np.repeat(k + a, np.diff(a, append=n)) - np.arange(a[0], n, dtype=np.int64)
    lcp[sa[0]] = 0
    return np.maximum(lcp, 0, out=lcp)
