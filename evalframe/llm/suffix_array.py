"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Positions are classified as larger (L) or smaller (S) than what follows; the
leftmost S positions of each run (LMS) cut the text into substrings. These are
sorted by induction, named, and the string of names is sorted recursively
unless all names differ; the order of the LMS positions then induces that of
all others. Induction goes bucket by bucket with whole arrays for small
alphabets; entries that fall in the bucket being read follow in waves. For the
names of inner levels, whose buckets are nearly empty, it goes entry by entry.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last character is a unique least sentinel."""
    n = len(s)
    differs = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    at = differs[np.searchsorted(differs, np.arange(n))]  # the end of each run of equal characters
    small = np.ones(n, bool)
    inner = at < n - 1
    small[inner] = s[at[inner]] < s[at[inner] + 1]
    return small


def _induce_waves(s: np.ndarray, small: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    n, k = len(s), len(count)
    ends = np.cumsum(count)
    starts = ends - count
    sa = np.full(n, -1, np.int64)
    # LMS positions at the ends of their buckets, in the given order
    chars = s[lms]
    order = np.argsort(chars, kind="stable")
    each = np.bincount(chars, minlength=k)
    lms_sorted, lms_from = lms[order], np.cumsum(each) - each
    head = starts.copy()
    tops: list[np.ndarray] = []

    def feed(entries: np.ndarray, want: bool) -> list[tuple[int, np.ndarray]]:
        """Previous positions of the wanted type, by bucket, in order."""
        prev = entries[entries > 0] - 1
        prev = prev[small[prev] == want]
        if not len(prev):
            return []
        c = s[prev]
        o = np.argsort(c, kind="stable")
        prev, c = prev[o], c[o]
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        return [(int(c[i]), prev[i:j]) for i, j in zip(cuts, np.append(cuts[1:], len(c)))]

    for b in range(k):
        if not count[b]:
            tops.append(np.zeros(0, np.int64))
            continue
        lo = starts[b]
        while lo < head[b]:  # waves of L entries of this bucket
            hi = head[b]
            for c, p in feed(sa[lo:hi], False):
                sa[head[c] : head[c] + len(p)] = p
                head[c] += len(p)
            lo = hi
        own = lms_sorted[lms_from[b] : lms_from[b] + each[b]]
        for c, p in feed(own, False):
            sa[head[c] : head[c] + len(p)] = p
            head[c] += len(p)
    # S entries from the right; L entries are in place, LMS ones are found anew
    tail = ends.copy()
    for b in range(k - 1, -1, -1):
        if not count[b]:
            continue
        hi = ends[b]
        while hi > tail[b]:  # waves of S entries
            lo = tail[b]
            for c, p in feed(sa[lo:hi][::-1], True):
                sa[tail[c] - len(p) : tail[c]] = p[::-1]
                tail[c] -= len(p)
            hi = lo
        for c, p in feed(sa[starts[b] : head[b]][::-1], True):
            sa[tail[c] - len(p) : tail[c]] = p[::-1]
            tail[c] -= len(p)
    sa[0] = n - 1
    return sa


def _induce_steps(s: np.ndarray, small: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    n = len(s)
    ends = np.cumsum(count)
    starts = (ends - count).tolist()
    text, smaller = s.tolist(), small.tolist()
    sa = [-1] * n
    tail = ends.tolist()
    for p in lms[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = list(starts)
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not smaller[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and smaller[p]:
            c = text[p]
            tail[c] -= 1
            sa[tail[c]] = p
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _sort(s: np.ndarray, k: int) -> np.ndarray:
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms)
    count = np.bincount(s, minlength=k)
    induce = _induce_waves if k <= 512 else _induce_steps
    sa = induce(s, small, lms, count)
    # LMS substrings in order; neighbours are the same name if they have equal length and characters
    order = sa[is_lms[sa]]
    stop = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = stop - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    step = 0
    while len(at):
        going = step < length[a[at]]
        at = at[going]
        bad = s[a[at] + step] != s[b[at] + step]
        same[at[bad]] = False
        at = at[~bad]
        step += 1
    name = np.append(0, np.cumsum(~same))
    names = np.zeros(n, np.int64)
    names[order] = name
    inner = names[lms]
    if len(order) and name[-1] + 1 < len(order):
        lms = lms[_sort(inner, int(name[-1]) + 1)]
    else:
        lms = order
    return induce(s, small, lms, count)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of integers from 1 to k - 1; a sentinel 0 is added and left out of the result."""
    return _sort(np.append(s.astype(np.int64), 0), k)[1:]


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position: the suffix before it in order (-1 for the first), and how many characters they share.

    A position whose left neighbour goes on a match of its own shares one character less than that neighbour;
    only the others are compared, many at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    has = before >= 0
    prior = np.where((before > 0) & (np.arange(n) > 0), s[np.maximum(before, 1) - 1], -1)
    goes_on = has & (before > 0)
    goes_on[1:] &= prior[1:] == s[:-1]
    goes_on[0] = False
    start = np.flatnonzero(~goes_on)
    shared = np.zeros(n, np.int64)
    at = start[has[start]]
    done = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    padded = np.append(s, [-1])
    while len(live):
        i, j = at[live] + done[live], before[at[live]] + done[live]
        ok = (i < n) & (j < n)
        ok &= padded[np.minimum(i, n)] == padded[np.minimum(j, n)]
        live = live[ok]
        done[live] += 1
    shared[at] = done
    origin = np.zeros(n, np.int64)
    origin[start] = start
    origin = np.maximum.accumulate(origin)
    return before, np.maximum(shared[origin] - (np.arange(n) - origin), 0)
