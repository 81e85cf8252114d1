"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Suffixes are classified as larger or smaller than their successor. The leftmost smaller ones (LMS) are sorted
by their substrings, named, and where names repeat the string of names is sorted the same way. Two scans over the
buckets then induce the order of all suffixes in linear time, at each level. With few symbols a scan takes a bucket at
a time: all that a bucket induces into later buckets is placed by one stable counting sort; what it induces into itself
(runs of one symbol) follows as a further step of that bucket. Strings of many names (more than ``WIDE``) have buckets
too small for that; there the same scans go suffix by suffix.
"""

from __future__ import annotations

import numpy as np

WIDE = 2048


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the last one is)."""
    step = np.ones(len(t), np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    at = np.where(step != 0, np.arange(len(t), dtype=np.int32), np.int32(len(t)))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order induced from the LMS suffixes, given in theirs."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    ends = count.cumsum()
    starts = ends - count
    sa = np.full(n, -1, np.int32)
    first = t[lms]
    lms_start = ends - np.bincount(first, minlength=sigma)
    order = np.argsort(first, kind="stable")
    rank = np.arange(len(lms)) - np.concatenate([[0], np.bincount(first, minlength=sigma).cumsum()[:-1]])[first[order]]
    sa[lms_start[first[order]] + rank] = lms[order]

    def grouped(batch: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        j = batch[batch > 0] - 1
        j = j[small[j] == want]
        if not len(j):
            return None
        c = t[j]
        o = np.argsort(c, kind="stable")
        c, j = c[o], j[o]
        per = np.bincount(c, minlength=sigma)
        return c, j, np.arange(len(j)) - (per.cumsum() - per)[c], per

    used = np.flatnonzero(count).tolist()
    head = starts.copy()
    for c in used:
        low = starts[c]
        while low < head[c]:
            high = head[c]
            if got := grouped(sa[low:high], False):
                sa[head[got[0]] + got[2]] = got[1]
                head += got[3]
            low = high
        if lms_start[c] < ends[c] and (got := grouped(sa[lms_start[c] : ends[c]], False)):
            sa[head[got[0]] + got[2]] = got[1]
            head += got[3]
    tail = ends.copy()
    for c in reversed(used):
        high = ends[c]
        while high > tail[c]:
            low = tail[c]
            if got := grouped(sa[low:high][::-1], True):
                sa[tail[got[0]] - 1 - got[2]] = got[1]
                tail -= got[3]
            high = low
        if starts[c] < head[c] and (got := grouped(sa[starts[c] : head[c]][::-1], True)):
            sa[tail[got[0]] - 1 - got[2]] = got[1]
            tail -= got[3]
    return sa


def _induce_each(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """What :func:`_induce` gives, a suffix at a time: for strings of so many symbols that most buckets hold few."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    ends = count.cumsum()

    def induces(want: bool) -> list[int]:
        """By suffix the bucket of the one before it, if that is of the wanted type; else -1. The last entry is for empty places."""
        out = np.full(n + 1, -1, np.int64)
        out[1:n] = np.where(small[:-1] == want, t[:-1].astype(np.int64), -1)
        return out.tolist()

    first = t[lms]
    order = np.argsort(first, kind="stable")
    per = np.bincount(first, minlength=sigma)
    places = np.full(n, n, np.int64)
    places[(ends - per)[first[order]] + np.arange(len(lms)) - (per.cumsum() - per)[first[order]]] = lms[order]
    sa, at, bucket = places.tolist(), (ends - count).tolist(), induces(False)
    for i in sa:  # grows ahead of the scan
        c = bucket[i]
        if c >= 0:
            a = at[c]
            sa[a] = i - 1
            at[c] = a + 1
    at, bucket = ends.tolist(), induces(True)
    for i in reversed(sa):
        c = bucket[i]
        if c >= 0:
            a = at[c] = at[c] - 1
            sa[a] = i - 1
    return np.array(sa, np.int32)


def _words(t: np.ndarray, per: int = 4) -> np.ndarray:
    """So many symbols (4 of 16 bits, 2 of 32) from each place on, as one number; symbols after the end are 0."""
    n = len(t)
    p = np.zeros(n + per, np.uint64)
    p[:n] = t
    out = p[:n].copy()
    for i in range(1, per):
        out = (out << np.uint64(64 // per)) | p[i : n + i]
    return out


def _same(t: np.ndarray, per: int, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether t[a : a + size] == t[b : b + size]."""
    words, out = _words(t, per), np.ones(len(a), bool)
    live, at = np.arange(len(a)), 0
    while len(live):
        cut = (64 // per * np.maximum(0, per - (size[live] - at))).astype(np.uint64)
        ok = (words[a[live] + at] >> cut) == (words[b[live] + at] >> cut)
        out[live[~ok]] = False
        at += per
        live = live[ok & (size[live] > at)]
    return out


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Of non-negative integers under sigma; the last is 0 and occurs nowhere else."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint16 if sigma <= 1 << 16 else np.int32)
    induce = _induce if sigma <= WIDE else _induce_each
    small = _types(t)
    is_lms = np.zeros(len(t), bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        sa = induce(t, sigma, small, lms)
        by_part = sa[is_lms[sa]]
        follows = np.zeros(len(t), np.int32)
        follows[lms[:-1]], follows[lms[-1]] = lms[1:], lms[-1]
        size = follows[by_part] - by_part + 1
        differs = size[1:] != size[:-1]
        check = np.flatnonzero(~differs)
        differs[check] = ~_same(t, 4 if sigma <= 1 << 16 else 2, by_part[1:][check], by_part[:-1][check], size[1:][check])
        name = np.zeros(len(t), np.int32)
        name[by_part] = np.concatenate([[0], differs.cumsum()])
        names = name[lms]
        n_names = int(names.max()) + 1
        lms = by_part if n_names == len(lms) else lms[suffix_array(names, n_names)]
    return induce(t, sigma, small, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, length) for each place: the suffix before it in the array, and how many symbols both share, at most left of either.

    Where the symbols before both are equal the length is one less than at the place before; only the
    other places are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=np.int32)
    derived = (before > 0) & (place > 0)
    derived[1:] &= (t[:-1] == t[before[1:] - 1]) & (left[:-1] > 0) & (before[:-1] == before[1:] - 1)
    fixed = np.flatnonzero(~derived).astype(np.int32)
    length = np.zeros(n, np.int32)
    a = fixed[before[fixed] >= 0]
    b = before[a]
    limit = np.minimum(left[a], left[b])
    words, got = _words(t), np.zeros(len(a), np.int32)
    live, at = np.arange(len(a)), 0
    while len(live):
        x = words[a[live] + at] ^ words[b[live] + at]
        step = np.where(x == 0, 4, np.where(x < 1 << 16, 3, np.where(x < 1 << 32, 2, np.where(x < 1 << 48, 1, 0)))).astype(np.int32)
        got[live] = np.minimum(at + step, limit[live])
        at += 4
        live = live[(step == 4) & (limit[live] > at)]
    length[a] = got
    root = np.zeros(n, np.int32)
    root[fixed] = fixed
    root = np.maximum.accumulate(root)
    return before, length[root] - (place - root)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, left): bytes as 2 to 257, 1 after each part, 0 at the end; and the bytes left of the part at each place."""
    sizes = np.array([len(p) for p in parts], np.int64)
    total = int(sizes.sum()) + len(parts) + 1
    t = np.ones(total, np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(total, bool)
    inside[ends] = inside[-1] = False
    t[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 2
    t[-1] = 0
    stop = np.where(inside, total, np.arange(total))
    return t, (np.minimum.accumulate(stop[::-1])[::-1] - np.arange(total)).astype(np.int32)


def repeated_places(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part which of its places start a string of this length that starts at another place of any part too."""
    t, left = joined(parts)
    before, shared = common_prefixes(t, suffix_array(t, 258), left)
    hit = np.flatnonzero(shared >= length)
    flag = np.zeros(len(t), bool)
    flag[hit] = flag[before[hit]] = True
    ends = np.cumsum([len(p) + 1 for p in parts])
    return [flag[e - len(p) - 1 : e - 1] for p, e in zip(parts, ends.tolist(), strict=True)]
