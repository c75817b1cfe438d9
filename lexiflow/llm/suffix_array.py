"""Suffix arrays by induced sorting, as array operations, and permuted common prefixes.

Suffixes are classified as smaller or larger than their right neighbour. Leftmost smaller suffixes are sorted by
their substrings, which is the same problem on a shorter string, solved recursively by the same method; all other
suffixes follow by one induction from left to right for larger and one from right to left for smaller ones. An
induction runs over blocks of neighbouring buckets: what a finished block induces is appended to later buckets at
once, and what it induces inside itself is ordered by ranking each suffix by its symbol and the rank of its inducer.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 12  # suffixes of a block of buckets; one bucket may have more
DEPTH = 24  # steps of induction inside a block beyond which it is halved
# Positions have 32 bits: shards hold far less than 2 GB.


def _append(out, fill, s, at):
    """Put suffixes ``at`` (in order) at the free ends of their symbols' buckets; fill moves on."""
    sym = s[at]
    if len(at) == 1:
        out[fill[sym[0]]] = at[0]
        fill[sym[0]] += 1
        return
    order = np.argsort(sym, kind="stable")
    at, sym = at[order], sym[order]
    first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    size = np.diff(np.concatenate([first, [len(sym)]]))
    out[np.repeat(fill[sym[first]] - first, size) + np.arange(len(sym))] = at
    fill[sym[first]] += size


def _inside(s, own, got, roots, last):
    """Suffixes of one block of buckets in order (``got``: appended before; own ones come before roots in a bucket), or
    None if induction inside the block goes too deep."""
    found, by, cur, index, total = [], [], np.concatenate([got, roots]), np.arange(len(got) + len(roots)), len(got) + len(roots)
    while True:
        on = cur > 0
        cur, index = cur[on] - 1, index[on]
        on = own[cur] & (s[cur] < last)
        cur, index = cur[on], index[on]
        if not len(cur):
            break
        if len(found) == DEPTH:
            return None
        found.append(cur)
        by.append(index)
        index = np.arange(total, total + len(cur))
        total += len(cur)
    every = np.concatenate([got, roots, *found])
    part = np.ones(total, np.int64)
    part[: len(got)], part[len(got) : len(got) + len(roots)] = 0, 2
    key = s[every].astype(np.int64) * 3 + part
    second = np.arange(total)
    inducer, first = np.concatenate([np.zeros(0, np.int64), *by]), len(got) + len(roots)
    while True:
        both = key * total + second
        order = np.argsort(both, kind="stable")
        x = both[order]
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], x[1:] != x[:-1]]))
        if not len(found) or np.array_equal(rank[inducer], second[first:]):
            return every[order]
        second[first:] = rank[inducer]


def _pass(s, k, own, roots, start):
    """The suffixes in ``own``, by symbol, as induced from left to right: from ``start`` (or None), and from ``roots``,
    which are in order and come behind the own ones of their bucket."""
    size = np.bincount(s[own], minlength=k)
    head = np.concatenate([[0], np.cumsum(size)])
    cut = np.concatenate([[0], np.cumsum(np.bincount(s[roots], minlength=k))])
    out, fill = np.full(head[-1], -1, np.int32), head[:-1].copy()
    if start is not None:
        _append(out, fill, s, np.array([start]))
    both, c = head + cut, 0

    def beyond(j, last):
        j = j[j > 0] - 1
        j = j[own[j]]
        j = j[s[j] >= last]
        if len(j):
            _append(out, fill, s, j)

    def single(c):
        at = head[c]
        while at < fill[c]:  # a run of one symbol induces itself step by step
            j = out[at : fill[c]]
            at = fill[c]
            beyond(j, c)
        beyond(roots[cut[c] : cut[c + 1]], c)

    def block(c, stop):
        if stop == c + 1:
            return single(c)
        got = out[head[c] : head[stop]]
        done = _inside(s, own, got[got >= 0], roots[cut[c] : cut[stop]], stop)
        if done is None:
            block(c, (c + stop) // 2)
            return block((c + stop) // 2, stop)
        out[head[c] : head[stop]] = done[own[done]]
        beyond(done, stop)

    while c < k:
        stop = max(c + 1, int(np.searchsorted(both, both[c] + BLOCK, side="right")) - 1)
        block(c, stop)
        c = stop
    return out


def _induce(s, k, small, lms):
    """All suffixes in order, from the leftmost smaller ones in order (``small``: the smaller suffixes)."""
    n = len(s)
    large = _pass(s, k, ~small, lms, n - 1)
    tiny = _pass(k - 1 - s, k, small, large[::-1], None)[::-1]  # the same from the right, with symbols turned round
    below = np.concatenate([[0], np.cumsum(np.bincount(s[tiny], minlength=k))])
    upto = np.cumsum(np.bincount(s[large], minlength=k))
    sa = np.empty(n, np.int32)
    sa[np.arange(len(large)) + below[s[large]]] = large
    sa[np.arange(len(tiny)) + upto[s[tiny]]] = tiny
    return sa


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of all suffixes of ``s`` (integers under ``symbols``) in order; a prefix sorts first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int16 if symbols < 1 << 15 else np.int32)  # 16-bit symbols are sorted by radix
    differ = np.flatnonzero(s[1:] != s[:-1])
    # A suffix is smaller than the next one iff the next different symbol is greater.
    small = np.zeros(n, dtype=bool)
    small[: differ[-1] + 1 if len(differ) else 0] = np.repeat(s[differ] < s[differ + 1], np.diff(np.concatenate([[-1], differ])))
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        # Order of the substrings between leftmost smaller suffixes: one induction from any order by symbol.
        rough = _induce(s, symbols, small, lms[np.argsort(s[lms], kind="stable")])
        is_lms = np.zeros(n + 1, dtype=bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        number = np.cumsum(is_lms[:n])  # of the leftmost smaller suffix at or before a position, from 1
        stop = np.append(lms, n - 1)[number[order]]  # a substring ends with the next one's first symbol
        size = stop - order + 1
        same = np.zeros(len(order), dtype=bool)
        live = np.flatnonzero((size[1:] == size[:-1]) & (stop[1:] != n - 1) & (stop[:-1] != n - 1)) + 1
        step = 0
        while len(live):
            done = step >= size[live]
            same[live[done]] = True
            live = live[~done]
            live = live[s[order[live] + step] == s[order[live - 1] + step]]
            step += 1
        name = np.cumsum(~same) - 1
        if name[-1] + 1 < len(lms):
            short = np.empty(n + 1, dtype=np.int32)
            short[order] = name
            lms = lms[suffix_array(short[lms], int(name[-1]) + 1)]
        else:
            lms = order
    return _induce(s, symbols, small, lms)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, how many symbols its suffix shares with the one before it in the
    suffix array.

    From one position to the next the number falls by one at most, and by just one where both suffixes follow equal
    symbols. So symbols are compared only where they do not (the sum of those prefixes is n log n at most); all other
    positions follow by one running maximum.
    """
    n, wide = len(s), 7
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.zeros(n, dtype=np.int64)  # seven symbols of 9 bits; past the end no symbol
    for j in range(wide):
        word <<= 9
        word[: max(0, n - j)] |= s[j:].astype(np.int64) + 1
    follows = np.zeros(n, dtype=bool)
    at = np.arange(1, n)
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (s[at - 1] == s[np.maximum(before[1:], 1) - 1])
    live = np.flatnonzero((before >= 0) & ~follows)
    out = np.zeros(n, dtype=np.int64)
    ends, step = [], 0
    while len(live):
        p, q = live + step, before[live] + step
        on = (p < n) & (q < n)
        ends.append(live[~on])
        live, p, q = live[on], p[on], q[on]
        same = word[p] == word[q]
        # A word that reaches past the end equals no other, since the other one goes on.
        ends.append(live[~same])
        live = live[same]
        step += wide
        out[live] = step
    live = np.concatenate(ends) if ends else live
    for _ in range(wide):
        p, q = live + out[live], before[live] + out[live]
        on = (p < n) & (q < n)
        live, p, q = live[on], p[on], q[on]
        live = live[s[p] == s[q]]
        out[live] += 1
    place = np.arange(n)
    run = np.maximum.accumulate(np.where(follows, 0, out + place)) - place
    return np.where(before >= 0, run, 0)
