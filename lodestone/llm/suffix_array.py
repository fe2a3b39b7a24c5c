"""Suffix arrays by linear grouping.

Phase one groups suffixes by their Lyndon prefix (the longest prefix that is a Lyndon word).  Groups start as symbols and are processed in
descending order.  Each suffix of a group points to the last earlier suffix of a lower group, its previous smaller
one; the suffixes pointed to continue with the group's word, as often as they are pointed to, and so move to groups
of their own above the rest of theirs.  Phase two walks the order from the least suffix: the suffixes whose Lyndon prefix ends where a placed
suffix begins are that suffix's left neighbour and, from there, the previous-smaller pointers; each goes to the
next free place of its group.  Nothing is renamed or solved recursively, and each pointer is set once.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence of non-negative integers; a suffix that is a prefix of another is less."""
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    group = np.empty(n, np.int64)
    group[order] = begin
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size = np.zeros(n + 1, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    sa, group, place, size = order.tolist(), group.tolist(), place.tolist(), size.tolist()
    before = [-1] * n

    end = n - 1
    while end > 0:
        start = group[sa[end]]
        if start == end:  # a group of one, the usual case
            s = sa[end]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = group[p]
                left = size[g] - 1
                if left:
                    last = g + left
                    at, other = place[p], sa[last]
                    sa[at], place[other] = other, at
                    sa[last], place[p] = p, last
                    size[g], size[last], group[p] = left, 1, last
            end -= 1
            continue
        pointed: dict[int, int] = defaultdict(int)
        for s in sorted(sa[start : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] += 1
        by_count: dict[int, list[int]] = defaultdict(list)
        for p, c in pointed.items():
            by_count[c].append(p)
        for c in sorted(by_count, reverse=True):
            moved = by_count[c]
            for p in moved:  # to the end of what is left of its group
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                at, other = place[p], sa[last]
                sa[at], place[other] = other, at
                sa[last], place[p] = p, last
            targets = [group[p] + size[group[p]] for p in moved]
            for p, to in zip(moved, targets, strict=True):
                group[p] = to
                size[to] += 1
        end = start - 1

    out, free, placed = [0] * n, group, [False] * n
    next_place = list(range(n))  # of the group that starts there
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = free[s]
            out[next_place[g]] = s
            next_place[g] += 1
            placed[s] = True
            s = before[s]
    return np.array(out[1:], np.int64)
