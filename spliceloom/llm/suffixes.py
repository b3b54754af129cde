"""Suffix array of an integer text by linear grouping of suffixes."""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """Start positions of the suffixes of ``text`` in order; the end is smaller than any symbol.

    Phase 1 groups suffixes by their longest Lyndon prefix. Groups start as the
    suffixes of one first symbol and are processed from the largest down. The
    nearest position before each member that lies in a smaller group (its
    previous-smaller pointer) gains that member's prefix: such positions leave
    their group for new groups right above it, ordered by how many members they
    gain. Positions passed on the way are skipped by their own pointers.

    Phase 2 goes through the order as it is found. The suffixes whose Lyndon
    prefix ends where the current suffix begins are its predecessor and the
    predecessor's pointers down to the current suffix's own; each takes the next
    place of its group. So all groups are ordered in one pass, and no text is
    renamed or sorted again.
    """
    n = len(text)
    if not n:
        return []
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(starts, n))
    first_of = np.empty(n, dtype=np.int64)
    first_of[order] = np.repeat(starts, sizes)
    group = first_of.tolist()  # where a suffix's group begins
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    at = place.tolist()  # where a suffix stands
    row = order.tolist()  # suffixes by place
    size = dict(zip(starts.tolist(), sizes.tolist()))
    smaller = [-1] * n

    end = n
    while end:
        begin = group[row[end - 1]]
        gains: dict[int, int] = {}
        for i in row[begin:end] if end - begin == 1 else sorted(row[begin:end]):
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                gains[p] = gains.get(p, 0) + 1
        end = begin
        if len(gains) == 1:
            rounds = [list(gains)]
        else:
            by_gain: dict[int, list[int]] = {}
            for p, g in gains.items():
                by_gain.setdefault(g, []).append(p)
            rounds = [by_gain[g] for g in sorted(by_gain, reverse=True)]
        for moved in rounds:
            for p in moved:
                old = group[p]
                last = old + size[old] - 1
                size[old] -= 1
                a, other = at[p], row[last]
                row[a], row[last] = other, p
                at[other], at[p] = a, last
            for p, new in [(p, group[p] + size[group[p]]) for p in moved]:
                group[p] = new
                size[new] = size.get(new, 0) + 1
        # A group that lost all members has size 0, and the lowest of its new groups begins where it did.

    nxt = {g: g for g in set(group)}
    out = [-1] * n
    j = n - 1
    while j >= 0:
        g = group[j]
        out[nxt[g]] = j
        nxt[g] += 1
        j = smaller[j]
    for k in range(n):
        i = out[k]
        j, stop = i - 1, smaller[i]
        while j > stop:
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
            j = smaller[j]
    return out
