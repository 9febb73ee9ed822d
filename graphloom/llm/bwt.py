"""Repeated strings of a fixed least length, from a Burrows-Wheeler transform of many short texts.

Common prefixes of neighbouring suffixes are found by increasing value, breadth first. Values under PACK are
seen in the packed symbols that suffixes are first sorted by. From there on the intervals of all strings of
one length are extended backward by every symbol that stands before them, and an interval goes on only if
its right end is a boundary not met before. At the least length the search stops: neighbours without a
boundary between them share at least so many bytes.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # symbols of 9 bits in a word


def suffixes(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``t`` (symbols below 512) ordered by at least ``depth`` symbols from there on, cyclically, and where the first PACK (or ``depth``) of them differ from the place before.

    After the packed symbols only places that still tie are sorted again, each time by twice as many symbols.
    """
    n, have = len(t), min(PACK, depth)
    around = np.concatenate((t, t[:have])).astype(np.uint64)
    key = around[:n].copy()
    for i in range(1, have):
        key <<= np.uint64(9)
        key |= around[i : i + n]
    order = np.argsort(key)  # the order of equal strings does not matter
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    edge = first.copy()
    group = np.maximum.accumulate(np.where(edge, np.arange(n), 0))  # the first place of strings alike so far
    rank = np.empty(n, np.int64)
    rank[order] = group
    while have < depth:
        tied = ~edge
        tied[:-1] |= ~edge[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        where = order[at]
        ahead = where + have
        ahead[ahead >= n] %= n
        key = group[at] * n + rank[ahead]
        by = np.argsort(key)
        order[at], key = where[by], key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        edge[at] = new
        group[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = group[at]
        have *= 2
    return order, first


def boundaries(t: np.ndarray, order: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """For each place in ``order``: whether the common prefix with the place before is shorter than ``least``. ``first``: of ``suffixes``.

    Symbol 0 separates texts and is never extended over, so the answer holds between suffixes with no 0 in
    their first ``least`` symbols.
    """
    n, i32 = len(t), np.int32
    last = t[order - 1]  # the symbol before each suffix
    by = np.argsort(last, kind="stable").astype(i32)
    lf = np.empty(n, i32)
    lf[by] = np.arange(n, dtype=i32)
    before, after = np.full(n, -1, i32), np.full(n, n, i32)
    same = last[by[1:]] == last[by[:-1]]
    before[by[1:][same]], after[by[:-1][same]] = by[:-1][same], by[1:][same]
    found = np.append(first, True)
    lo = np.flatnonzero(first).astype(i32)
    hi = np.append(lo[1:], i32(n))
    for _ in range(least - PACK):
        if not len(lo):
            break
        alone = hi - lo == 1
        one = lo[alone]
        one = lf[one[last[one] > 0]]
        lo, hi = lo[~alone], hi[~alone]
        size = hi - lo
        start = np.cumsum(size, dtype=i32) - size
        owner = np.repeat(np.arange(len(lo), dtype=i32), size)
        at = np.arange(len(owner), dtype=i32) - np.repeat(start - lo, size)
        ok = last[at] > 0
        head = ok & (before[at] < np.repeat(lo, size))
        final = ok & (after[at] >= np.repeat(hi, size))
        f, g = at[head], at[final]
        f = f[np.argsort(owner[head].astype(np.int64) * 512 + last[f])]
        g = g[np.argsort(owner[final].astype(np.int64) * 512 + last[g])]
        lo, hi = np.concatenate((lf[f], one)), np.concatenate((lf[g], one)) + i32(1)
        new = ~found[hi]
        lo, hi = lo[new], hi[new]
        found[hi] = True
    return found[:n]


def least_owner(texts: list[bytes], owners: np.ndarray, least: int) -> np.ndarray:
    """For every text and every start of a string of ``least`` bytes in it, one after the other: the least owner of a text that has the string."""
    size = np.array([len(x) for x in texts])
    t = np.zeros(int(size.sum()) + len(texts), np.uint16)
    start = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    t[:] = text
    t += 1
    t[start + size] = 0
    order, first = suffixes(t, least)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    left = np.repeat(start + size, size + 1) - np.arange(len(t))  # bytes up to the separator
    valid = (left >= least)[order]
    edge = boundaries(t, order, first, least)
    edge |= ~valid
    edge[1:] |= ~valid[:-1]
    who = owners[owner[order]]
    at = np.flatnonzero(edge)
    low = np.minimum.reduceat(who, at)
    out = np.empty(len(t), owners.dtype)
    out[order] = np.repeat(low, np.diff(np.append(at, len(t))))
    return out[left >= least]
