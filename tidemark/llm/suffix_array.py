"""Suffix sorting and threshold-bounded common prefixes of a set of strings, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of strings in a byte array; ``room`` is the distance of each place to its string's end.

    Prefix doubling from eight bytes on; only suffixes that are not told apart yet are sorted
    again. Ends come before all bytes, differ from each other and go by place, so no order depends on
    what follows an end.
    """
    n = len(text)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = text
    for j in (1, 2, 4):
        key[:-j] = (key[:-j] << np.uint64(8 * j)) | key[j:]
    key = key[:n]
    short = np.flatnonzero(room < 8)
    gone = (8 * (8 - room[short])).astype(np.uint64)
    whole = gone == 64
    gone[whole] = 0
    key[short] = np.where(whole, np.uint64(0), key[short] >> gone << gone)
    sa = np.argsort(key).astype(np.int32)
    k = key[sa]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    del key, k
    head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[sa] = head
    alone = new.copy()
    alone[:-1] &= new[1:]
    todo = np.flatnonzero(~alone).astype(np.int32)
    h = 8
    while len(todo):
        p = sa[todo]
        # suffixes that end within the h bytes of their group: the sooner the smaller, then by place
        ended = room[p] < h
        second = rank[np.minimum(p + h, n - 1)] + np.int64(h + 1) * n
        if ended.any():
            second = np.where(ended, room[p].astype(np.int64) * n + p, second)
        group = rank[p]
        both = group * (np.int64(h + 3) * n) + second
        order = np.argsort(both)
        p, both, group = p[order], both[order], group[order]
        sa[todo] = p
        new = np.ones(len(todo), bool)
        new[1:] = both[1:] != both[:-1]
        head = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo), dtype=np.int32), 0))]
        rank[p] = head
        alone = new.copy()
        alone[:-1] &= new[1:]
        todo = todo[~alone]
        h *= 2
    return sa, rank


def short_prefixes(sym: np.ndarray, sa: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """Common prefix lengths of neighbours in the suffix array, as far as they are under ``least``; -1 elsewhere.

    Breadth-first: the intervals of all strings of one length are extended backwards together, by each
    symbol that the Burrows-Wheeler transform has in them. The end of an extended interval, where no
    length stands yet, gets the length of the string extended; lengths come out by increasing value
    and the search stops at ``least``.
    """
    n = len(sa)
    before = np.where(sa > 0, sym[np.maximum(sa, 1) - 1], 0).astype(np.int32)  # the transform; 0: nothing before
    back = np.where(sa > 0, rank[np.maximum(sa, 1) - 1], 0).astype(np.int32)
    # runs of the transform; starts of strings are runs of their own that are never extended
    edge = np.ones(n, bool)
    edge[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    run_of = np.cumsum(edge, dtype=np.int32) - 1
    first = np.flatnonzero(edge).astype(np.int32)
    last = np.append(first[1:], np.int32(n)) - np.int32(1)
    kind = before[first]
    by = np.argsort(kind.astype(np.int64) * len(kind) + np.arange(len(kind))).astype(np.int32)
    earlier, later = np.full(len(kind), -1, np.int32), np.full(len(kind), n, np.int32)
    same = kind[by][1:] == kind[by][:-1]
    earlier[by[1:][same]] = by[:-1][same]
    later[by[:-1][same]] = by[1:][same]

    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    ends = int((sym == 0).sum())
    lcp[1 : ends + 1] = 0  # ends differ from all else
    head = sym[sa]
    starts = np.flatnonzero(np.diff(head[ends:])) + ends + 1
    lcp[starts] = 0
    lo = np.concatenate((np.arange(ends), [ends] if ends < n else [], starts)).astype(np.int32)
    hi = np.concatenate((np.arange(ends), starts - 1, [n - 1] if ends < n else [])).astype(np.int32)
    for length in range(1, least):
        if not len(lo):
            break
        a, b = run_of[lo], run_of[hi]
        single = a == b
        one = single & (kind[a] > 0)
        left, right = [back[lo[one]]], [back[hi[one]]]
        many = np.flatnonzero(~single)
        if len(many):
            count = b[many] - a[many] + 1
            which = np.repeat(many, count)
            run = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a[many], count)
            real = kind[run] > 0
            which, run = which[real], run[real]
            starts_here = earlier[run] < a[which]
            ends_here = later[run] > b[which]
            s, e = run[starts_here], run[ends_here]
            sw, ew = which[starts_here], which[ends_here]
            so, eo = np.argsort(sw.astype(np.int64) * 512 + kind[s]), np.argsort(ew.astype(np.int64) * 512 + kind[e])
            left.append(back[np.maximum(first[s], lo[sw])[so]])
            right.append(back[np.minimum(last[e], hi[ew])[eo]])
        lo, hi = np.concatenate(left), np.concatenate(right)
        fresh = lcp[hi + 1] < 0
        lo, hi = lo[fresh], hi[fresh]
        lcp[hi + 1] = length
    return lcp[:n]


def repeated_places(strings: list[bytes], weights: list[int], window: int) -> list[np.ndarray]:
    """For each string the places where a window starts that starts elsewhere as well, in any of the strings.

    A string of weight two or more stands in the corpus that many times: all its windows repeat.
    """
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    sizes = np.array([len(s) for s in strings])
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    sym = text.astype(np.uint16) + np.uint16(1)
    sym[end] = 0
    room = (np.repeat(end, sizes + 1) - np.arange(len(text))).astype(np.int32)
    sa, rank = suffix_array(text, room)
    lcp = short_prefixes(sym, sa, rank, window)
    deep = lcp < 0
    hit = deep.copy()
    hit[:-1] |= deep[1:]
    mark = np.zeros(len(text), bool)
    mark[sa[hit]] = True
    heavy = np.repeat(np.array(weights) > 1, sizes + 1)
    mark |= heavy & (room >= window)
    where = np.flatnonzero(mark)
    cut = np.searchsorted(where, begin), np.searchsorted(where, end)
    return [where[x:y] - b for x, y, b in zip(*cut, begin, strict=True)]
