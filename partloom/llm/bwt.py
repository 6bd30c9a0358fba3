"""Repeated strings of a minimum length, by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_array(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and each one's common prefix with the one before, up to seven symbols.

    Symbol 0 separates; each separator is unique and ordered by its place."""
    n = len(sym)
    until = np.full(n, 7, np.int8)
    key, seen = np.zeros(n, np.int64), np.zeros(n, bool)
    padded = np.concatenate([sym, np.zeros(7, sym.dtype)]).astype(np.int64)
    for k in range(7):
        s = padded[k : k + n]
        until[(s == 0) & ~seen] = k
        seen |= s == 0
        key = (key << 9) | np.where(seen, 0, s)
    order = np.argsort(key)
    tied = np.flatnonzero(seen[order])  # equal up to a separator: by place
    order[tied] = order[tied][np.lexsort((order[tied], key[order[tied]]))]
    sorted_key = key[order]
    apart = sorted_key[1:] ^ sorted_key[:-1]
    common = np.zeros(n, np.int8)
    for k in range(7):
        common[1:] += apart < 1 << 9 * k
    common = np.minimum(common, until[order])
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | seen[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_ = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    h = 7
    while len(open_):
        pos = order[open_]
        key = rank[pos] * n + rank[pos + h]
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[open_] = pos
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[pos] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        open_ = open_[~fresh | np.append(~fresh[1:], False)]
        h *= 2
    return order, common


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after the other."""
    return np.repeat(start - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(int(size.sum()), dtype=np.int32)


def repeated(segments: list[bytes], least: int) -> list[np.ndarray]:
    """For each segment, which of its ``least``-byte strings also start at another place of any segment.

    Row r of the transform has a common prefix of l with the row before it. Going up in l, the rows where a prefix
    of exactly l ends split their intervals; preceding each split by every byte on both of its sides gives the
    rows whose prefix is l + 1, and only the smaller parts of a split need looking at. At ``least`` the search
    stops: rows that no split has reached begin with a string of that length that the row before begins with too.
    """
    if not segments:
        return []
    size = np.array([len(s) for s in segments], np.int64)
    end = np.cumsum(size + 1) - 1  # each segment's separator
    sym = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    sym[end] = 0
    n = len(sym)
    order, common = suffix_array(sym)
    last = sym[order - 1]  # the transform; order 0 wraps to a separator
    by_char = np.argsort(last, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # row of the suffix one byte longer
    step[by_char] = np.arange(n, dtype=np.int32)
    level = min(6, least - 1)  # prefixes up to here are known from packed symbols
    known = np.ones(n + 1, bool)
    known[:n] = common <= level
    known[0] = True
    old = np.flatnonzero(common < level).astype(np.int32)
    old = old if len(old) and old[0] == 0 else np.append(np.int32(0), old)
    fresh = np.flatnonzero(common == level).astype(np.int32)
    fresh = fresh[fresh > 0]
    parts = len(old)
    begin, stop = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    begin[:parts], stop[:parts] = old, np.append(old[1:], np.int32(n))
    part = np.repeat(np.arange(parts, dtype=np.int32), stop[:parts] - old)
    for _ in range(level, least - 1):
        if not len(fresh):
            break
        parent = _distinct(part[fresh])
        starts = np.sort(np.concatenate([begin[parent], fresh]))
        own = part[starts]
        ends = np.append(starts[1:], np.int32(n))
        tail = np.append(own[1:] != own[:-1], True)
        ends[tail] = stop[own[tail]]
        length = ends - starts
        by = np.lexsort((length, own))
        largest = by[np.append(own[by][1:] != own[by][:-1], True)]
        small = np.ones(len(starts), bool)
        small[largest] = False
        begin[own[largest]], stop[own[largest]] = starts[largest], ends[largest]
        new = np.arange(parts, parts + int(small.sum()), dtype=np.int32)
        parts += len(new)
        begin[new], stop[new] = starts[small], ends[small]
        rows = _ranges(starts[small], length[small])
        part[rows] = np.repeat(new, length[small])
        char = last[rows]
        up, own = step[rows], part[rows]
        a = np.flatnonzero((char != 0) & ~known[up])
        before = by_char[up[a] - 1]
        a = up[a][(last[before] == char[a]) & (part[before] != own[a])]
        up += 1
        b = np.flatnonzero((char != 0) & ~known[up])
        after = by_char[up[b]]
        b = up[b][(last[after] == char[b]) & (part[after] != own[b])]
        fresh = _distinct(np.concatenate([a, b]))
        known[fresh] = True
    same = np.flatnonzero(~known[:n])
    hit = np.zeros(n, bool)
    hit[order[same]] = True
    hit[order[same - 1]] = True
    return [hit[e - s : e - s + max(0, s - least + 1)] for s, e in zip(size.tolist(), end.tolist(), strict=True)]
