"""Vector work on the bytes of many texts at once: class runs, word hashes, n-gram codes."""

from __future__ import annotations

import numpy as np

#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 20), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums that span() turns into hashes of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0] if len(data) else data.astype(np.uint64), out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range [start, end) that depends on its bytes alone."""
    return mixed((pre[end] - pre[start]) * powers(len(pre))[1][start])


def lookup(classes: list[tuple[int, int, int]]) -> np.ndarray:
    """Table from byte to class; (first, last, class) ranges, class 0 elsewhere."""
    out = np.zeros(256, np.uint8)
    for lo, hi, c in classes:
        out[lo : hi + 1] = c
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def class_runs(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, class, row) of each maximal run of one nonzero class inside one row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint8), z
    c = table[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:])
    inner = off[1:-1]
    edge[inner[inner < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    keep = c[start] != 0
    start, end = start[keep], end[keep]
    return start, end, c[start], np.searchsorted(off, start, "right") - 1


#: Bytes of one text that are worked on at once; the work arrays take some hundred times as much.
CHUNK = 1 << 19


def tokens(data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of a class. A single long text is cut between runs, so memory stays bounded."""
    if len(data) <= CHUNK or len(off) > 2:
        data = LOWER[data] if lower else data
        start, end, _, row = class_runs(data, off, table)
        return span(prefix(data), start, end), row
    out, at = [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data):
            c = table[data[to - 1 : to + CHUNK]]
            edge = np.flatnonzero(c[1:] != c[:-1])
            if len(edge):
                to += int(edge[0])
                break
            to = min(to + CHUNK, len(data))
        out.append(tokens(data[at:to], np.array([0, to - at, to - at]), table, lower)[0])
        at = to
    h = np.concatenate(out)
    return h, np.zeros(len(h), np.int64)
