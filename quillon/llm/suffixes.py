"""Suffix arrays by induced sorting, and permuted common prefixes.

Positions are classified by whether their suffix is smaller or larger than the next one. The leftmost-smaller
positions are sorted by their substrings, the substrings get names, the string of names is sorted recursively, and
all other suffixes are induced from that order in two linear scans. For byte strings the scans go by whole bucket
chunks in numpy; names of deeper levels, of which there are too many for that, go one by one.
"""

from __future__ import annotations

import numpy as np

#: Up to so many different symbols the scans go by chunks of a bucket.
FEW = 512


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of the suffixes of s (whole numbers below `symbols`) in order; the end counts as the smallest symbol."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    s = np.ascontiguousarray(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_chunks if symbols <= FEW else _induce_single
    if not len(lms):
        return induce(s, symbols, small, lms)
    rough = induce(s, symbols, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = rough[is_lms[rough]]
    names, count = _names(s, lms, by_substring)
    if count < len(lms):
        by_substring = lms[suffix_array(names, count)]
    return induce(s, symbols, small, by_substring)


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one."""
    n = len(s)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    step[-1] = -1
    differs = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(differs[::-1])[::-1]] > 0


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings between leftmost-smaller positions, in text order, equal for equal substrings."""
    n, m = len(s), len(lms)
    rank = np.empty(n + 1, np.int64)
    rank[lms] = np.arange(m)
    length = np.append(np.diff(lms), n - lms[-1])[rank[ordered]]
    a, b = ordered[:-1], ordered[1:]
    # The last substring ends with the end of the text and so equals no other.
    same = (length[:-1] == length[1:]) & (rank[a] != m - 1) & (rank[b] != m - 1)
    open_ = np.flatnonzero(same)
    d = 0
    while len(open_) and d < 64:
        equal = s[a[open_] + d] == s[b[open_] + d]
        same[open_[~equal]] = False
        open_ = open_[equal]
        d += 1
        open_ = open_[length[open_] >= d]
    for k in open_:
        size = length[k] + 1
        same[k] = np.array_equal(s[a[k] : a[k] + size], s[b[k] : b[k] + size])
    name = np.zeros(m, np.int64)
    name[1:] = np.cumsum(~same)
    out = np.empty(m, np.int64)
    out[rank[ordered]] = name
    return out, int(name[-1]) + 1


def _induce_chunks(s: np.ndarray, symbols: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    count = np.bincount(s, minlength=symbols)
    end = np.cumsum(count)
    head, tail = end - count, end.copy()
    start = head.copy()
    sa = np.empty(n, np.int64)
    symbol = s[lms]
    order = np.argsort(symbol, kind="stable")
    by_bucket = lms[order]
    bounds = np.searchsorted(symbol[order], np.arange(symbols + 1))

    def place(found: np.ndarray, want: bool, up: bool) -> None:
        before = found[found > 0] - 1
        before = before[small[before] == want]
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        c, before = c[order].astype(np.int64), before[order]
        many = np.bincount(c, minlength=symbols)
        first = np.cumsum(many) - many
        k = np.arange(len(c)) - first[c]
        if up:
            sa[head[c] + k] = before
            head[:] += many
        else:
            sa[tail[c] - 1 - k] = before
            tail[:] -= many

    place(np.array([n]), False, True)
    for c in np.flatnonzero(count):
        done = start[c]
        while done < head[c]:
            chunk = sa[done : head[c]].copy()
            done = head[c]
            place(chunk, False, True)
        place(by_bucket[bounds[c] : bounds[c + 1]], False, True)
    for c in np.flatnonzero(count)[::-1]:
        done = end[c]
        while done > tail[c]:
            chunk = sa[tail[c] : done][::-1].copy()
            done = tail[c]
            place(chunk, True, False)
        place(sa[start[c] : head[c]][::-1].copy(), True, False)
    return sa


def _induce_single(s_: np.ndarray, symbols: int, small_: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s_)
    s, small = s_.tolist(), small_.tolist()
    count = np.bincount(s_, minlength=symbols)
    end = np.cumsum(count)
    head, tail = (end - count).tolist(), end.tolist()
    sa = [-1] * n
    for p in reversed(lms.tolist()):
        c = s[p]
        tail[c] -= 1
        sa[tail[c]] = p
    p = n - 1
    sa[head[s[p]]] = p
    head[s[p]] += 1
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = s[p]
            sa[head[c]] = p
            head[c] += 1
    tail = end.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = s[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return np.asarray(sa, np.int64)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, lengths): for each position the one that stands before it in sa (-1 for the first), and their common prefix.

    Only where the symbols in front differ is a prefix measured, up to `most`; elsewhere it is one less than the
    position before has. fresh: positions that are measured in any case. Lengths are right up to `most` less the
    distance to the last measured position.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    measured = fresh.copy()
    measured[0] = True
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    measured[inner] |= s[inner - 1] != s[before[inner] - 1]
    measured |= before <= 0
    lengths = np.zeros(n, np.int64)
    buffer = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray(n + 1, "<u8", buffer, 0, (1,))
    i = np.flatnonzero(measured & (before >= 0))
    j, k = before[i], 0
    while len(i) and k < most:
        room = n - np.maximum(i, j)
        x = words[np.minimum(i + k, n)] ^ words[np.minimum(j + k, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        lengths[i] = np.minimum(k + same, room)
        go = (same == 8) & (k + 8 < room)
        i, j = i[go], j[go]
        k += 8
    at = np.where(measured, np.arange(n), 0)
    last = np.maximum.accumulate(at)
    return before, np.maximum(lengths[last] - (np.arange(n) - last), 0)
