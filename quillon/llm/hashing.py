"""Hashes of words, in numpy.

Polynomials modulo a power of two collide on some regular strings whatever their base, so nothing that decides a
result uses them: words of up to LONG bytes go through a chain of bijective mixes, eight bytes at a time, and longer
ones through BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string start and end: runs of bytes other than the six ASCII spaces."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~((s == 0x20) | (s >= 9) & (s <= 13)), [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_codes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word of a byte string."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    data = np.concatenate([s, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(s) + 1, "<u8", data, 0, (1,))
    own, k = np.flatnonzero(size <= LONG), 0
    while len(own := own[size[own] > k]):
        left = np.minimum(size[own] - k, 8).astype(np.uint64)
        part = eights[starts[own] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[own] = mixed(out[own] ^ part)
        k += 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(s[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def digests(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each substring, as two numbers each."""
    blake = hashlib.blake2b
    out = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)
