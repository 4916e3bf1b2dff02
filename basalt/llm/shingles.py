"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

import functools

import numpy as np

#: Bytes hashed at a time; a longer text is hashed in pieces cut at white space.
PIECE = 1 << 17
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@functools.cache
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x2127599BF4325C37
    one = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)))
    return one(base), one(pow(base, -1, 1 << 64))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of data, at most PIECE bytes and a little more."""
    b = np.frombuffer(data, np.uint8)
    room = 1 << max(16, len(b).bit_length())
    up, down = powers(room)
    word = ~SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.append(np.uint64(0), np.cumsum(byte_codes()[b] * up[: len(b)], dtype=np.uint64))
    return mix((total[end] - total[start]) * down[start]), start


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word; A-Z count as a-z."""
    hashes, owners, held, of, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal held, of, size
        if held:
            h, start = hash_words(b"".join(held))
            ends = np.cumsum([len(x) for x in held])
            hashes.append(h)
            owners.append(np.array(of, np.int64)[np.searchsorted(ends, start, side="right")])
        held, of, size = [], [], 0

    for k, text in enumerate(texts):
        text = text.lower()
        at = 0
        while len(text) - at > PIECE:
            cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut < at:  # one word longer than a piece: it ends where the next white space is
                found = [p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := text.find(c, at + PIECE)) >= 0]
                if not found:
                    break
                cut = min(found)
            flush()
            held, of = [text[at : cut + 1]], [k]
            flush()
            at = cut + 1
        held.append((text[at:] if at else text) + b"\n")
        of.append(k)
        size += len(held[-1])
        if size >= PIECE:
            flush()
    flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words; of fewer words, the whole as one; none without words."""
    h, owner = words_of(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    joined = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(joined)]
    joined = mix(joined)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = np.uint64((int(x) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mix(np.array([x], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
