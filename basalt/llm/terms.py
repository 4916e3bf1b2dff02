"""Hashes of the words of whole texts, in numpy, for any class of bytes that words are made of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from basalt.llm.shingles import SPACE, byte_codes, mix, powers

#: Bytes hashed at a time; a longer text is hashed in pieces that end between words.
PIECE = 1 << 18
#: Bytes of words: all but ASCII white space.
NOT_SPACE = ~SPACE
#: Bytes of terms: ASCII letters and digits, and all of other scripts.
LETTERS = np.array([x >= 0x80 or chr(x).isalnum() for x in range(256)])
AS_IS = np.arange(256, dtype=np.uint8)
#: A-Z as a-z.
LOWER = np.where((AS_IS >= 65) & (AS_IS <= 90), AS_IS + 32, AS_IS).astype(np.uint8)


def runs(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each run of member bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def pieces(text: bytes, member: np.ndarray) -> Iterator[bytes]:
    """The text in pieces of PIECE bytes or less that break no word; a longer word is a piece of its own."""
    at = 0
    while len(text) - at > PIECE:
        gaps = np.flatnonzero(~member[np.frombuffer(text, np.uint8, PIECE, at)])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            end = at + PIECE
            while end < len(text) and not len(gaps := np.flatnonzero(~member[np.frombuffer(text, np.uint8, min(PIECE, len(text) - end), end)])):
                end = min(len(text), end + PIECE)
            end += int(gaps[0]) + 1 if end < len(text) else 0
        yield text[at:end]
        at = end
    yield text[at:]


def hashed(texts: list[bytes], member: np.ndarray = NOT_SPACE, fold: np.ndarray = AS_IS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, number of its text) of each word, in order."""
    hashes, owners, held, of, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal held, of, size
        if held:
            b = fold[np.frombuffer(b"\n".join(held) + b"\n", np.uint8)]
            start, end = runs(b, member)
            up, down = powers(1 << max(16, len(b).bit_length()))
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(byte_codes()[b] * up[: len(b)], dtype=np.uint64, out=total[1:])
            hashes.append(mix((total[end] - total[start]) * down[start]))
            owners.append(np.array(of, np.int64)[np.searchsorted(np.cumsum([len(x) + 1 for x in held]), start, side="right")])
            held, of, size = [], [], 0

    for k, text in enumerate(texts):
        for piece in pieces(text, member):
            held.append(piece)
            of.append(k)
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges (a, b) of items that come to `most` bytes or a little more; a larger one is alone."""
    a = held = 0
    for b, size in enumerate(sizes):
        if b > a and held + size > most:
            yield a, b
            a, held = b, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)
