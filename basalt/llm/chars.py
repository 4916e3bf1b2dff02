"""Texts as arrays of character codes, for the models that read characters."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters per step: bounds the memory of array work. A longer text is read in pieces that end outside a word.
STEP = 1 << 17
#: Where a piece may end if no white space is near.
OUTSIDE = re.compile(r"[\W_]")


@functools.cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; is it a letter or digit."""
    every = [chr(i) for i in range(0x110000)]
    return np.array([c.isalpha() for c in every]), np.array([c.isalnum() for c in every])


def steps(texts: pa.Array, size: int | None = None) -> Iterator[tuple[list[int], list[str], bool]]:
    """(row numbers, texts, does the first go on with the last text before?) of about `size` characters at a time.

    Null counts as empty. Long texts come in pieces, each the last of its step but for the last piece. A piece ends
    behind a character that belongs to no word; if there is none within `size` characters, it goes on to the next.
    """
    size = size or STEP
    rows: list[int] = []
    parts: list[str] = []
    held, goes_on = 0, False
    for row, value in enumerate(texts):
        text = value.as_py() or ""
        at = 0
        while True:
            end = len(text)
            if end - at > size:
                end = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
                if end <= at:
                    found = OUTSIDE.search(text, at + size)
                    end = found.end() if found else len(text)
            rows.append(row)
            parts.append(text[at:end])
            held += end - at
            at = end
            if held >= size or at < len(text):
                yield rows, parts, goes_on
                rows, parts, held, goes_on = [], [], 0, at < len(text)
            if at >= len(text):
                break
    if rows:
        yield rows, parts, goes_on


def runs(parts: list[str], digits: bool, lead: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, part of each code, first code of each part): lower-cased letters (and digits), every run of others as one 0.

    Each part begins with `lead` zeros; a part that ends in a letter gets a 0 at its end. If the first part goes on
    with a text, `before` are the last codes of what came before it, which take the place of its zeros.
    """
    joined = "".join("\n" * (lead + 1) + p + "\n" for p in parts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(p.lower()) for p in parts), np.int64, len(parts)) + lead + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = kinds()[1 if digits else 0][codes]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    for k in range(lead):
        keep[starts + k] = True
    part = np.repeat(np.arange(len(parts)), lengths)[keep]
    found = np.where(inside, codes, 0)[keep].astype(np.uint64)
    if before is not None:
        found[:lead] = before[len(before) - lead :]
    return found, part, np.searchsorted(part, np.arange(len(parts)))
