"""Hashed character n-grams of many texts at once, as arrays."""

from __future__ import annotations

import sys

import numpy as np

_MULTIPLIER = np.uint32(0x9E3779B1)


def _letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)


LETTERS = _letters()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, all but letters and digits as spaces, each text between spaces.

    The second array has the place at which each text begins, and the end.
    """
    parts = [t.lower() for t in texts]
    joined = " " + " ".join(parts) + " "
    points = np.frombuffer(joined.encode("utf-32-" + sys.byteorder[0] + "e", "replace"), np.uint32)
    plain = LETTERS[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.where(plain, points, np.uint32(32)), starts


def grams(points: np.ndarray, shortest: int, longest: int):
    """Yield, for each length, the places of n-grams inside words and their hashes.

    A word has its bounding spaces, so that the first and last characters differ
    from inner ones.
    """
    space = points == 32
    hashes = points.copy()
    inner = np.ones(len(points), bool)  # no space strictly between the ends
    for n in range(2, longest + 1):
        hashes = hashes[:-1] * _MULTIPLIER + points[n - 1 :]
        if n > 2:
            inner = inner[:-1] & ~space[n - 2 : -1]
        else:
            inner = ~(space[:-1] & space[1:])
        if n >= shortest:
            at = np.flatnonzero(inner)
            h = hashes[at] * np.uint32(n * 2 + 1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            yield at, h


def slices(sizes: list[int], most: int):
    """Ranges of neighbouring rows that hold at most ``most`` characters together, or one row."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
