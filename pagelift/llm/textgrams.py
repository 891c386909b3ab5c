"""Hashed character n-grams and words of many texts at once, in numpy."""

from __future__ import annotations

import unicodedata

import numpy as np

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x7FEB352D], np.uint32)


_LETTERS_END = 0x323B0  # after the last assigned letters
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point a lower-case letter, or a blank for what is no letter; the last entry is for all above."""
    table = np.full(_LETTERS_END + 1, 32, np.uint32)
    for c in range(_LETTERS_END):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = ord(chr(c).lower()[0])
    return table


def lower_letters(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, a blank for each other character."""
    if "letters" not in _tables:
        _tables["letters"] = _letters()
    return _tables["letters"][np.minimum(points, _LETTERS_END)]


def lower_all(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, a blank for each control character, and the other characters."""
    low = lower_letters(points)
    return np.where(low != 32, low, np.maximum(points, 32))


def hashed(points: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hashes in [0, 2^bits) of the n-grams of ``size`` points that start at each place (the last ones wrap)."""
    with np.errstate(over="ignore"):
        total = points * _MIX[0]
        for k in range(1, size):
            total[:len(points) - k] += points[k:] * _MIX[k]
        total ^= total >> np.uint32(15)
        total *= _MIX[5] + np.uint32(2 * size)
        return total >> np.uint32(32 - bits)


# ---------------------------------------------------------------- words
#: Bytes that stand in words, a random value for each byte, and an odd base with its inverse modulo 2^64.
_INSIDE = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
_OF_BYTE = np.random.default_rng(13).integers(1, 2 ** 63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return values ^ values >> np.uint64(32)


def _powers(size: int, base: int) -> np.ndarray:
    """base^0 ... base^(size - 1), modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(max(size - 1, 0), base, np.uint64)))[:size]


def word_hashes(texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word of the texts, and the text that it is in, some ``limit`` bytes (or a whole text) at a time."""
    values, owners, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= limit):
            size += len(texts[stop])
            stop += 1
        value, owner = _word_hashes(texts[at:stop])
        values.append(value)
        owners.append(owner + at)
        at = stop
    return np.concatenate(values), np.concatenate(owners)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash is a polynomial over random values of the word's bytes, as a difference of running sums moved back to its start."""
    joined = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    inside = _INSIDE[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(_OF_BYTE[joined] * _powers(len(joined), _BASE)))
        value = (sums[ends] - sums[starts]) * _powers(len(joined), _BACK)[starts]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return mixed(value), np.searchsorted(first, starts, side="right") - 1
