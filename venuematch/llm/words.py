"""Words and 64-bit word hashes. A word is a run of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import numpy as np

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E6C63D0876A9A47)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; kept for the next text."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
            for base in (_BASE, _INVERSE)
        )
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of UTF-8 text."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash a word."""
    return span_hashes(data, *word_spans(data))


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a span of bytes: a polynomial of them, taken from running sums over the text."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hash of each window of the given lengths, from doubled windows; a shorter text has no window."""
    doubled, size = {1: hashes}, 1
    while 2 * size <= max(lengths):
        x = doubled[size]
        doubled[2 * size] = x[:-size] * _power(size) + x[size:] if len(x) > size else x[:0]
        size *= 2
    out = {}
    for length in lengths:
        total, done = None, 0
        for size in sorted(doubled, reverse=True):
            if done + size <= length:
                part = doubled[size][done:]
                if total is None:
                    total = part
                else:
                    n = min(len(total), len(part))
                    total = total[:n] * _power(size) + part[:n]
                done += size
        n = len(hashes) - length + 1
        out[length] = mix(total[:n]) if n > 0 else hashes[:0]
    return out


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start up to its end, from running sums."""
    powers, inverses = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))
