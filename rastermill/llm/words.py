"""Words and shingles of many texts at once, as 64-bit hashes in arrays.

A word is a run of anything but ASCII white space. Its hash is a polynomial over random values of
its bytes, read off one running sum over a stretch of bytes and mixed; equal words have equal hashes
in every task. Stretches are bounded, and a word may go on in the next one, so a text of any length
takes its words' hashes and a fixed amount besides.
"""

from __future__ import annotations

import numpy as np

#: Random values for the 256 byte values and the polynomial's base, from a seeded generator.
VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Others, for a second hash that doesn't depend on the first.
OTHER_VALUES = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
ALL = (1 << 64) - 1
#: Bytes hashed at once; the arrays for it take some fifty bytes each.
STRETCH = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the output."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        at = 1
        while at < size:
            step = min(at, size - at)
            have[at : at + step] = have[:step] * np.uint64(pow(base, at, 1 << 64))
            at += step
        _powers[base] = have
    return have[:n]


def sums(data: np.ndarray, fold_case: bool, values: np.ndarray = VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polynomials, starts, ends) of the words in a stretch of bytes; a polynomial isn't mixed yet."""
    if fold_case:
        data = FOLD[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~GAP[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    running = np.concatenate(([np.uint64(0)], np.cumsum(values[data] * powers(BASE, len(data)), dtype=np.uint64)))
    return (running[ends] - running[starts]) * powers(INVERSE, len(data) + 1)[starts], starts, ends


def long_text(raw: bytes, fold_case: bool = False, stretch: int = STRETCH, values: np.ndarray = VALUES) -> np.ndarray:
    """The words' hashes of one text of any length, stretch by stretch."""
    out: list[np.ndarray] = []
    begun, size = np.zeros(1, np.uint64), 0  # the word that the last stretch ended in
    for at in range(0, len(raw), stretch):
        poly, starts, ends = sums(np.frombuffer(raw, np.uint8, min(stretch, len(raw) - at), at), fold_case, values)
        n = min(stretch, len(raw) - at)
        length = ends - starts
        if size and len(starts) and starts[0] == 0:
            poly[:1] = begun + poly[:1] * np.uint64(pow(BASE, size, 1 << 64))
            length[0] += size
        elif size:
            poly, length, ends = np.append(begun, poly), np.append(size, length), np.append(-1, ends)
        if len(ends) and ends[-1] == n:
            begun, size = poly[-1:], int(length[-1])
            poly, length = poly[:-1], length[:-1]
        else:
            begun, size = begun[:0], 0
        out.append(mixed(poly + length.astype(np.uint64)))
    if size:
        out.append(mixed(begun + np.uint64(size)))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def words(raw: list[bytes], fold_case: bool = False, values: np.ndarray = VALUES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of all texts, and where each text's begin (one more than texts)."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(raw) + 1, np.int64)
    at = 0
    while at < len(raw):
        if len(raw[at]) > STRETCH:
            found.append(long_text(raw[at], fold_case, STRETCH, values))
            counts[at + 1] = len(found[-1])
            at += 1
            continue
        stop, size = at, 0
        while stop < len(raw) and len(raw[stop]) <= STRETCH and (stop == at or size + len(raw[stop]) <= STRETCH):
            size += len(raw[stop]) + 1
            stop += 1
        some = raw[at:stop]
        poly, starts, ends = sums(np.frombuffer(b" ".join([*some, b""]), np.uint8), fold_case, values)
        places = np.concatenate(([0], np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)))
        counts[at + 1 : stop + 1] = np.diff(np.searchsorted(starts, places))
        found.append(mixed(poly + (ends - starts).astype(np.uint64)))
        at = stop
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.cumsum(counts)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; faster than np.unique's hash table for what documents hold."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def runs(hashes: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The hash of each `width` hashes in a row; shorter input has none."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + hashes[k : len(hashes) - width + 1 + k]
    return mixed(out)


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Like runs(), by one running sum: for wide windows."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes)), powers(pow(base, -1, 1 << 64), len(hashes))
    running = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up, dtype=np.uint64)))
    return mixed((running[width:] - running[:n]) * down[:n])
