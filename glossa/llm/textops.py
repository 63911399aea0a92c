"""Vectorised text primitives shared by the operators of this subpackage.

Texts are handled as arrays of code points, many documents at a time, so that splitting and hashing cost a few
numpy passes a character and no Python object a word. ``slices`` keeps the working set near ``CHUNK`` characters:
memory does not follow the batch, only the longest single document.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S31 = np.uint64(33), np.uint64(31)
_P = np.uint64((1 << 31) - 1)  # a prime modulus: modulo a power of two, polynomials have equal values at related words
_BASES = (1_483_920_637, 702_118_489)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (Unicode property) or other."""
    table = np.zeros(0x110000, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit murmur finaliser, elementwise; changes ``x``."""
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & _P) + (x >> _S31)
    x = (x & _P) + (x >> _S31)
    x -= (x >= _P) * _P
    return x


_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of a base modulo the prime."""
    p = _tables.get(base)
    if p is None or len(p) < n:
        p = np.ones(1, np.uint64)
        while len(p) < max(n, CHUNK + 1):
            p = np.append(p, _mod(p * np.uint64(pow(base, len(p), int(_P)))))
        _tables[base] = p
    return p[:n]


@functools.cache
def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of a base modulo 2**64, for the few places of an n-gram."""
    p = np.full(n, _B, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive groups of texts of about ``CHUNK`` characters, each with its first index; null is empty."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if group and size + len(t) > CHUNK:
            yield at, group
            at, group, size = i, [], 0
        group.append(t)
        size += len(t)
    if group:
        yield at, group


def codepoints(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts and the n+1 document offsets in them."""
    cps = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.cumsum([0, *map(len, group)])


def prefix_hash(cps: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the code points at two bases, for ``run_hash``."""
    v = cps.astype(np.uint64)
    v += np.uint64(1)
    out = np.zeros((2, len(cps) + 1), np.uint64)
    for row, base in zip(out, _BASES):
        x = v * _table(base, len(cps))
        low = x & _P
        x >>= _S31
        x += low  # below 2**32: sums of 2**31 signs fit, and the remainder is taken once a run
        np.cumsum(x, out=row[1:])
    return out


def run_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end); equal runs hash alike wherever they stand.

    Two polynomials modulo a prime and the length: unlike runs collide by chance only, and no more likely in long ones of few signs.
    """
    size, parts = prefix.shape[1], []
    for row, base in zip(prefix, _BASES):
        back = _table(pow(base, -1, int(_P)), size)
        parts.append(_mod(_mod(row[ends] - row[starts]) * back[starts]))
    h = (parts[0] << _S31 | parts[1]) ^ mix((ends - starts).astype(np.uint64))
    return mix(h)


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of equal ``kind`` inside each document."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    inner = offsets[(offsets < n)]
    new[inner] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def words(group: list[str], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words of a group of texts.

    Returns (hash, start, end, first, offsets): ``first[d]:first[d + 1]`` are the words of document d, starts and ends
    are code points in the joined texts, whose document offsets are ``offsets``.
    """
    if fold:
        group = [t.lower() for t in group]
    cps, offsets = codepoints(group)
    space = classes()[cps] == SPACE
    starts, ends = runs(space, offsets)
    keep = ~space[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    h = run_hash(prefix_hash(cps), starts, ends)
    return h, starts, ends, np.searchsorted(starts, offsets), offsets


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that start at each word, and whether the n-gram ends within its document."""
    size = len(h)
    g = np.zeros(size, np.uint64)
    p = powers(n)
    for j in range(n):
        g[: size - j] += h[j:] * p[j]
    fits = np.arange(size) + n <= np.repeat(first[1:], np.diff(first))
    return mix(g), fits
