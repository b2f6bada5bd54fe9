"""Words and shingles of many texts at once, as 64-bit hashes held in numpy arrays."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)

    def row(b: int) -> np.ndarray:
        out = np.full(n, b, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return row(base), row(inverse)


@lru_cache(maxsize=4)
def _tables(kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it part of a word, and its random coefficient."""
    part = np.ones(256, bool)
    if kind == "space":  # words are [^\x20\x09-\x0D]+
        part[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":  # words are digits, ASCII letters and everything beyond ASCII
        part[:0x80] = False
        part[0x30:0x3A] = part[0x41:0x5B] = part[0x61:0x7B] = True
    else:
        raise ValueError(f"unknown kind of words: {kind}")
    value = mix(np.arange(1, 257, dtype=U) * _ODD) | U(1)
    if lower:
        value[0x41:0x5B] = value[0x61:0x7B]
    return part, value


class Words(NamedTuple):
    """Words of a batch: hash, first and one-past-last byte of each, and where each document's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = False, seed: int = 0, hashed: bool = True) -> Words:
    """The words of all texts in ``data``. Equal words have equal hashes; a word never crosses two texts."""
    part, value = _tables(kind, lower)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = part[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    stops = inside[:-1] & ~inside[1:]
    cut = edge[edge > 0] - 1
    stops[cut] = inside[cut]
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    hashes = np.zeros(len(starts) if hashed else 0, U)
    i = 0
    while hashed and i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        size = _SPAN if b - a <= _SPAN else 1 << int(b - a).bit_length()
        power, inverse = _powers(size + 1, 0x2545F4914F6CDD1D + 2 * seed)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(value[data[a:b]] * power[: b - a], out=sums[1:])
        s = starts[i:j] - a
        hashes[i:j] = (sums[ends[i:j] - a] - sums[s]) * inverse[s]
        i = j
    return Words(mix(hashes), starts, ends, first)


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive entries, whatever text they are in; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 8:
        out = np.zeros(n, U)
        for i, c in enumerate(mix(np.arange(1, k + 1, dtype=U) * _ODD + U(seed))):
            out += hashes[i : i + n] * (c | U(1))
        return mix(out)
    power, inverse = _powers(1 << max(16, int(len(hashes)).bit_length()), 0xD1342543DE82EF95 + 2 * seed)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the entries begin..end-1 for each pair, the length included."""
    power, inverse = _powers(1 << max(16, int(len(hashes)).bit_length()), 0xDA942042E4DD58B5 + 2 * seed)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U) * _ODD)


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct ``k``-word shingles; a shorter text is one shingle, one without words has none."""
    runs = run_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix(run_hashes(words.hashes[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
