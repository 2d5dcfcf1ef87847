"""Array code for words, lines and windows of many texts at once.

Texts are held as one byte buffer (UTF-8, a newline after each text) with offsets.  A word is a
run of bytes outside the six ASCII white-space bytes, which is the same as the runs of
``[^\\x20\\x09-\\x0D]+`` over code points.  Hashes are polynomials over a random table modulo
2**64, taken from prefix sums so that a word or window costs a few array operations whatever
its length, and finished by a mixer.  Two different words collide with chance 2**-64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, np.bool_)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
SLICE = 1 << 19

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base & (2**64 - 1))
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x = x * U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a newline after each text; offsets has one more entry than texts."""
    data = [t or b"" for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(b"\n".join(data) + b"\n", np.uint8) if data else np.zeros(0, np.uint8), offsets


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    space = IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(buf) and not space[-1]:
        edge = np.concatenate((edge, [len(buf)]))
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint spans of the buffer."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
        hi = int(ends[j - 1])
        size = hi - lo
        sums = np.empty(size + 1, U64)
        sums[0] = 0
        np.cumsum(BYTE_CODE[buf[lo:hi]] * powers(BASE, size), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * powers(BASE_INVERSE, size + 1)[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive codes (len(codes)-width+1 of them)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        part = codes[lo : hi + width - 1]
        sums = np.empty(len(part) + 1, U64)
        sums[0] = 0
        np.cumsum(part * powers(BASE, len(part)), out=sums[1:])
        m = hi - lo
        out[lo:hi] = (sums[width : width + m] - sums[:m]) * powers(BASE_INVERSE, m)
    return mix(out)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position (positions ascending)."""
    counts = np.searchsorted(positions, offsets[1:], "left") - np.searchsorted(positions, offsets[:-1], "left")
    return np.repeat(np.arange(len(offsets) - 1), counts)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))
