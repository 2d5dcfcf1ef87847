"""Suffix arrays over packed codes.

A suffix is known by its first ``depth`` codes (0: past the end), packed ``per`` to a number in
as many numbers as it takes, so that numbers compare as the suffixes do."""

from __future__ import annotations

import numpy as np

from .textcodes import U64


def per_number(bits: int) -> int:
    return 63 // bits


def pack(code: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The numbers of the suffixes at ``start``; ``code`` is long enough for start + depth, and
    codes from ``length`` on count as 0."""
    out = []
    per = per_number(bits)
    for lo in range(0, max(depth, 1), per):
        key = np.zeros(len(start), U64)
        for i in range(lo, lo + per):
            key <<= U64(bits)
            if i < depth:
                key |= np.where(i < length, code[start + i], 0).astype(U64)
        out.append(key)
    return out


def rolling(code: np.ndarray, per: int, bits: int) -> np.ndarray:
    """The number of the ``per`` codes from each place on; codes past the end count as 0."""
    have, width = code, 1
    done = np.zeros(len(code), U64)
    got, left = 0, per
    while left:  # by doubling: numbers of 1, 2, 4 ... codes make up those of per codes
        if left & 1:
            moved = np.zeros(len(code), U64)
            moved[: len(code) - got] = have[got:]
            done = (done << U64(bits * width)) | moved
            got += width
        left >>= 1
        if left:
            wider = have << U64(bits * width)
            wider[: len(code) - width] |= have[width:]
            have, width = wider, 2 * width
    return done


def rolling_rows(code: np.ndarray, per: int, bits: int) -> np.ndarray:
    """The number of each row of codes, whose missing columns count as 0."""
    out = np.zeros(len(code), U64)
    for i in range(per):
        out <<= U64(bits)
        if i < code.shape[1]:
            out |= code[:, i].astype(U64)
    return out


def order_of(keys: list[np.ndarray]) -> np.ndarray:
    """By the first number; suffixes that agree in it are ordered by the next ones."""
    if len(keys) == 1:
        return np.argsort(keys[0], kind="stable")
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = np.zeros(len(order) + 1, np.bool_)
    same[1:-1] = first[1:] == first[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    rows = order[tied]
    order[tied] = rows[np.lexsort([*(k[rows] for k in keys[:0:-1]), first[tied]])]
    return order


def _bisect(key: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value inside its own ascending range [low, high) of key."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        found = key[middle]
        up = found <= value[live] if right else found < value[live]
        low[live[up]] = middle[up] + 1
        high[live[~up]] = middle[~up]
        live = live[low[live] < high[live]]
    return low


def lookup(keys: list[np.ndarray], wanted: list[np.ndarray], lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted run of ``lengths`` codes, the range [low, high) of the suffix array whose
    suffixes start with it, by binary search one number at a time."""
    per = per_number(bits)
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(keys[0]), np.int64)
    for level, key in enumerate(keys):
        here = np.clip(lengths - level * per, 0, per)
        active = np.flatnonzero((here > 0) & (high > low))
        least = wanted[level][active]
        most = least | ((U64(1) << ((per - here[active]) * bits).astype(U64)) - U64(1))
        if level:
            low[active], high[active] = _bisect(key, least, low[active], high[active], False), _bisect(key, most, low[active], high[active], True)
        else:
            low[active], high[active] = np.searchsorted(key, least, "left"), np.searchsorted(key, most, "right")
    return low, high


def spread_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, place in it) for each place of the non-empty ranges."""
    found = np.flatnonzero(high > low)
    sizes = (high - low)[found]
    ends = np.cumsum(sizes)
    places = np.repeat(low[found] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    return np.repeat(found, sizes), places
