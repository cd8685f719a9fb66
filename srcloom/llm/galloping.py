"""Sorted lists of whole numbers: galloping search, and what is built on it.

A gallop looks for each needle near the place it would have if both lists were evenly spread, doubles its step until
the needle is bracketed and halves the bracket. All needles go at once, so a round is one numpy operation; the rounds
are few where the lists are alike and at most twice the binary logarithm of the longer list.
"""

from __future__ import annotations

import numpy as np


def gallop(needles: np.ndarray, hay: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """For each needle the place of the first element of the sorted ``hay`` that is not smaller.

    ``start`` are places to begin at, any will do; both may be empty and hold equal values."""
    n = len(hay)
    if not n or not len(needles):
        return np.zeros(len(needles), np.int64)
    if start is None:
        start = np.arange(len(needles), dtype=np.int64) * n // len(needles)
    start = np.clip(start, 0, n - 1)
    ahead = hay[start] < needles  # the place looked for lies after the start
    low, high = np.where(ahead, start, -1), np.where(ahead, n, start)  # hay[low] < needle <= hay[high]
    for way, open_ in ((1, np.flatnonzero(ahead)), (-1, np.flatnonzero(~ahead))):
        step = 1
        while len(open_):
            probe = start[open_] + way * step
            inside = probe < n if way > 0 else probe >= 0
            open_, probe = open_[inside], probe[inside]
            smaller = hay[probe] < needles[open_]
            low[open_[smaller]] = probe[smaller]
            high[open_[~smaller]] = probe[~smaller]
            open_ = open_[smaller] if way > 0 else open_[~smaller]
            step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        smaller = hay[middle] < needles[open_]
        low[open_[smaller]] = middle[smaller]
        high[open_[~smaller]] = middle[~smaller]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def found_at(places: np.ndarray, needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Which needles stand in ``hay``, given their places."""
    inside = places < len(hay)
    out = np.zeros(len(needles), bool)
    out[inside] = hay[places[inside]] == needles[inside]
    return out


def common(one: np.ndarray, two: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists, each without repeats, of the values in common; the shorter list drives the search."""
    if len(one) > len(two):
        second, first = common(two, one)
        return first, second
    places = gallop(one, two, start)
    at = np.flatnonzero(found_at(places, one, two))
    return at, places[at]


def difference(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Values of ``one`` that do not stand in ``two``."""
    if len(one) <= len(two):
        return one[~found_at(gallop(one, two), one, two)]
    gone, _ = common(one, two)
    return np.delete(one, gone)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """k-way merge of sorted lists without repeats: the longest takes in what the others have and it has not."""
    if not lists:
        return np.empty(0, np.int64)
    longest, *others = sorted(lists, key=len, reverse=True)
    for other in others:
        places = gallop(other, longest)
        new = ~found_at(places, other, longest)
        longest = np.insert(longest, places[new], other[new])
    return longest
