"""The median slope of a series without all its pairs: bisection on the slope, counting pairs under it as inversions.

Points i < j have a slope of at most t just if y - t * i does not rise from i to j; so the number of such pairs is that of the inversions
of one order, counted in n log n by merging.  Bisection leaves a stretch with few slopes, whose pairs alone are listed and sorted.
Rounding is kept out by widening that stretch by more than it can do, so the result is that of sorting all slopes.
"""

from __future__ import annotations

import numpy as np

#: Up to so many points all pairs are made.
FEW = 96


def ranks(y: np.ndarray, t: float) -> np.ndarray:
    """Ranks of y - t * i, the later of equals first: a pair has a slope of at most t just if its ranks fall."""
    z = y - t * np.arange(len(y))
    out = np.empty(len(y), np.int64)
    out[np.lexsort((-np.arange(len(y)), z))] = np.arange(len(y))
    return out


def inversions(order: np.ndarray, listed: bool = False) -> int | tuple[np.ndarray, np.ndarray]:
    """How many pairs of a permutation fall; listed: their values (the one before, the one after)."""
    n, width, total, pairs = len(order), 1, 0, []
    order = order.copy()
    while width < n:
        block = np.arange(n) // (2 * width)
        right = np.arange(n) // width % 2 == 1
        key = block * n + order
        left_keys = key[~right]  # ascending: blocks follow each other and each half is sorted
        at = np.searchsorted(left_keys, key[right])
        end = np.searchsorted(left_keys, (block[right] + 1) * n)
        total += int((end - at).sum())
        if listed and (end > at).any():
            size = end - at
            stop = np.cumsum(size)
            pairs.append((left_keys[np.repeat(at - stop + size, size) + np.arange(stop[-1])] % n, np.repeat(order[right], size)))
        order = np.sort(key) % n
        width *= 2
    if not listed:
        return total
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _kth(y: np.ndarray, k: int, count: int) -> np.ndarray:
    """The slopes of ranks k .. k + count - 1 (from 0)."""
    n = len(y)
    steps = np.diff(y)
    lo, hi = float(steps.min()), float(steps.max())  # every slope is a mean of neighbours' slopes
    slack = 16 * np.finfo(float).eps * (float(np.abs(y).max()) + n * max(abs(lo), abs(hi)) + 1e-300)
    lo, hi = lo - slack, hi + slack
    below, upto = 0, n * (n - 1) // 2
    while upto - below > 8 * n and hi - lo > 8 * slack:
        mid = lo + (hi - lo) / 2
        c = inversions(ranks(y, mid))
        if c <= k:
            lo, below = mid, c
        elif c >= k + count:
            hi, upto = mid, c
        else:
            break
    lo, hi = lo - 2 * slack, hi + 2 * slack
    first, last = ranks(y, lo), ranks(y, hi)
    if upto - below > 64 * n:
        return _of_many(y, k, count)
    place = np.argsort(first)  # points in the order at lo; those that fall in the order at hi have their slope between
    a, b = inversions(last[place], listed=True)
    point = np.argsort(last)
    i, j = point[a], point[b]
    i, j = np.minimum(i, j), np.maximum(i, j)
    slopes = np.sort((y[j] - y[i]) / (j - i))
    at = k - inversions(first)
    return slopes[at : at + count]


def _of_many(y: np.ndarray, k: int, count: int) -> np.ndarray:
    """The same where very many slopes are equal but for rounding: values are counted exactly, row by row."""
    n = len(y)
    found = {}
    for i in range(n - 1):
        values, times = np.unique((y[i + 1 :] - y[i]) / np.arange(1, n - i), return_counts=True)
        for v, c in zip(values.tolist(), times.tolist(), strict=True):
            found[v] = found.get(v, 0) + c
        if len(found) > 64 * n:  # so many different values need no counting by value
            return np.sort(np.concatenate([(y[i + 1 :] - y[i]) / np.arange(1, n - i) for i in range(n - 1)]))[k : k + count]
    values = np.array(sorted(found))
    upto = np.cumsum([found[v] for v in values.tolist()])
    return values[np.searchsorted(upto, np.arange(k, k + count), "right")]


def median_slope(values: np.ndarray) -> float:
    """Theil-Sen's slope; 0 under two values, NaN if a value is null or NaN."""
    y = np.asarray(values, float)
    n = len(y)
    if n < 2:
        return 0.0
    if np.isnan(y).any():
        return float("nan")
    total = n * (n - 1) // 2
    k, count = (total - 1) // 2, 2 - total % 2
    if n <= FEW or not np.isfinite(y).all():
        i, j = np.triu_indices(n, 1)
        middle = np.sort((y[j] - y[i]) / (j - i))[k : k + count]
    else:
        middle = _kth(y, k, count)
    return float((middle[0] + middle[-1]) / 2)
