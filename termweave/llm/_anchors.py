"""Content-defined anchors: which gram of every window has the least hash, and runs of windows that share one.

Equal windows have the same grams and so the same anchor at the same place in them. Whatever repeats can thus be found
by looking up one anchor for several windows instead of every window.
"""

from __future__ import annotations

import numpy as np


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the least of values[i : i + width], the leftmost of equals."""
    best, at = values, np.arange(len(values), dtype=np.int64)
    span = 1
    while span < width:
        step = min(span, width - span)
        left = best[:-step] <= best[step:]
        best, at = np.where(left, best[:-step], best[step:]), np.where(left, at[:-step], at[step:])
        span += step
    return at


def anchored_runs(grams: np.ndarray, gram: int, window: int, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows of one document with one anchor, over documents in a row.

    ``grams`` hashes the grams of ``gram`` symbols, ``counts`` are the documents' symbols. Returns, for each run, its
    anchor's index, its first window's index, how many windows it has, its document and the first window's place there.
    """
    none = np.empty(0, np.int64)
    n = int(counts.sum()) - window + 1
    if n <= 0:
        return none, none, none, none, none
    at = leftmost_minima(grams, window - gram + 1)[:n]
    first = np.cumsum(counts) - counts
    windows = np.maximum(counts - window + 1, 0)
    total = int(windows.sum())
    if not total:
        return none, none, none, none, none
    docs = np.repeat(np.arange(len(counts)), windows)
    inner = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    index = first[docs] + inner
    anchor = at[index]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inner[1:] == 0)
    begin = np.flatnonzero(new)
    return anchor[begin], index[begin], np.diff(begin, append=total), docs[begin], inner[begin]
