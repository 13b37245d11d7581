"""Prefix doubling over arrays of symbols, for the operators that need suffixes in order within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PACKED = 1 << 21


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the tuples (major key first): the number of smaller ones."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return rank


def refined(rank: np.ndarray, end: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rank, open) after 1, 2, 4, ... symbols: the rank of each suffix by so many symbols, and the suffixes, in order of place,
    that share theirs. Only these are sorted again. end: where the text of each place ends; a suffix that ends is less than one
    that goes on. Without it, the last place of the text and each one before a text's end must have a rank of its own."""
    n = len(rank)
    rank = np.append(rank, -1)
    open_ = np.flatnonzero(np.bincount(rank[:-1], minlength=n)[rank[:-1]] > 1)
    yield rank, open_
    length = 1
    while len(open_):
        old = rank[open_]
        beyond = open_ + length
        following = rank[np.minimum(beyond, n)] + 1
        if end is not None:
            following[beyond >= end[open_]] = 0
        if n < PACKED - 1:
            key = np.sort((old.astype(np.uint64) << np.uint64(42)) | (following.astype(np.uint64) << np.uint64(21)) | np.arange(len(open_), dtype=np.uint64))
            order = (key & np.uint64(PACKED - 1)).astype(np.int64)
        else:
            order = np.lexsort((following, old))
        old, following = old[order], following[order]
        head = np.append(True, old[1:] != old[:-1])
        new = head.copy()
        new[1:] |= following[1:] != following[:-1]
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(head, at, 0))
        group = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[open_[order]] = old + group - first
        single = np.diff(np.append(np.flatnonzero(new), len(order))) == 1
        open_ = np.sort(open_[order][~single[np.cumsum(new) - 1]])
        length *= 2
        yield rank, open_
